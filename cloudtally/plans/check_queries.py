"""Registered queries for alerts, policy, drift and image agreement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.operators import drift, incidents, policy
from cloudtally.plans import derived as d
from cloudtally.plans import telemetry_queries as tq
from cloudtally.plans.telemetry_queries import P95, SPREAD, ntz

S = SparkSession


def error_breaches(spark: S, sf: str) -> DataFrame:
    return ntz(incidents.error_breaches(tq.deltas(spark, sf), d.alert_rules()))


def latency_breaches(spark: S, sf: str) -> DataFrame:
    found = incidents.latency_breaches(tq.bucket_deltas(spark, sf), d.alert_rules())
    return ntz(found).withColumn("value", F.round("value", 9))


def busy_evaluations(spark: S, sf: str) -> DataFrame:
    return ntz(incidents.busy_enough(tq.deltas(spark, sf), d.alert_rules())).drop("value")


def held_evaluations(spark: S, sf: str) -> DataFrame:
    rules = d.alert_rules()
    return ntz(incidents.held(incidents.error_breaches(tq.deltas(spark, sf), rules), rules), "eval_ts", "since")


def alert_incidents(spark: S, sf: str) -> DataFrame:
    """Both policies replayed together."""
    rules = d.alert_rules()
    breaches = incidents.error_breaches(tq.deltas(spark, sf), rules).unionByName(
        incidents.latency_breaches(tq.bucket_deltas(spark, sf), rules)
    )
    found = incidents.incidents(breaches, rules, as_of=datetime(2024, 1, 25))
    return ntz(found, "opened_at", "last_firing", "closed_at").withColumn("peak", F.round("peak", 9))


def _resources(spark: S, sf: str, **options) -> DataFrame:
    return policy.planned_resources(d.plan_documents(spark, sf), **options)


def planned_resources(spark: S, sf: str) -> DataFrame:
    return _resources(spark, sf).groupBy("root", "type").agg(F.count(F.lit(1)).alias("resources"))


def planned_with_replacements(spark: S, sf: str) -> DataFrame:
    rows = _resources(spark, sf, include_replacements=True)
    return rows.groupBy("root", "type").agg(F.count(F.lit(1)).alias("resources"))


def planned_null_actions(spark: S, sf: str) -> DataFrame:
    """Resources and findings of plans with a null among the actions."""
    rows = policy.planned_resources(d.null_action_plans(spark, sf))
    found = policy.findings(rows).groupBy("root").agg(F.count(F.lit(1)).alias("findings"))
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("resources")).join(found, "root", "left")


def effective_tags(spark: S, sf: str) -> DataFrame:
    tags = policy.effective_tags(F.col("type"), F.col("after"))
    rows = _resources(spark, sf).select("type", F.explode(tags).alias("key", "_v"))
    return rows.groupBy("type", "key", F.to_json("_v").alias("value")).agg(F.count(F.lit(1)).alias("resources"))


def policy_findings(spark: S, sf: str) -> DataFrame:
    return policy.findings(_resources(spark, sf))


def policy_findings_strict(spark: S, sf: str) -> DataFrame:
    """With replacements scanned and portless rules reported."""
    rows = policy.findings(_resources(spark, sf, include_replacements=True), strict_ports=True)
    return rows.groupBy("rule", "level").agg(F.count(F.lit(1)).alias("findings"))


def policy_verdicts(spark: S, sf: str) -> DataFrame:
    return policy.verdicts(policy_findings(spark, sf), (*d.ROOTS, "empty"))


def policy_broken_plans(spark: S, sf: str) -> DataFrame:
    """Verdicts where some plans are cut off and one root was never listed."""
    return policy.verdicts(policy.plan_findings(d.broken_plan_documents(spark, sf)), (*d.ROOTS, "empty"))


def policy_statements(spark: S, sf: str) -> DataFrame:
    from cloudtally.functions import json_values as j

    rows = _resources(spark, sf).filter(F.col("type") == "aws_iam_role_policy")
    each = rows.select("address", F.explode(policy.statements(F.col("after"), "policy")).alias("s"))
    s = F.col("s")
    return each.select(
        "address",
        F.array_join(j.one_or_many(s, "$.Action"), ",").alias("actions"),
        F.array_join(j.one_or_many(s, "$.Resource"), ",").alias("resources"),
    )


def _drift(spark: S, sf: str, **options) -> DataFrame:
    return drift.snapshot_diff(
        drift.state_documents(d.declared_state(spark, sf)), drift.state_documents(d.observed_state(spark, sf)), **options
    )


def state_drift(spark: S, sf: str) -> DataFrame:
    return _drift(spark, sf)


def state_drift_owned(spark: S, sf: str) -> DataFrame:
    """Without what another process owns, or hand-added keys on one provider."""
    return _drift(spark, sf, ignore=d.ignored_attributes(spark, sf), declared_only=("google_",))


def state_drift_nested(spark: S, sf: str) -> DataFrame:
    """Changes below the top level, named by path; ignored ones count in their own root only."""
    return drift.snapshot_diff(
        drift.state_documents(d.nested_state(spark, sf, observed=False)),
        drift.state_documents(d.nested_state(spark, sf, observed=True)),
        ignore=d.ignored_paths(spark, sf),
        declared_only=("google_",),
    )


def drift_broken_state(spark: S, sf: str) -> DataFrame:
    """Status where some documents cannot be read, and one root was never listed."""
    diff = drift.snapshot_diff(
        drift.state_documents(d.broken_state(spark, sf, observed=False)), drift.state_documents(d.broken_state(spark, sf, observed=True))
    )
    return drift.drift_status(diff, ("hub", "aws", "azure", "empty"))


def drift_status(spark: S, sf: str) -> DataFrame:
    return drift.drift_status(state_drift_owned(spark, sf), (*d.ROOTS, "empty"))


def digest_agreement(spark: S, sf: str) -> DataFrame:
    return drift.digest_agreement(d.image_digests(spark, sf), d.CLOUDS)


QUERIES = {
    f.__name__: f
    for f in (
        error_breaches, latency_breaches, busy_evaluations, held_evaluations, alert_incidents,
        planned_resources, planned_with_replacements, planned_null_actions, effective_tags, policy_statements, policy_findings,
        policy_findings_strict, policy_verdicts, policy_broken_plans, state_drift, state_drift_owned, state_drift_nested,
        drift_status, drift_broken_state, digest_agreement,
    )
}

BREACHES = P95 + """,
traffic AS (SELECT cloud, eval_ts, count(*) FILTER (status = '500') AS errors, count(*) AS total FROM spread
  WHERE route <> 'unmatched' GROUP BY 1, 2),
bad AS (
  SELECT 'error ratio' AS policy, cloud, eval_ts, errors::DOUBLE / total::DOUBLE AS value FROM traffic
  WHERE total > 15 AND errors > 0 AND errors::DOUBLE / total::DOUBLE > 0.3
  UNION ALL
  SELECT 'p95 latency', p95.cloud, p95.eval_ts, value FROM p95 JOIN traffic t ON p95.cloud = t.cloud AND p95.eval_ts = t.eval_ts
  WHERE value > 0.15 AND total > 15
)"""

# Runs of consecutive hours: the hour number minus its rank is constant in a run.
FIRING = BREACHES + """,
islands AS (
  SELECT *, epoch(eval_ts)::BIGINT // 3600 - row_number() OVER (PARTITION BY policy, cloud ORDER BY eval_ts) AS island FROM bad
),
held AS (SELECT *, min(eval_ts) OVER (PARTITION BY policy, cloud, island) AS since FROM islands),
firing AS (SELECT * FROM held WHERE eval_ts > since)"""

_TYPES = d.RESOURCE_TYPES


def _type_case() -> str:
    return "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def _resources_sql(gone: str) -> str:
    return f"""res AS (
      SELECT CASE p_partkey % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'gcp' WHEN 2 THEN 'aws' ELSE 'azure' END AS root,
        p_partkey % 14 AS t, p_size % 3 AS s, {_type_case()} AS type, {_type_case()} || '.r' || p_partkey AS address
      FROM part WHERE {gone}
    )"""


_KEPT = "p_partkey % 17 <> 0 AND p_partkey % 19 <> 0"
_KEPT_ALL = "p_partkey % 17 <> 0"

# What each setting must give: type, setting (0 right, 1 wrong, 2 left out), rule, message.
_EXPECTED = (
    (0, 1, "tag-empty", "has an empty project tag"),
    (0, 1, "tag-estate", 'has estate "prod", which is not one of hub, gcp, aws or azure'),
    (0, 2, "tag-missing", "has no owner tag"),
    (0, 2, "tag-missing", "has no managed-by tag"),
    (0, 2, "tag-estate", "has estate null, which is not one of hub, gcp, aws or azure"),
    (1, 1, "open-port", "opens port 22 to the internet"),
    (2, 1, "plain-http-listener", "serves plain HTTP"),
    *[(3, s, "bucket-public-access", "does not enforce public access prevention") for s in (1, 2)],
    *[(3, s, "bucket-object-acls", "allows per-object ACLs") for s in (1, 2)],
    *[(4, s, "registry-admin-user", "has the admin user turned on") for s in (1, 2)],
    *[(5, s, "ingress-plain-http", "accepts plain HTTP") for s in (1, 2)],
    *[(6, s, "ecr-mutable-tags", "allows tags to be overwritten") for s in (1, 2)],
    *[(7, s, "artifact-mutable-tags", "allows tags to be overwritten") for s in (1, 2)],
    (8, 1, "wildcard-action", "grants the wildcard action s3:*"),
    (8, 1, "star-resource", "grants s3:GetObject on every resource"),
    (8, 2, "wildcard-action", "grants the wildcard action s3:Get*"),
    (8, 2, "star-resource", "grants s3:Get* on every resource"),
    *[(9, s, "github-trust", "trusts GitHub without an exact subject condition") for s in (1, 2)],
    (10, 1, "google-basic-role", "grants the basic role roles/editor"),
    *[(11, s, "service-account-key", "creates a service account key") for s in (0, 1, 2)],
    (12, 1, "google-public-member", "grants roles/run.admin to allUsers"),
    (13, 1, "azure-broad-role", "assigns Contributor"),
    (13, 1, "azure-group-scope", "assigns Contributor on a whole resource group"),
    (13, 2, "azure-subscription-scope", "is scoped to a whole subscription"),
)
_RULE_TABLE = "rules(t, s, rule, text) AS (VALUES " + ", ".join(f"({t}, {s}, '{r}', '{m}')" for t, s, r, m in _EXPECTED) + ")"
_FOUND = f"""found AS (SELECT root, address, rule, CASE WHEN rule = 'plain-http-listener' THEN 'warn' ELSE 'deny' END AS level,
    address || ' ' || text AS message FROM res JOIN rules ON res.t = rules.t AND res.s = rules.s)"""

_DRIFT = """o AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'gcp' WHEN 2 THEN 'aws' ELSE 'azure' END AS root,
    CASE o_orderkey % 3 WHEN 0 THEN 'aws_thing' WHEN 1 THEN 'google_thing' ELSE 'azurerm_thing' END || '.o' || o_orderkey AS address,
    '"' || o_orderpriority || '"' AS priority, '"' || o_orderstatus || '"' AS status
  FROM orders
),
diff AS (
  SELECT k, root, address, 'priority' AS attr, priority AS declared, NULL AS observed, 'removed' AS change FROM o WHERE k % 110 = 0
  UNION ALL SELECT k, root, address, 'status', status, NULL, 'removed' FROM o WHERE k % 110 = 0 OR k % 90 = 0
  UNION ALL SELECT k, root, address, 'priority', priority, '"changed by hand"', 'changed' FROM o WHERE k % 50 = 0 AND k % 110 <> 0
  UNION ALL SELECT k, root, address, 'note', NULL, '1', 'added' FROM o WHERE k % 90 = 0 AND k % 110 <> 0
  UNION ALL SELECT k, root, address, 'added', NULL, '"console"', 'added' FROM o WHERE k % 70 = 0 AND k % 110 <> 0
),
owned AS (
  SELECT * FROM diff WHERE NOT (k % 300 = 0 AND attr = 'priority') AND NOT (change = 'added' AND address LIKE 'google_thing%')
)"""

ORACLE = {
    "error_breaches": f"WITH {BREACHES} SELECT policy, cloud, eval_ts, value FROM bad WHERE policy = 'error ratio'",
    "latency_breaches": f"WITH {BREACHES} SELECT policy, cloud, eval_ts, round(value, 9) AS value FROM bad WHERE policy = 'p95 latency'",
    "busy_evaluations": f"""WITH {SPREAD} SELECT cloud, eval_ts FROM spread WHERE route <> 'unmatched' GROUP BY 1, 2 HAVING count(*) > 15""",
    "held_evaluations": f"WITH {FIRING} SELECT policy, cloud, eval_ts, value, since FROM firing WHERE policy = 'error ratio'",
    "alert_incidents": f"""WITH {FIRING},
      g AS (SELECT *, CASE WHEN lag(eval_ts) OVER w IS NULL OR eval_ts - lag(eval_ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh
            FROM firing WINDOW w AS (PARTITION BY policy, cloud ORDER BY eval_ts)),
      n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY policy, cloud ORDER BY eval_ts) AS BIGINT) AS incident FROM g)
      SELECT policy, cloud, incident, min(eval_ts) AS opened_at, max(eval_ts) AS last_firing, count(*) AS evaluations,
        round(max(value), 9) AS peak,
        CASE WHEN max(eval_ts) + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-25' THEN CAST(max(eval_ts) + INTERVAL 4 HOUR AS TIMESTAMP) END AS closed_at
      FROM n GROUP BY 1, 2, 3""",
    "planned_resources": f"WITH {_resources_sql(_KEPT)} SELECT root, type, count(*) AS resources FROM res GROUP BY 1, 2",
    "planned_with_replacements": f"WITH {_resources_sql(_KEPT_ALL)} SELECT root, type, count(*) AS resources FROM res GROUP BY 1, 2",
    "planned_null_actions": f"""WITH {_resources_sql(_KEPT)}, {_RULE_TABLE}, {_FOUND},
      f AS (SELECT root, count(*) AS findings FROM found GROUP BY root)
      SELECT root, count(*) AS resources, any_value(findings) AS findings FROM res LEFT JOIN f USING (root) GROUP BY root""",
    "effective_tags": f"""WITH {_resources_sql(_KEPT)},
      g(key, value) AS (VALUES ('project', '"platform-one"'), ('env', '"dev"'), ('owner', '"ops"'), ('estate', '"aws"'), ('managed-by', '"terraform"')),
      w(key, value) AS (VALUES ('project', '""'), ('env', '"dev"'), ('owner', '"ops"'), ('estate', '"prod"'), ('managed-by', '"terraform"')),
      m(key, value) AS (VALUES ('project', '"platform-one"'), ('env', '"dev"'), ('estate', 'null'), ('managed-by', 'false')),
      x AS (SELECT type, key, value FROM res, g WHERE t IN (1, 2, 3, 4, 5, 6, 7, 9) OR (t = 0 AND s = 0)
            UNION ALL SELECT type, key, value FROM res, w WHERE t = 0 AND s = 1
            UNION ALL SELECT type, key, value FROM res, m WHERE t = 0 AND s = 2)
      SELECT type, key, value, count(*) AS resources FROM x GROUP BY 1, 2, 3""",
    "policy_statements": f"""WITH {_resources_sql(_KEPT)},
      st(s, actions, resources) AS (VALUES (0, 'ecr:GetAuthorizationToken,ec2:Describe*', '*'), (1, 's3:*', 'arn:x'),
        (1, 's3:GetObject', '*'), (2, 's3:Get*', '*'))
      SELECT address, actions, resources FROM res JOIN st ON res.s = st.s WHERE t = 8""",
    "policy_findings": f"WITH {_resources_sql(_KEPT)}, {_RULE_TABLE}, {_FOUND} SELECT DISTINCT * FROM found",
    "policy_findings_strict": f"""WITH {_resources_sql(_KEPT_ALL)}, {_RULE_TABLE}, {_FOUND},
      every AS (SELECT * FROM found UNION ALL SELECT root, address, 'open-port', 'deny', 'any' FROM res WHERE t = 1 AND s = 2)
      SELECT rule, level, count(*) AS findings FROM every GROUP BY 1, 2""",
    "policy_verdicts": f"""WITH {_resources_sql(_KEPT)}, {_RULE_TABLE}, {_FOUND},
      r(root) AS (VALUES ('hub'), ('gcp'), ('aws'), ('azure'), ('empty')),
      c AS (SELECT r.root, count(*) FILTER (level = 'deny') AS failures, count(*) FILTER (level = 'warn') AS warnings,
              count(DISTINCT rule) AS fired FROM r LEFT JOIN found ON r.root = found.root GROUP BY 1)
      SELECT root, failures, warnings, CAST(20 - fired AS BIGINT) AS rules_passed,
        CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM c""",
    "policy_broken_plans": f"""WITH {_resources_sql(_KEPT).replace("p_size % 3 AS s,", "p_size % 3 AS s, p_partkey // 100 AS batch,")}, {_RULE_TABLE},
      b AS (SELECT p_partkey % 4 AS r, p_partkey // 100 AS batch FROM part),
      renamed AS (SELECT * REPLACE (CASE WHEN root = 'gcp' AND batch % 3 = 1 THEN 'stray' ELSE root END AS root) FROM res WHERE batch % 5 <> 0),
      said AS (
        SELECT DISTINCT root, address || ' ' || text AS message, rule, CASE WHEN rule = 'plain-http-listener' THEN 'warn' ELSE 'deny' END AS level
        FROM renamed JOIN rules ON renamed.t = rules.t AND renamed.s = rules.s
        UNION ALL SELECT DISTINCT CASE r WHEN 0 THEN 'hub' WHEN 2 THEN 'aws' WHEN 3 THEN 'azure' ELSE CASE WHEN batch % 3 = 1 THEN 'stray' ELSE 'gcp' END END,
          'cut', 'plan-unreadable', 'deny' FROM b WHERE batch % 5 = 0
      ),
      r(root) AS (SELECT root FROM (VALUES ('hub'), ('gcp'), ('aws'), ('azure'), ('empty')) v(root) UNION SELECT root FROM said),
      c AS (SELECT r.root, count(*) FILTER (level = 'deny') AS failures, count(*) FILTER (level = 'warn') AS warnings, count(DISTINCT rule) AS fired,
              coalesce(bool_or(rule = 'plan-unreadable'), FALSE) AS unread FROM r LEFT JOIN said ON r.root = said.root GROUP BY 1)
      SELECT root, failures, warnings, CAST(CASE WHEN unread THEN 0 ELSE 20 - fired END AS BIGINT) AS rules_passed,
        CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM c""",
    "state_drift_nested": """WITH o AS (
        SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'gcp' WHEN 2 THEN 'aws' ELSE 'azure' END AS root, o_orderkey % 3 = 1 AS google,
          CASE o_orderkey % 3 WHEN 0 THEN 'aws_thing' WHEN 1 THEN 'google_thing' ELSE 'azurerm_thing' END || '.n' || o_orderkey AS address FROM orders)
      SELECT root, address, 'labels.hand' AS attr, CAST(NULL AS VARCHAR) AS declared, '"x"' AS observed, 'added' AS change FROM o WHERE k % 40 = 0 AND NOT google
      UNION ALL SELECT root, address, 'empty.in[0]', NULL, '1', 'added' FROM o WHERE k % 100 = 0 AND NOT google
      UNION ALL SELECT root, address, 'tags.by', NULL, '"console"', 'added' FROM o WHERE k % 70 = 0 AND NOT google
      UNION ALL SELECT root, address, 'template[0].containers[0].image', '"v1"', '"v2"', 'changed' FROM o WHERE k % 60 = 0 AND NOT (k % 120 = 0 OR root = 'gcp')
      UNION ALL SELECT root, address, 'template[0].containers[0].cpu', '1', '2', 'changed' FROM o WHERE k % 110 = 0""",
    "drift_broken_state": f"""WITH {_DRIFT},
      s AS (SELECT root, FALSE AS unread FROM diff WHERE k % 130 <> 0 UNION ALL SELECT root, TRUE FROM o WHERE k % 130 = 0),
      r(root) AS (SELECT root FROM (VALUES ('hub'), ('aws'), ('azure'), ('empty')) v(root) UNION SELECT root FROM s)
      SELECT r.root, count(s.root) AS changes, CASE WHEN bool_or(unread) THEN 'unreadable' WHEN count(s.root) > 0 THEN 'drift' ELSE 'clean' END AS status
      FROM r LEFT JOIN s ON r.root = s.root GROUP BY 1""",
    "state_drift": f"WITH {_DRIFT} SELECT root, address, attr, declared, observed, change FROM diff",
    "state_drift_owned": f"WITH {_DRIFT} SELECT root, address, attr, declared, observed, change FROM owned",
    "drift_status": f"""WITH {_DRIFT}, r(root) AS (VALUES ('hub'), ('gcp'), ('aws'), ('azure'), ('empty'))
      SELECT r.root, count(owned.k) AS changes, CASE WHEN count(owned.k) > 0 THEN 'drift' ELSE 'clean' END AS status
      FROM r LEFT JOIN owned ON r.root = owned.root GROUP BY 1""",
    "digest_agreement": """SELECT CAST(p_partkey AS VARCHAR) AS tag, CAST(CASE WHEN p_partkey % 150 = 0 THEN 2 ELSE 3 END AS BIGINT) AS registries,
      CAST(CASE WHEN p_partkey % 150 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing,
      CASE WHEN p_partkey % 100 = 0 THEN 'differ' WHEN p_partkey % 150 = 0 THEN 'missing' ELSE 'same' END AS status FROM part""",
}
