"""Policy rules over tables of planned resource changes.

A plan is a row ``(root, plan)`` with JSON text. Every rule is an expression on
one resource; all rules run in one pass, each resource giving an array of
findings, and only the findings are shuffled, to collapse duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.functions import json_values as j
from cloudtally.functions.labels import join_same

# Fixed values of the rules: tag vocabulary, allow lists, broad roles.
REQUIRED_TAGS = ("project", "env", "owner", "estate", "managed-by")
ESTATES = ("hub", "gcp", "aws", "azure")
STAR_RESOURCE_OK = (
    "ecr:GetAuthorizationToken",
    "ecs:RegisterTaskDefinition",
    "ecs:DescribeTaskDefinition",
    "ssmmessages:CreateControlChannel",
    "ssmmessages:CreateDataChannel",
    "ssmmessages:OpenControlChannel",
    "ssmmessages:OpenDataChannel",
)
READ_ONLY_WILDCARD = r"^[a-z0-9-]+:(Describe|List)\*$"
GITHUB_ISSUER = "token.actions.githubusercontent.com"
BASIC_ROLES = ("roles/owner", "roles/editor", "roles/viewer")
GOOGLE_IAM_TYPES = (
    "google_project_iam_member",
    "google_storage_bucket_iam_member",
    "google_bigquery_dataset_iam_member",
    "google_artifact_registry_repository_iam_member",
    "google_cloud_run_v2_service_iam_member",
    "google_service_account_iam_member",
)
PUBLIC_MEMBERS = ("allUsers", "allAuthenticatedUsers")
BROAD_AZURE_ROLES = ("Owner", "Contributor", "User Access Administrator")
SUBSCRIPTION_SCOPE = r"^/subscriptions/[^/]+/?$"
GROUP_SCOPE = r"^/subscriptions/[^/]+/resourceGroups/[^/]+/?$"
WEB_PORTS = (80, 443)
TAG_FIELD = {"aws_": "tags_all", "google_": "terraform_labels", "azurerm_": "tags"}

# Rule name and level, in report order.
RULES = {
    "tag-missing": "deny",
    "tag-empty": "deny",
    "tag-estate": "deny",
    "open-port": "deny",
    "plain-http-listener": "warn",
    "bucket-public-access": "deny",
    "bucket-object-acls": "deny",
    "registry-admin-user": "deny",
    "ingress-plain-http": "deny",
    "ecr-mutable-tags": "deny",
    "artifact-mutable-tags": "deny",
    "wildcard-action": "deny",
    "star-resource": "deny",
    "github-trust": "deny",
    "google-basic-role": "deny",
    "service-account-key": "deny",
    "google-public-member": "deny",
    "azure-broad-role": "deny",
    "azure-subscription-scope": "deny",
    "azure-group-scope": "deny",
}

# What a plan that cannot be read gives. It is no rule: nothing is known about any of them.
UNREADABLE = "plan-unreadable"

_NONE = "array<struct<rule:string,message:string>>"


def planned_resources(plans: DataFrame, include_replacements: bool = False) -> DataFrame:
    """One row per resource that will exist: ``root, address, type, after``.

    A change that deletes is dropped, and so is one with nothing after it. A
    replacement lists both delete and create and is dropped as well, unless
    ``include_replacements``. Other values among the actions, null too, do not
    matter. A plan without a list of changes plans nothing, so it has no row
    here and no finding.
    """
    changes = plans.select("root", F.explode(j.items(j.parse(F.col("plan")), "$.resource_changes")).alias("rc"))
    rc = F.col("rc")
    rows = changes.select(
        "root",
        j.text(rc, "$.address").alias("address"),
        j.text(rc, "$.type").alias("type"),
        j.one_or_many(rc, "$.change.actions").alias("actions"),
        F.try_variant_get(rc, "$.change.after", "variant").alias("after"),
    )

    def acts(what: str) -> Column:
        # An array with a NULL in it gives NULL where it does not hold the value.
        return F.coalesce(F.array_contains("actions", what), F.lit(False))

    going = acts("delete")
    if include_replacements:
        going = going & ~acts("create")
    # A JSON null is a value, not a SQL NULL, so both are tested.
    exists = F.col("after").isNotNull() & ~F.is_variant_null("after")
    return rows.filter(exists & ~going).drop("actions")


def unreadable_plans(plans: DataFrame) -> DataFrame:
    """A denying finding for every root with a plan that is missing or is not a JSON object."""
    is_object = F.coalesce(F.schema_of_variant(j.parse(F.col("plan"))).startswith("OBJECT"), F.lit(False))
    return (
        plans.filter(~is_object)
        .select(
            "root",
            F.lit("plan").alias("address"),
            F.lit(UNREADABLE).alias("rule"),
            F.lit("deny").alias("level"),
            F.concat(F.lit("a plan of "), F.coalesce("root", F.lit("an unnamed root")), F.lit(" cannot be read")).alias("message"),
        )
        .distinct()
    )


def effective_tags(resource_type: Column, after: Column) -> Column:
    """Tags under the name the provider uses; NULL if there is no such object."""
    found = None
    for prefix, field in TAG_FIELD.items():
        hit = F.startswith(resource_type, F.lit(prefix))
        found = F.when(hit, j.fields(after, f"$.{field}")) if found is None else found.when(hit, j.fields(after, f"$.{field}"))
    return found


def _finding(rule: str, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), message.alias("message"))


def _when(condition: Column, rule: str, message: Column) -> Column:
    return F.when(condition, F.array(_finding(rule, message))).otherwise(F.array().cast(_NONE))


def _each(elements: Column, rule: str, message) -> Column:
    return F.transform(elements, lambda e: _finding(rule, message(e)))


def _say(template: str, *parts: Column) -> Column:
    """Fill a message; a part that is missing makes it NULL, and a NULL message
    is no finding, as a rule that cannot read a value says nothing."""
    return F.concat(*[p for text, part in zip(template.split("%"), [*parts, F.lit("")]) for p in (F.lit(text), part)])


def _tag_findings(address: Column, tags: Column) -> Column:
    required = F.array(*[F.lit(t) for t in REQUIRED_TAGS])

    def raw(key: Column) -> Column:
        return F.to_json(F.try_element_at(tags, key))

    # False counts as missing; a null does not, it only fails the estate rule.
    missing = F.filter(required, lambda k: ~F.map_contains_key(tags, k) | F.coalesce(raw(k) == "false", F.lit(False)))
    empty = F.filter(required, lambda k: F.coalesce(raw(k) == '""', F.lit(False)))
    estate = raw(F.lit("estate"))
    members = [f'"{e}"' for e in ESTATES]
    odd = F.map_contains_key(tags, F.lit("estate")) & ~F.coalesce(estate.isin(*members), F.lit(False))
    return F.when(
        tags.isNotNull(),
        F.concat(
            _each(missing, "tag-missing", lambda k: _say("% has no % tag", address, k)),
            _each(empty, "tag-empty", lambda k: _say("% has an empty % tag", address, k)),
            _when(odd, "tag-estate", _say("% has estate %, which is not one of hub, gcp, aws or azure", address, estate)),
        ),
    ).otherwise(F.array().cast(_NONE))


def _exposure_findings(of, address: Column, after: Column, strict_ports: bool) -> Column:
    """Settings that must be safe on purpose: one left out counts as unsafe."""

    def setting(name: str, absent: str) -> Column:
        return F.coalesce(j.raw(after, f"$.{name}"), F.lit(absent))

    # Numbers are compared: a port written as text is not one of the open ones.
    port = j.raw(after, "$.from_port")
    web = F.coalesce(port.try_cast("double").isin(*[float(p) for p in WEB_PORTS]), F.lit(False))
    world = of("aws_vpc_security_group_ingress_rule") & F.coalesce(j.text(after, "$.cidr_ipv4") == "0.0.0.0/0", F.lit(False))
    shown_port = F.coalesce(port, F.lit("any")) if strict_ports else port
    insecure = F.filter(
        j.items(after, "$.ingress"),
        lambda i: F.coalesce(j.raw(i, "$.allow_insecure_connections"), F.lit("true")) != "false",
    )
    docker = setting("format", '"DOCKER"') == '"DOCKER"'
    movable = setting("docker_config[0].immutable_tags", "false") == "false"
    overwritten = _say("% allows tags to be overwritten", address)
    return F.concat(
        _when(world & ~web, "open-port", _say("% opens port % to the internet", address, shown_port)),
        _when(
            of("aws_lb_listener") & (j.text(after, "$.protocol") == "HTTP"),
            "plain-http-listener",
            _say("% serves plain HTTP", address),
        ),
        _when(
            of("google_storage_bucket") & (setting("public_access_prevention", '"unset"') != '"enforced"'),
            "bucket-public-access",
            _say("% does not enforce public access prevention", address),
        ),
        _when(
            of("google_storage_bucket") & (setting("uniform_bucket_level_access", "false") != "true"),
            "bucket-object-acls",
            _say("% allows per-object ACLs", address),
        ),
        _when(
            of("azurerm_container_registry") & (setting("admin_enabled", "true") != "false"),
            "registry-admin-user",
            _say("% has the admin user turned on", address),
        ),
        _when(
            of("azurerm_container_app") & (F.size(insecure) > 0),
            "ingress-plain-http",
            _say("% accepts plain HTTP", address),
        ),
        _when(
            of("aws_ecr_repository") & (setting("image_tag_mutability", '"unset"') != '"IMMUTABLE"'),
            "ecr-mutable-tags",
            overwritten,
        ),
        _when(of("google_artifact_registry_repository") & docker & movable, "artifact-mutable-tags", overwritten),
    )


def statements(after: Column, field: str) -> Column:
    """Statements of a policy document held as JSON text inside a value."""
    return j.items(j.parse(j.text(after, f"$.{field}")), "$.Statement")


def _aws_access_findings(of, address: Column, granted: Column, trusted: Column) -> Column:
    def read_only(action: Column) -> Column:
        return action.rlike(READ_ONLY_WILDCARD)

    def wild(s: Column) -> Column:
        bad = F.filter(j.one_or_many(s, "$.Action"), lambda a: a.contains("*") & ~read_only(a))
        return _each(bad, "wildcard-action", lambda a: _say("% grants the wildcard action %", address, a))

    def on_star(s: Column) -> Column:
        bad = F.filter(j.one_or_many(s, "$.Action"), lambda a: ~a.isin(*STAR_RESOURCE_OK) & ~read_only(a))
        found = _each(bad, "star-resource", lambda a: _say("% grants % on every resource", address, a))
        star = F.array_contains(j.one_or_many(s, "$.Resource"), "*")
        return F.when(star, found).otherwise(F.array().cast(_NONE))

    open_trust = F.filter(
        trusted,
        lambda s: F.coalesce(j.text(s, "$.Principal.Federated").contains(GITHUB_ISSUER), F.lit(False))
        & (F.coalesce(j.raw(s, f"$.Condition.StringEquals['{GITHUB_ISSUER}:sub']"), F.lit("false")) == "false"),
    )
    none = F.array().cast(_NONE)
    return F.concat(
        F.when(of("aws_iam_role_policy"), F.flatten(F.transform(granted, wild))).otherwise(none),
        F.when(of("aws_iam_role_policy"), F.flatten(F.transform(granted, on_star))).otherwise(none),
        _when(
            of("aws_iam_role") & (F.size(open_trust) > 0),
            "github-trust",
            _say("% trusts GitHub without an exact subject condition", address),
        ),
    )


def _google_access_findings(of, address: Column, after: Column) -> Column:
    role, member = j.text(after, "$.role"), j.text(after, "$.member")
    grants = of(*GOOGLE_IAM_TYPES)
    public = F.coalesce(member.isin(*PUBLIC_MEMBERS), F.lit(False))
    invoker = of("google_cloud_run_v2_service_iam_member") & F.coalesce(role == "roles/run.invoker", F.lit(False))
    return F.concat(
        _when(grants & role.isin(*BASIC_ROLES), "google-basic-role", _say("% grants the basic role %", address, role)),
        _when(of("google_service_account_key"), "service-account-key", _say("% creates a service account key", address)),
        _when(grants & public & ~invoker, "google-public-member", _say("% grants % to %", address, role, member)),
    )


def _azure_access_findings(of, address: Column, after: Column) -> Column:
    role, scope = j.text(after, "$.role_definition_name"), j.text(after, "$.scope")
    assigned = of("azurerm_role_assignment")
    return F.concat(
        _when(assigned & role.isin(*BROAD_AZURE_ROLES), "azure-broad-role", _say("% assigns %", address, role)),
        _when(
            assigned & scope.rlike(SUBSCRIPTION_SCOPE),
            "azure-subscription-scope",
            _say("% is scoped to a whole subscription", address),
        ),
        _when(
            assigned & scope.rlike(GROUP_SCOPE) & (role != "Reader"),
            "azure-group-scope",
            _say("% assigns % on a whole resource group", address, role),
        ),
    )


def findings(resources: DataFrame, strict_ports: bool = False) -> DataFrame:
    """Every distinct finding: ``root, address, rule, level, message``.

    ``strict_ports`` also reports an open rule that names no port at all, which
    the rule as it stands cannot say anything about.
    """
    kind, address, after = F.col("type"), F.col("address"), F.col("after")
    # What is parsed is a column of its own: used inside a lambda, the parsing
    # would be done again for every element.
    parsed = resources.withColumns(
        {
            "_tags": effective_tags(kind, after),
            "_granted": F.when(kind == "aws_iam_role_policy", statements(after, "policy")),
            "_trusted": F.when(kind == "aws_iam_role", statements(after, "assume_role_policy")),
        }
    )

    def of(*types: str) -> Column:
        return F.coalesce(kind.isin(*types), F.lit(False))

    found = F.concat(
        _tag_findings(address, F.col("_tags")),
        _exposure_findings(of, address, after, strict_ports),
        _aws_access_findings(of, address, F.col("_granted"), F.col("_trusted")),
        _google_access_findings(of, address, after),
        _azure_access_findings(of, address, after),
    )
    warns = [r for r, level in RULES.items() if level == "warn"]
    return (
        parsed.select("root", "address", F.explode(found).alias("_f"))
        .select(
            "root",
            "address",
            "_f.rule",
            F.when(F.col("_f.rule").isin(*warns), "warn").otherwise("deny").alias("level"),
            "_f.message",
        )
        .filter(F.col("message").isNotNull())
        .distinct()
    )


def plan_findings(plans: DataFrame, include_replacements: bool = False, strict_ports: bool = False) -> DataFrame:
    """Findings of whole plan documents, those included that cannot be read."""
    resources = planned_resources(plans, include_replacements)
    return findings(resources, strict_ports).unionByName(unreadable_plans(plans))


def verdicts(found: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Counts per root: of every root listed, and of every other one that has findings.

    A rule passes when it has nothing to say about any resource of the root. No
    rule passes on a root with a plan that could not be read.
    """
    spark = found.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("root"))
    counts = (
        found.groupBy("root", "rule", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("root")
        .agg(
            F.sum(F.when(F.col("level") == "deny", F.col("n")).otherwise(0)).alias("failures"),
            F.sum(F.when(F.col("level") == "warn", F.col("n")).otherwise(0)).alias("warnings"),
            F.count(F.lit(1)).alias("fired"),
            F.bool_or(F.col("rule") == UNREADABLE).alias("unread"),
        )
    )
    zero = F.lit(0).cast("long")
    return join_same(listed, counts, ["root"], "full").select(
        "root",
        F.coalesce("failures", zero).alias("failures"),
        F.coalesce("warnings", zero).alias("warnings"),
        F.when(F.coalesce("unread", F.lit(False)), zero)
        .otherwise(F.lit(len(RULES)).cast("long") - F.coalesce("fired", zero))
        .alias("rules_passed"),
        F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass").alias("verdict"),
    )
