"""Pieces of DuckDB SQL shared by the checks: the derivations, from base columns."""

from __future__ import annotations


def _pick(index: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


# Every charge line with provider, day and money figures.
BILL = f"""
bill AS (
  SELECT *,
    CASE l_suppkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Microsoft' ELSE 'Google Cloud' END AS provider,
    CAST(DATE '2023-12-15' + CAST(l_orderkey % 46 AS INTEGER) AS DATE) AS day,
    CAST(round(l_extendedprice * l_discount, 4) AS DECIMAL(38,9)) AS gross,
    CAST(round(l_extendedprice, 2) AS DECIMAL(38,9)) AS listed,
    CASE WHEN l_linenumber = 5 THEN CAST(0 AS DECIMAL(38,9))
         ELSE CAST(-round(l_extendedprice * l_discount * l_tax, 6) AS DECIMAL(38,9)) END AS credit,
    l_linenumber % 4 AS tagging
  FROM lineitem
),
charge AS (
  SELECT *,
    CAST(date_trunc('month', day) AS DATE) AS month,
    CASE WHEN provider = 'Google Cloud' THEN CAST(gross + credit AS DECIMAL(38,9)) ELSE gross END AS billed,
    CASE provider
      WHEN 'AWS' THEN {_pick('l_partkey % 5', ('Amazon Elastic Container Service', 'Amazon Virtual Private Cloud', 'Elastic Load Balancing', 'Amazon Simple Storage Service', 'Amazon EC2'))}
      WHEN 'Microsoft' THEN {_pick('l_partkey % 5', ('Container Registry', 'Azure Container Apps', 'Bandwidth', 'Storage', 'Log Analytics'))}
      ELSE {_pick('l_partkey % 5', ('Cloud Monitoring', 'Cloud Run', 'Cloud Logging', 'Artifact Registry', 'BigQuery'))}
    END AS service,
    CASE
      WHEN provider = 'Google Cloud' THEN NULL
      WHEN provider = 'Microsoft' AND l_linenumber = 7 THEN NULL
      WHEN tagging IN (1, 3) THEN 'platform-one'
      WHEN tagging = 2 THEN 'other-app'
    END AS project,
    CASE
      WHEN provider = 'Google Cloud' THEN
        CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 THEN 'sandbox'
             WHEN tagging = 1 THEN 'gcp' WHEN tagging = 2 THEN 'hub' END
      WHEN tagging = 1 AND provider = 'AWS' THEN 'aws'
      WHEN tagging = 1 THEN 'azure'
    END AS label
  FROM bill
)"""

# Charges with their estate and how it was found; outside charges have no estate.
ASSIGNED = BILL + """,
assigned AS (
  SELECT *,
    CASE provider
      WHEN 'AWS' THEN CASE
        WHEN project = 'platform-one' THEN 'aws'
        WHEN project IS NULL AND l_partkey % 5 IN (0, 1, 2) THEN 'aws' END
      WHEN 'Microsoft' THEN CASE WHEN project = 'platform-one' THEN 'azure' END
      ELSE CASE WHEN l_orderkey % 5 <> 0 THEN coalesce(label, 'hub') END
    END AS estate,
    CASE WHEN provider = 'AWS' AND project IS NULL THEN 'inferred'
         WHEN provider = 'Google Cloud' AND label IS NULL THEN 'project'
         ELSE 'tagged' END AS basis
  FROM charge
)"""

# Requests with the labels telemetry gives them.
REQ = """
req AS (
  SELECT event_id, ts, value, event_type, user_id,
    CASE user_id % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS cloud,
    CASE WHEN event_type IN ('view', 'error') THEN '/flaky' WHEN event_type = 'purchase' THEN 'unmatched' ELSE '/' END AS route,
    CASE WHEN event_type = 'error' THEN '500' WHEN event_type = 'purchase' THEN '404' ELSE '200' END AS status,
    value / 1000 AS seconds,
    CAST(ts AS DATE) AS day
  FROM events
)"""

RUNS = REQ + """,
runs AS (
  SELECT CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS run_id, cloud,
    count(*) AS sent, count(*) FILTER (event_type <> 'error') AS ok,
    CAST(date_trunc('hour', ts) AS TIMESTAMP) AS run_at
  FROM req GROUP BY date_trunc('hour', ts), cloud
)"""

# Unit cost per estate and day. The ratio is rounded to nine places before the
# multiplication, as money is, so it is worked out in whole numbers.
UNIT = ASSIGNED + "," + RUNS + """,
per_estate AS (SELECT CAST(run_at AS DATE) AS day, cloud AS estate, CAST(sum(ok) AS BIGINT) AS requests FROM runs GROUP BY 1, 2),
per_day AS (SELECT day, CAST(sum(requests) AS BIGINT) AS requests FROM per_estate GROUP BY 1),
spent AS (
  SELECT day, estate, sum(billed) AS cost,
    sum(CASE WHEN basis = 'tagged' THEN billed ELSE 0 END) AS tagged_cost,
    sum(CASE WHEN basis = 'inferred' THEN billed ELSE 0 END) AS inferred_cost,
    sum(CASE WHEN basis = 'project' THEN billed ELSE 0 END) AS project_cost
  FROM assigned WHERE day >= DATE '2024-01-01' AND estate IS NOT NULL GROUP BY 1, 2
),
matched AS (
  SELECT s.*, CASE WHEN s.estate = 'hub' THEN d.requests ELSE e.requests END AS requests
  FROM spent s LEFT JOIN per_estate e ON s.day = e.day AND s.estate = e.estate
  LEFT JOIN per_day d ON s.day = d.day
),
nanos AS (
  SELECT *, CAST(cost * 1000000000 AS HUGEINT) AS n FROM matched
),
ratio AS (
  SELECT *, CASE WHEN requests > 0 THEN sign(n) * ((2 * abs(n) + requests) // (2 * requests)) END AS r FROM nanos
),
unit AS (
  SELECT day, estate, round(cost, 4) AS cost, round(tagged_cost, 4) AS tagged_cost,
    round(inferred_cost, 4) AS inferred_cost, round(project_cost, 4) AS project_cost, requests,
    CAST(sign(r) * ((abs(r) * 1000 + 50000) // 100000) AS DOUBLE) / 10000 AS cost_per_1000_requests
  FROM ratio
)"""


def dbl(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Money as a double, exact at the digits given."""
    return f"CAST(round({expr}, {digits}) AS DOUBLE) AS {name or expr}"
