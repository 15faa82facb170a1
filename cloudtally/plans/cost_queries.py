"""Registered queries for bills, attribution, unit cost and reconciliation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.functions.tags import tags_as_text
from cloudtally.operators import cost, focus, reconcile
from cloudtally.plans import derived as d
from cloudtally.plans.oracle_parts import ASSIGNED, BILL, REQ, RUNS, UNIT, dbl

S = SparkSession


def flat_money(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).cast("double").alias(c)


def stacked(spark: S, sf: str) -> DataFrame:
    return focus.focus_all(
        focus.focus_aws(d.aws_bill(spark, sf)),
        focus.focus_gcp(d.gcp_bill(spark, sf)),
        focus.focus_azure(d.azure_bill(spark, sf)),
    )


def pruned(spark: S, sf: str) -> DataFrame:
    return focus.focus_since(d.aws_bill(spark, sf), d.azure_bill(spark, sf), d.gcp_bill(spark, sf), d.START)


def attributed(spark: S, sf: str) -> DataFrame:
    return cost.attribute(cost.charges_since(pruned(spark, sf), d.START), d.PLATFORM)


def unit(spark: S, sf: str, places: int | None = 4) -> DataFrame:
    return cost.unit_cost(pruned(spark, sf), d.load_runs(spark, sf), d.START, d.PLATFORM, places)


def bills(spark: S, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return d.aws_bill(spark, sf), d.azure_bill(spark, sf), d.gcp_bill(spark, sf)


def _flat_bill(bill: DataFrame) -> DataFrame:
    """All 18 columns, money and tags flattened, so rows can be compared one by one."""
    stamps = ("BillingPeriodStart", "ChargePeriodStart", "ChargePeriodEnd")
    return bill.withColumns(
        {
            **{c: F.col(c).cast("timestamp_ntz") for c in stamps},
            **{c: F.round(c, 6).cast("double") for c in ("BilledCost", "EffectiveCost", "ListCost")},
            "Tags": tags_as_text(F.col("Tags")),
        }
    )


_FLAT_COLUMNS = """
  SELECT provider AS "ProviderName", {account} AS "BillingAccountId", {sub} AS "SubAccountId", {sub_name} AS "SubAccountName",
    CAST(month AS TIMESTAMP) AS "BillingPeriodStart", CAST(day AS TIMESTAMP) AS "ChargePeriodStart",
    CAST(day + 1 AS TIMESTAMP) AS "ChargePeriodEnd", {category} AS "ChargeCategory", 'USD' AS "BillingCurrency",
    CAST(round(billed, 6) AS DOUBLE) AS "BilledCost", CAST(round(billed, 6) AS DOUBLE) AS "EffectiveCost",
    CAST(round(listed, 6) AS DOUBLE) AS "ListCost", service AS "ServiceName", {service_category} AS "ServiceCategory",
    l_linestatus AS "RegionId", {resource} AS "ResourceId", {resource_name} AS "ResourceName", {tags} AS "Tags"
  FROM charge WHERE provider = '{provider}'"""

_AWS_FLAT = _FLAT_COLUMNS.format(
    provider="AWS", account="'payer-1'", sub="'acct-' || l_suppkey", sub_name="'lab'", category="'Usage'",
    service_category="'Compute'", resource="'arn:' || l_partkey", resource_name="'res-' || l_partkey",
    tags="CASE tagging WHEN 1 THEN 'estate=aws,project=platform-one' WHEN 2 THEN 'project=other-app' "
         "WHEN 3 THEN 'project=platform-one' ELSE '' END")
_AZURE_FLAT = _FLAT_COLUMNS.format(
    provider="Microsoft", account="'bill-1'", sub="'sub-' || l_suppkey",
    sub_name="CASE WHEN l_linenumber = 1 THEN 'lab \"one\"' || chr(10) || 'second line' ELSE 'lab, main' END",
    category="CASE WHEN l_linenumber IN (6, 7) THEN 'Adjustment' WHEN l_returnflag = 'A' THEN 'Usage' "
             "WHEN l_returnflag = 'N' THEN 'Purchase' ELSE 'Credit' END",
    service_category="CAST(NULL AS VARCHAR)",
    resource="'/subscriptions/s/resourceGroups/rg/' || CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'item-' || l_partkey END",
    resource_name="CASE WHEN l_partkey % 7 <> 0 THEN 'item-' || l_partkey END",
    tags="CASE WHEN l_linenumber = 7 THEN '' WHEN tagging = 1 THEN 'cost-code=,estate=azure,project=platform-one' "
         "WHEN tagging = 2 THEN 'project=other-app' WHEN tagging = 3 THEN 'project=platform-one' ELSE '' END")
_GCP_FLAT = _FLAT_COLUMNS.format(
    provider="Google Cloud", account="'bill-2'",
    sub="CASE WHEN l_orderkey % 5 = 0 THEN 'other-project' ELSE 'host-project' END", sub_name="'lab'",
    category="'Usage'", service_category="CAST(NULL AS VARCHAR)", resource="'//run/' || l_partkey",
    resource_name="'res-' || l_partkey",
    tags="CASE WHEN l_linenumber = 6 THEN 'env=shared,managed-by=terraform,owner=platform' "
         "WHEN l_linenumber = 5 THEN 'env=prod,estate=sandbox,managed-by=terraform,owner=platform' "
         "WHEN tagging = 1 THEN 'env=prod,estate=gcp,managed-by=terraform,owner=platform' "
         "WHEN tagging = 2 THEN 'env=shared,estate=hub,managed-by=terraform,owner=platform,team=core' "
         "WHEN tagging = 3 THEN 'env=shared,managed-by=terraform,owner=ops' "
         "ELSE 'env=shared,managed-by=terraform,owner=platform' END")


def _unit_out(df: DataFrame) -> DataFrame:
    money = ("cost", "tagged_cost", "inferred_cost", "project_cost", "cost_per_1000_requests")
    return df.select("day", "estate", *[flat_money(c, 4) for c in money[:4]], "requests", flat_money(money[4], 4))


_UNIT_SELECT = "SELECT day, estate, " + ", ".join(
    dbl(c, digits=4) for c in ("cost", "tagged_cost", "inferred_cost", "project_cost")
) + ", requests, cost_per_1000_requests FROM unit"


def focus_all_summary(spark: S, sf: str) -> DataFrame:
    return (
        stacked(spark, sf)
        .groupBy("ProviderName", "ChargeCategory", F.to_date("BillingPeriodStart").alias("billing_month"))
        .agg(
            F.count(F.lit(1)).alias("charges"),
            F.sum("BilledCost").alias("billed"),
            F.sum("ListCost").alias("listed"),
            F.sum(F.size("Tags")).alias("tags"),
            F.count("ResourceName").alias("named"),
        )
        .withColumns({"billed": flat_money("billed"), "listed": flat_money("listed")})
    )


def azure_lenient_tags(spark: S, sf: str) -> DataFrame:
    """Tag text read as JSON: spaces and non-text values are kept too."""
    return (
        focus.focus_azure(d.azure_bill(spark, sf), lenient_tags=True)
        .groupBy(tags_as_text(F.col("Tags")).alias("tags"))
        .agg(F.count(F.lit(1)).alias("charges"))
    )


def attribution_rules(spark: S, sf: str) -> DataFrame:
    """Estate and basis over every charge, outside ones included."""
    return (
        cost.attribute(cost.charges_since(stacked(spark, sf)), d.PLATFORM)
        .groupBy("ProviderName", "estate", "basis", "project_tag", "estate_tag")
        .agg(F.count(F.lit(1)).alias("charges"), F.sum("BilledCost").alias("cost"))
        .withColumn("cost", flat_money("cost"))
    )


def daily_cost(spark: S, sf: str) -> DataFrame:
    money = ("cost", "tagged_cost", "inferred_cost", "project_cost")
    return cost.daily_cost(attributed(spark, sf)).withColumns({c: flat_money(c) for c in money})


def denominators(spark: S, sf: str) -> DataFrame:
    return cost.denominators(d.load_runs(spark, sf))


def platform_requests(spark: S, sf: str) -> DataFrame:
    return cost.platform_requests(d.load_runs(spark, sf))


def unit_cost(spark: S, sf: str) -> DataFrame:
    return _unit_out(unit(spark, sf))


def recent_unit_cost(spark: S, sf: str) -> DataFrame:
    since = cost.report_start(d.AS_OF, start=d.START)
    made = cost.unit_cost(focus.focus_since(*bills(spark, sf), since), d.load_runs(spark, sf), since, d.PLATFORM)
    return _unit_out(cost.recent_unit_cost(made, d.AS_OF))


def outside_charges(spark: S, sf: str) -> DataFrame:
    return cost.outside_charges(pruned(spark, sf), d.START, d.PLATFORM).withColumn("cost", flat_money("cost"))


def cost_conservation(spark: S, sf: str) -> DataFrame:
    """Attributed + outside + before the start must equal everything billed."""
    platform = cost.attribute(cost.charges_since(stacked(spark, sf)), d.PLATFORM)
    part = (
        F.when(F.col("day") < F.lit(d.START), "before start")
        .when(F.col("estate").isNull(), "outside")
        .otherwise("platform")
    )
    return (
        platform.groupBy(part.alias("part"))
        .agg(F.sum("BilledCost").alias("billed"), F.count(F.lit(1)).alias("charges"))
        .rollup("part")
        .agg(F.sum("billed").alias("billed"), F.sum("charges").alias("charges"))
        .select(F.coalesce("part", F.lit("pipeline")).alias("part"), flat_money("billed"), "charges")
    )


def recent_spend(spark: S, sf: str) -> DataFrame:
    recent = focus.focus_since(*bills(spark, sf), cost.report_start(d.AS_OF))
    return cost.recent_spend(recent, d.AS_OF, above=1000.0).withColumn("cost", flat_money("cost", 4))


def spend_to_date(spark: S, sf: str) -> DataFrame:
    return cost.spend_to_date(focus.billed_in(*bills(spark, sf), d.START), d.START).withColumn("billed", flat_money("billed", 4))


def tag_coverage(spark: S, sf: str) -> DataFrame:
    return cost.tag_coverage(cost.daily_cost(attributed(spark, sf))).withColumns(
        {"cost": flat_money("cost"), "tagged_cost": flat_money("tagged_cost")}
    )


def full_day_summary(spark: S, sf: str) -> DataFrame:
    summary = cost.full_day_summary(unit(spark, sf, places=None), date(2024, 1, 2), date(2024, 1, 28))
    return summary.select(
        "estate", "days", *[flat_money(c, 4) for c in ("lowest_unit_cost", "highest_unit_cost")],
        F.round(F.col("cost_per_day").cast("double"), 2).alias("cost_per_day"),
        F.round(F.col("thirty_days").cast("double"), 0).alias("thirty_days"),
    )


def provider_totals(spark: S, sf: str) -> DataFrame:
    return cost.provider_totals(stacked(spark, sf)).withColumn("billed", flat_money("billed"))


def estate_makeup(spark: S, sf: str) -> DataFrame:
    return cost.estate_makeup(attributed(spark, sf)).withColumn("cost", flat_money("cost"))


def reconciliation(spark: S, sf: str) -> DataFrame:
    report = reconcile.reconcile(
        reconcile.pipeline_totals(stacked(spark, sf)),
        reconcile.aws_source_totals(d.aws_bill(spark, sf)),
        reconcile.azure_source_totals(d.azure_bill(spark, sf)),
        reconcile.gcp_source_totals(d.gcp_detailed(spark, sf)),
        tolerance=0.01,
    )
    return report.withColumns({c: flat_money(c) for c in ("pipeline_billed", "source_billed", "difference")})


def reconciliation_one_sided(spark: S, sf: str) -> DataFrame:
    """Only one source given, so the other providers' months stay one-sided."""
    report = reconcile.reconcile(
        reconcile.pipeline_totals(focus.focus_gcp(d.gcp_bill(spark, sf))),
        reconcile.aws_source_totals(d.aws_bill(spark, sf)),
        tolerance=0.01,
    )
    return report.withColumns({c: flat_money(c) for c in ("pipeline_billed", "source_billed", "difference")})


QUERIES = {
    "focus_aws": lambda s, p: _flat_bill(focus.focus_aws(d.aws_bill(s, p))),
    "focus_azure": lambda s, p: _flat_bill(focus.focus_azure(d.azure_bill(s, p))),
    "focus_gcp": lambda s, p: _flat_bill(focus.focus_gcp(d.gcp_bill(s, p))),
    "focus_all_summary": focus_all_summary,
    "azure_lenient_tags": azure_lenient_tags,
    "attribution_rules": attribution_rules,
    "daily_cost": daily_cost,
    "request_denominators": denominators,
    "platform_requests": platform_requests,
    "unit_cost": unit_cost,
    "recent_unit_cost": recent_unit_cost,
    "outside_charges": outside_charges,
    "cost_conservation": cost_conservation,
    "recent_spend": recent_spend,
    "spend_to_date": spend_to_date,
    "tag_coverage": tag_coverage,
    "full_day_summary": full_day_summary,
    "provider_totals": provider_totals,
    "estate_makeup": estate_makeup,
    "reconciliation": reconciliation,
    "reconciliation_one_sided": reconciliation_one_sided,
}

_SOURCES = """,
side AS (
  SELECT provider, month, sum(billed) AS pipeline_billed,
    CASE WHEN provider = 'Google Cloud' THEN sum(CASE WHEN l_orderkey % 997 <> 0 THEN billed END) ELSE sum(gross) END AS source_billed
  FROM charge GROUP BY 1, 2
)"""

ORACLE = {
    "focus_aws": f"WITH {BILL} {_AWS_FLAT}",
    "focus_azure": f"WITH {BILL} {_AZURE_FLAT}",
    "focus_gcp": f"WITH {BILL} {_GCP_FLAT}",
    "focus_all_summary": f"""WITH {BILL},
      f AS ({_AWS_FLAT} UNION ALL {_AZURE_FLAT} UNION ALL {_GCP_FLAT})
      SELECT "ProviderName", "ChargeCategory", CAST("BillingPeriodStart" AS DATE) AS billing_month, count(*) AS charges,
        CAST(sum(CAST("BilledCost" AS DECIMAL(38,6))) AS DOUBLE) AS billed,
        CAST(sum(CAST("ListCost" AS DECIMAL(38,6))) AS DOUBLE) AS listed,
        CAST(sum(CASE WHEN "Tags" = '' THEN 0 ELSE length("Tags") - length(replace("Tags", ',', '')) + 1 END) AS BIGINT) AS tags,
        count("ResourceName") AS named
      FROM f GROUP BY 1, 2, 3""",
    "azure_lenient_tags": f"""WITH {BILL} SELECT
        CASE WHEN l_linenumber = 7 THEN 'project=platform-one' WHEN tagging = 1 THEN 'cost-code=,estate=azure,project=platform-one'
             WHEN tagging = 2 THEN 'project=other-app' WHEN tagging = 3 THEN 'count=3,project=platform-one' ELSE '' END AS tags,
        count(*) AS charges FROM charge WHERE provider = 'Microsoft' GROUP BY 1""",
    "attribution_rules": f"""WITH {ASSIGNED} SELECT provider AS "ProviderName", estate, basis, project AS project_tag,
        label AS estate_tag, count(*) AS charges, {dbl('sum(billed)', 'cost')} FROM assigned GROUP BY 1, 2, 3, 4, 5""",
    "daily_cost": f"""WITH {UNIT} SELECT day, estate, {dbl('cost')}, {dbl('tagged_cost')}, {dbl('inferred_cost')},
        {dbl('project_cost')} FROM spent""",
    "request_denominators": f"""WITH {RUNS} SELECT CAST(run_at AS DATE) AS day, cloud AS estate, CAST(sum(ok) AS BIGINT) AS requests
        FROM runs GROUP BY 1, 2 UNION ALL SELECT CAST(run_at AS DATE), 'hub', CAST(sum(ok) AS BIGINT) FROM runs GROUP BY 1""",
    "platform_requests": f"""WITH {REQ} SELECT day, count(*) AS requests FROM req WHERE event_type <> 'error' GROUP BY 1""",
    "unit_cost": f"WITH {UNIT} {_UNIT_SELECT}",
    "recent_unit_cost": f"WITH {UNIT} {_UNIT_SELECT} WHERE day >= DATE '2024-01-23'",
    "outside_charges": f"""WITH {ASSIGNED} SELECT provider AS "ProviderName", service AS "ServiceName", project,
        {dbl('sum(billed)', 'cost')}, count(*) AS charges
        FROM assigned WHERE day >= DATE '2024-01-01' AND estate IS NULL GROUP BY 1, 2, 3""",
    "cost_conservation": f"""WITH {ASSIGNED},
      p AS (SELECT CASE WHEN day < DATE '2024-01-01' THEN 'before start' WHEN estate IS NULL THEN 'outside' ELSE 'platform' END AS part,
              billed FROM assigned)
      SELECT part, {dbl('sum(billed)', 'billed')}, count(*) AS charges FROM p GROUP BY 1
      UNION ALL SELECT 'pipeline', {dbl('sum(billed)', 'billed')}, count(*) FROM p""",
    "recent_spend": f"""WITH {ASSIGNED} SELECT day, provider AS "ProviderName", service AS "ServiceName", project,
        {dbl('sum(billed)', 'cost', 4)} FROM assigned WHERE day >= DATE '2024-01-23' GROUP BY 1, 2, 3, 4
        HAVING round(sum(billed), 4) > 1000""",
    "spend_to_date": f"""WITH {ASSIGNED} SELECT provider AS "ProviderName", project, label AS estate, service AS "ServiceName",
        {dbl('sum(billed)', 'billed', 4)} FROM assigned WHERE month = DATE '2024-01-01' GROUP BY 1, 2, 3, 4
        HAVING round(sum(billed), 4) > 0.001""",
    "tag_coverage": f"""WITH {UNIT} SELECT estate, {dbl('sum(cost)', 'cost')}, {dbl('sum(tagged_cost)', 'tagged_cost')},
        round(CAST(sum(tagged_cost) AS DOUBLE) / nullif(CAST(sum(cost) AS DOUBLE), 0), 4) AS coverage FROM spent GROUP BY 1""",
    "full_day_summary": f"""WITH {UNIT} SELECT estate, count(*) AS days,
        min(cost_per_1000_requests) AS lowest_unit_cost, max(cost_per_1000_requests) AS highest_unit_cost,
        round(CAST(sum(s.cost) AS DOUBLE) / 27, 2) AS cost_per_day,
        round(CAST(sum(s.cost) AS DOUBLE) / 27 * 30, 0) AS thirty_days
        FROM unit JOIN spent s USING (day, estate) WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' GROUP BY 1""",
    "provider_totals": f"""WITH {BILL} SELECT provider AS "ProviderName", {dbl('sum(billed)', 'billed')} FROM charge GROUP BY 1
        UNION ALL SELECT 'all', {dbl('sum(billed)', 'billed')} FROM charge""",
    "estate_makeup": f"""WITH {ASSIGNED},
      s AS (SELECT estate, service, sum(billed) AS cost FROM assigned WHERE estate IS NOT NULL AND day >= DATE '2024-01-01' GROUP BY 1, 2),
      t AS (SELECT estate, sum(cost) AS whole FROM s GROUP BY 1)
      SELECT s.estate, s.service AS "ServiceName", {dbl('s.cost', 'cost')},
        round(CAST(s.cost AS DOUBLE) / CAST(t.whole AS DOUBLE), 4) AS share FROM s JOIN t ON s.estate = t.estate""",
    "reconciliation": f"""WITH {BILL} {_SOURCES} SELECT provider AS "ProviderName", month AS billing_month,
        {dbl('pipeline_billed')}, {dbl('source_billed')}, {dbl('pipeline_billed - source_billed', 'difference')},
        CASE provider WHEN 'AWS' THEN 'AWS FOCUS export as loaded' WHEN 'Microsoft' THEN 'Azure actual cost export as loaded'
          ELSE 'GCP detailed usage export, cost plus credits' END AS source_name,
        abs(round(pipeline_billed - source_billed, 6)) <= 0.01 AS agrees
        FROM side""",
    "reconciliation_one_sided": f"""WITH {BILL} {_SOURCES} SELECT provider AS "ProviderName", month AS billing_month,
        CASE WHEN provider <> 'AWS' THEN CAST(round(pipeline_billed, 6) AS DOUBLE) END AS pipeline_billed,
        CASE WHEN provider = 'AWS' THEN CAST(round(source_billed, 6) AS DOUBLE) END AS source_billed,
        CAST(NULL AS DOUBLE) AS difference, CASE WHEN provider = 'AWS' THEN 'AWS FOCUS export as loaded' END AS source_name,
        false AS agrees
        FROM side WHERE provider <> 'Microsoft'""",
}
