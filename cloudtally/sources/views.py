"""The reporting views, created over raw tables that exist.

Views are temporary and logical: nothing is stored, every query reads the raw
tables again. Parameters are values of the plan, never text put into SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from cloudtally.operators import cost, focus, reconcile
from cloudtally.operators.cost import Platform

RAW_TABLES = ("aws_focus", "azure_actual", "gcp_focus", "gcp_detailed", "load_runs")


class MissingTables(ValueError):
    """Views were asked for before the raw tables they read were loaded."""


def require_tables(spark: SparkSession, names: tuple[str, ...] = RAW_TABLES) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise MissingTables("load these tables before creating views: " + ", ".join(missing))


def create_views(spark: SparkSession, start: date, platform: Platform) -> None:
    """Register the three bills, their union, reconciliation and unit cost."""
    require_tables(spark)
    raw = {name: spark.table(name) for name in RAW_TABLES}
    aws, gcp = focus.focus_aws(raw["aws_focus"]), focus.focus_gcp(raw["gcp_focus"])
    azure = focus.focus_azure(raw["azure_actual"])
    stacked = focus.focus_all(aws, gcp, azure)
    report = reconcile.reconcile(
        reconcile.pipeline_totals(stacked),
        reconcile.aws_source_totals(raw["aws_focus"]),
        reconcile.azure_source_totals(raw["azure_actual"]),
        reconcile.gcp_source_totals(raw["gcp_detailed"]),
    )
    recent = focus.focus_since(raw["aws_focus"], raw["azure_actual"], raw["gcp_focus"], start)
    views = {
        "focus_aws": aws,
        "focus_gcp": gcp,
        "focus_azure": azure,
        "focus_all": stacked,
        "reconciliation": report,
        "unit_cost": cost.unit_cost(recent, raw["load_runs"], start, platform),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)


def recent_unit_cost(spark: SparkSession, as_of: date, start: date, platform: Platform, days: int = 7) -> DataFrame:
    """The runbook's first query. Only the months and requests of its days are read."""
    since = cost.report_start(as_of, days, start)
    bills = focus.focus_since(*[spark.table(t) for t in ("aws_focus", "azure_actual", "gcp_focus")], since)
    return cost.recent_unit_cost(cost.unit_cost(bills, spark.table("load_runs"), since, platform), as_of, days)


def recent_spend(spark: SparkSession, as_of: date, days: int = 7, above: float = 0.01) -> DataFrame:
    """The runbook's second query: the same days by provider, service and project tag."""
    bills = focus.focus_since(*[spark.table(t) for t in ("aws_focus", "azure_actual", "gcp_focus")], cost.report_start(as_of, days))
    return cost.recent_spend(bills, as_of, days, above)
