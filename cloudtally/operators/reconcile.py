"""The pipeline's totals next to totals from a second source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.functions.dates import invoice_month, month_of, us_date
from cloudtally.functions.money import float_total
from cloudtally.operators.focus import AWS, GOOGLE, MICROSOFT

# How each source is named in the report.
AWS_SOURCE = "AWS FOCUS export as loaded"
AZURE_SOURCE = "Azure actual cost export as loaded"
GCP_SOURCE = "GCP detailed usage export, cost plus credits"

_KEYS = ["ProviderName", "billing_month"]


def pipeline_totals(focus: DataFrame) -> DataFrame:
    return focus.groupBy("ProviderName", F.to_date("BillingPeriodStart").alias("billing_month")).agg(
        F.sum("BilledCost").alias("pipeline_billed")
    )


def _source(totals: DataFrame, provider: str, name: str) -> DataFrame:
    return totals.select(
        F.lit(provider).alias("ProviderName"), "billing_month", "source_billed", F.lit(name).alias("source_name")
    )


def aws_source_totals(raw: DataFrame) -> DataFrame:
    totals = raw.groupBy(F.to_date("BillingPeriodStart").alias("billing_month")).agg(
        float_total(F.col("BilledCost")).alias("source_billed")
    )
    return _source(totals, AWS, AWS_SOURCE)


def azure_source_totals(raw: DataFrame) -> DataFrame:
    totals = raw.groupBy(month_of(us_date(F.col("date"))).alias("billing_month")).agg(
        float_total(F.col("costInBillingCurrency").cast("double")).alias("source_billed")
    )
    return _source(totals, MICROSOFT, AZURE_SOURCE)


def gcp_source_totals(detailed: DataFrame) -> DataFrame:
    """Cost plus credits, from an export the pipeline itself does not read."""
    exact = "decimal(38,15)"
    credits = F.aggregate(
        F.coalesce(F.col("credits.amount"), F.array().cast("array<double>")),
        F.lit(0).cast(exact),
        lambda total, amount: (total + F.coalesce(amount, F.lit(0.0)).cast(exact)).cast(exact),
    )
    totals = detailed.groupBy(invoice_month(F.col("invoice.month")).alias("billing_month")).agg(
        (F.sum(F.col("cost").cast(exact)) + F.sum(credits)).cast("decimal(38,9)").alias("source_billed")
    )
    return _source(totals, GOOGLE, GCP_SOURCE)


def reconcile(pipeline: DataFrame, *sources: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Totals side by side for each provider and month, and their difference.

    A full join, so a month only one side has shows up with a NULL rather than
    disappearing. With ``tolerance`` a column says whether the row agrees; a
    one-sided row never does.
    """
    source = reduce(DataFrame.unionByName, sources)
    report = pipeline.join(source, _KEYS, "full").select(
        *_KEYS,
        F.round("pipeline_billed", 6).alias("pipeline_billed"),
        F.round("source_billed", 6).alias("source_billed"),
        F.round(F.col("pipeline_billed") - F.col("source_billed"), 6).alias("difference"),
        "source_name",
    )
    if tolerance is None:
        return report
    return report.withColumn(
        "agrees", F.coalesce(F.abs("difference") <= F.lit(tolerance).cast("decimal(38,9)"), F.lit(False))
    )


def compare_request_counts(load_runs_daily: DataFrame, telemetry_daily: DataFrame) -> DataFrame:
    """Two request counts per day and cloud: what the load sent, what telemetry stored."""
    sent = load_runs_daily.select("day", "cloud", F.col("requests").cast("double").alias("load_requests"))
    stored = telemetry_daily.select("day", "cloud", F.col("requests").cast("double").alias("telemetry_requests"))
    gap = F.col("telemetry_requests") - F.col("load_requests")
    return sent.join(stored, ["day", "cloud"], "full").withColumns(
        {
            "difference": gap,
            "status": F.when(F.col("load_requests").isNull(), "telemetry only")
            .when(F.col("telemetry_requests").isNull(), "load only")
            .when(gap == 0, "same")
            .when(gap < 0, "short")
            .otherwise("over"),
        }
    )
