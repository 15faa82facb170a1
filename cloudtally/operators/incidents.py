"""Alert conditions, holding before firing, and incidents, replayed over history.

A condition returns a row per (policy, cloud) and evaluation it is true for.
An empty range returns no row, so missing data never breaches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.operators import metrics

KEYS = ("policy", "cloud")


@dataclass(frozen=True)
class AlertRules:
    """Thresholds and timing. The values given here are the fixed defaults."""

    error_ratio: float = 0.1
    latency_s: float = 1.0
    range_s: int = 300
    every_s: int = 60
    hold_s: int = 60
    close_after_s: int = 1800
    floor_rate: float = 0.05  # 15 requests in five minutes


def busy_enough(deltas: DataFrame, rules: AlertRules) -> DataFrame:
    """Evaluations at which a cloud's served traffic is over the floor."""
    return metrics.above(metrics.request_rate(deltas, rules.range_s, rules.every_s), rules.floor_rate)


def error_breaches(deltas: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """Share of server errors over its threshold, on clouds with enough traffic.

    Ratio and traffic come out of the same sums: one pass, no join.
    """
    sums = metrics.errors_and_total(deltas, rules.range_s, rules.every_s)
    ratio = F.try_divide("errors", "total")
    return (
        sums.filter(F.col("total") / F.lit(float(rules.range_s)) > F.lit(rules.floor_rate))
        .select(F.lit("error ratio").alias("policy"), "cloud", "eval_ts", ratio.alias("value"))
        .filter(F.col("value") > F.lit(rules.error_ratio))
    )


def latency_breaches(bucket_deltas: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """95th percentile over its threshold, on clouds with enough traffic.

    The histogram counts every request in its last bucket, so the traffic comes
    out of the same sums: one pass, no join.
    """
    slow = metrics.latency_quantile(bucket_deltas, 0.95, rules.range_s, rules.every_s, total="total")
    busy = F.col("total") / F.lit(float(rules.range_s)) > F.lit(rules.floor_rate)
    return slow.filter(busy & (F.col("value") > F.lit(float(rules.latency_s)))).select(
        F.lit("p95 latency").alias("policy"), "cloud", "eval_ts", "value"
    )


def _seconds_since(later: str, earlier: str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000000)


def held(breaches: DataFrame, rules: AlertRules = AlertRules(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Evaluations at which the condition has been true, without a break, for the hold.

    ``since`` is when the unbroken run began. Rows here are evaluations, one
    per key and step whatever the traffic, so a window per key stays small.
    """
    order = Window.partitionBy(*keys).orderBy("eval_ts")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.lit(rules.every_s)
    return (
        breaches.withColumn("_prev", F.lag("eval_ts").over(order))
        .withColumn("_begin", F.when(F.col("_prev").isNull() | (_seconds_since("eval_ts", "_prev") > step), F.col("eval_ts")))
        .withColumn("since", F.last("_begin", ignorenulls=True).over(run))
        .filter(_seconds_since("eval_ts", "since") >= F.lit(rules.hold_s))
        .drop("_prev", "_begin")
    )


def incidents(
    breaches: DataFrame,
    rules: AlertRules = AlertRules(),
    as_of: datetime | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One incident per key and spell of firing.

    It opens when the hold is met and closes a set time after the last firing
    evaluation; firing again before that continues it. With ``as_of``, an
    incident that has not closed by then has no ``closed_at``.
    """
    order = Window.partitionBy(*keys).orderBy("eval_ts")
    numbered = (
        held(breaches, rules, keys)
        .withColumn("_prev", F.lag("eval_ts").over(order))
        .withColumn(
            "_new",
            (F.col("_prev").isNull() | (_seconds_since("eval_ts", "_prev") > F.lit(rules.close_after_s))).cast("int"),
        )
        .withColumn("incident", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    closing = F.col("last_firing") + F.make_dt_interval(secs=F.lit(rules.close_after_s))
    found = (
        numbered.groupBy(*keys, "incident")
        .agg(
            F.min("eval_ts").alias("opened_at"),
            F.max("eval_ts").alias("last_firing"),
            F.count(F.lit(1)).alias("evaluations"),
            F.max("value").alias("peak"),
        )
        .withColumn("closed_at", closing)
    )
    if as_of is None:
        return found
    now = F.lit(as_of).cast("timestamp")
    return found.withColumn("closed_at", F.when(F.col("closed_at") <= now, F.col("closed_at")))
