"""Queries over counter increments: rates, ratios, quantiles, look-back, gaps.

Input is the output of ``counter_deltas``: label columns, ``ts``, ``delta``.
An evaluation at ``eval_ts`` covers the range ending there, its start excluded
and its end included: a sample taken at the evaluation counts. Evaluations lie
on whole multiples of the step.
Increases are exact sums; nothing is extrapolated to the edges of a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.labels import join_same, matches, only_cloud, select_series
from cloudtally.operators.series import UNMATCHED

SERVED = ("route", "!=", UNMATCHED)
SERVER_ERROR = ("status", "=~", "5..")


def _over_range(rows: DataFrame, by: Sequence[str], column: str, fold, range_s: int, step_s: int | None) -> DataFrame:
    """Fold a column per label set over a range, at every step, which may be longer than the range.

    Rows are first folded per cell, the longest time that divides both, and the
    few cell results are spread over the ranges they belong to, so rows are not
    copied range/step times.
    """
    step_s = step_s or range_s
    cell, step, width = (x * 1000000 for x in (gcd(range_s, step_s), step_s, range_s))

    def up_to(micros: Column, size: int) -> Column:
        """The first multiple of ``size`` that is not earlier."""
        return F.ceil(micros / F.lit(size)).cast("long") * size

    cells = rows.groupBy(*by, up_to(F.unix_micros("ts"), cell).alias("_cell")).agg(fold(column).alias("value"))
    first = up_to(F.col("_cell"), step)
    last = F.col("_cell") + (width - cell)
    ends = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))
    if cell == step == width:
        return cells.select(*by, F.timestamp_micros("_cell").alias("eval_ts"), "value")
    spread = cells.select(*by, F.explode(ends).alias("_end"), "value")
    return spread.groupBy(*by, F.timestamp_micros("_end").alias("eval_ts")).agg(fold("value").alias("value"))


def increase(deltas: DataFrame, by: Sequence[str], range_s: int, step_s: int | None = None) -> DataFrame:
    """Sum of increments per label set over a range, at every step."""
    return _over_range(deltas, by, "delta", F.sum, range_s, step_s)


def rate(deltas: DataFrame, by: Sequence[str], range_s: int, step_s: int | None = None) -> DataFrame:
    """Increase per second."""
    return increase(deltas, by, range_s, step_s).withColumn("value", F.col("value") / F.lit(float(range_s)))


def sum_by(vector: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add up a vector's series over the labels not named, at each time."""
    return vector.groupBy(*by, "eval_ts").agg(F.sum("value").alias("value"))


def above(vector: DataFrame, threshold: float) -> DataFrame:
    """Keep the series over a threshold (strictly)."""
    return vector.filter(F.col("value") > F.lit(float(threshold)))


def vector_and(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left series whose labels and time also exist on the right; a missing label equals a missing one."""
    return join_same(left, right.select(*on, "eval_ts"), [*on, "eval_ts"], "left_semi")


def vector_or(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left series, and right series the left does not have."""
    return left.unionByName(join_same(right, left.select(*on, "eval_ts"), [*on, "eval_ts"], "left_anti"))


def histogram_quantile(
    q: float, buckets: DataFrame, by: Sequence[str], summed: bool = False, total: str | None = None
) -> DataFrame:
    """Quantile from cumulative bucket counts, interpolated inside the bucket.

    The first bucket starts at zero. A quantile that falls beyond the last
    finite bound is reported as that bound. No observations give NULL. The
    array holds one entry per bound of a group; ``summed`` says the input has
    one row per group and bound already. ``total`` names a column for the
    number of observations.
    """
    rows = buckets.select(*by, F.col("le").cast("double").alias("le"), "value")
    if not summed:
        rows = rows.groupBy(*by, "le").agg(F.sum("value").alias("value"))
    grouped = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("n")))).alias("_b")
    )
    return with_quantile(q, grouped, by, total)


def with_quantile(q: float, grouped: DataFrame, by: Sequence[str], total: str | None = None) -> DataFrame:
    """The quantile of each row's buckets, an array ``_b`` of bound and cumulative count in order."""
    count = F.get("_b", F.size("_b") - 1)["n"]
    rank = F.lit(float(q)) * F.col("_total")
    # Place of the first bucket that reaches the rank.
    place = F.size(F.filter("_b", lambda b: b["n"] < F.col("_rank")))
    start = F.when(F.col("_i") > 0, F.get("_b", F.col("_i") - 1)["le"]).otherwise(F.lit(0.0))
    below = F.when(F.col("_i") > 0, F.get("_b", F.col("_i") - 1)["n"]).otherwise(F.lit(0.0))
    end = F.get("_b", F.col("_i"))["le"]
    inside = F.get("_b", F.col("_i"))["n"] - below
    value = F.when(
        F.col("_total") > 0,
        F.when(end == F.lit(float("inf")), start).otherwise(
            start + (end - start) * F.try_divide(F.col("_rank") - below, inside)
        ),
    )
    return (
        grouped.withColumn("_total", count)
        .withColumn("_rank", rank)
        .withColumn("_i", place)
        .select(*by, value.alias("value"), *([F.col("_total").alias(total)] if total else []))
    )


def served(deltas: DataFrame, cloud: str | None = None) -> DataFrame:
    """Requests the app serves: scanner traffic left out."""
    return select_series(only_cloud(deltas, cloud), SERVED)


def errors_and_total(
    deltas: DataFrame, range_s: int, step_s: int | None = None, cloud: str | None = None
) -> DataFrame:
    """Server errors and all served requests per cloud, in one pass.

    ``errors`` is NULL where the range holds no sample of any 5xx series.
    """
    rows = served(deltas, cloud)
    split = rows.select("cloud", "ts", "delta", matches(rows, *SERVER_ERROR).alias("_bad"))
    sums = increase(split, ["cloud", "_bad"], range_s, step_s)
    return sums.groupBy("cloud", "eval_ts").agg(
        F.sum(F.when(F.col("_bad"), F.col("value"))).alias("errors"), F.sum("value").alias("total")
    )


def error_ratio(deltas: DataFrame, range_s: int = 300, step_s: int | None = None, cloud: str | None = None) -> DataFrame:
    """Server errors over served requests; a cloud with no 5xx series has no row."""
    both = errors_and_total(deltas, range_s, step_s, cloud).filter(F.col("errors").isNotNull())
    return both.select("cloud", "eval_ts", F.try_divide("errors", "total").alias("value"))


def error_ratio_or_zero(
    deltas: DataFrame, range_s: int = 300, step_s: int | None = None, cloud: str | None = None
) -> DataFrame:
    """The dashboard's ratio: a served cloud without errors reads zero."""
    both = errors_and_total(deltas, range_s, step_s, cloud)
    return both.select("cloud", "eval_ts", F.try_divide(F.coalesce("errors", F.lit(0.0)), F.col("total")).alias("value"))


def request_rate(deltas: DataFrame, range_s: int = 300, step_s: int | None = None, cloud: str | None = None) -> DataFrame:
    return rate(served(deltas, cloud), ["cloud"], range_s, step_s)


def latency_quantile(
    bucket_deltas: DataFrame,
    q: float = 0.95,
    range_s: int = 300,
    step_s: int | None = None,
    cloud: str | None = None,
    total: str | None = None,
) -> DataFrame:
    # Increases serve as well as rates: a quantile does not depend on the scale.
    per_bound = increase(served(bucket_deltas, cloud), ["cloud", "le"], range_s, step_s)
    return histogram_quantile(q, per_bound, ["cloud", "eval_ts"], summed=True, total=total)


def requests_per_hour(deltas: DataFrame, cloud: str | None = None) -> DataFrame:
    """By cloud, route and status; scanner traffic included."""
    return increase(only_cloud(deltas, cloud), ["cloud", "route", "status"], 3600)


def daily_requests(deltas: DataFrame, start: date, as_of: date) -> DataFrame:
    """Served requests per cloud for every closed UTC day from ``start`` on.

    One grouped scan recomputes all days, so a late sample is always counted. A
    day is evaluated at its end: what is scraped at midnight belongs to the day
    that ends there.
    """
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
    return (
        served(deltas)
        .filter((F.col("ts") > F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(as_of).cast("timestamp")))
        .groupBy(day.alias("day"), "cloud")
        .agg(F.sum("delta").alias("requests"))
    )


def daily_requests_report(daily: DataFrame) -> DataFrame:
    return daily.select("day", "cloud", F.round("requests").alias("requests")).orderBy("day", "cloud")


def instant_value(samples: DataFrame, series: Sequence[str], at: datetime, lookback_s: int = 300) -> DataFrame:
    """Last value of each series in the look-back before one moment."""
    end = F.lit(at).cast("timestamp")
    recent = (F.col("ts") > end - F.make_dt_interval(secs=F.lit(lookback_s))) & (F.col("ts") <= end)
    return samples.filter(recent).groupBy(*series).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def instant_values(samples: DataFrame, series: Sequence[str], step_s: int, lookback_s: int = 300) -> DataFrame:
    """The same at every step of a grid, for all series at once.

    A series keeps its last value for the whole look-back, stale or not. Only
    the last sample before each grid point is spread over the points it can
    reach, so this is an equi-group and not a range join.
    """
    step, reach = step_s * 1000000, lookback_s * 1000000
    micros = F.unix_micros("ts")
    first = F.ceil(micros / F.lit(step)).cast("long") * step
    cells = samples.groupBy(*series, first.alias("_at")).agg(
        F.max("ts").alias("_ts"), F.max_by("value", "ts").alias("_value")
    )
    last = F.unix_micros("_ts") + F.lit(reach - 1)
    points = F.when(last >= F.col("_at"), F.sequence(F.col("_at"), last, F.lit(step).cast("long")))
    spread = cells.select(*series, F.explode(points).alias("_at"), "_ts", "_value")
    return spread.groupBy(*series, F.timestamp_micros("_at").alias("eval_ts")).agg(
        F.max_by("_value", "_ts").alias("value")
    )


def value_at(
    instants: DataFrame, samples: DataFrame, series: Sequence[str], at: str = "at", lookback_s: int = 300, slices: int = 16
) -> DataFrame:
    """Every row of ``instants`` with the last ``value`` of its series at that moment, its ``ts``, and a ``state``.

    A sample counts for the whole look-back after it, the moment itself
    included and the far end not. ``state`` is ``fresh`` with such a sample,
    ``stale`` where the series had one before that, and ``missing`` where it
    had none yet. Equal times go by the higher value. A missing label equals a
    missing one; an instant without a time is ``missing``.

    Instants and samples are put in one order and the last sample is carried
    to the instants behind it. As none is carried further than the look-back,
    the order is cut into slices of ``slices`` look-backs: a sample near the end
    of one goes into the next as well, so a busy series is spread over tasks
    and nothing else has to pass between them.
    """
    keys = list(series)
    reach = lookback_s * 1_000_000
    width = F.lit(reach * slices)
    own = [c for c in instants.columns if c not in keys]
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    sample = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    asked = instants.select(
        *keys, micros.alias("_t"), F.lit(1).alias("_kind"), F.floor(micros / width).alias("_slice"),
        F.struct(*own).alias("_row"), F.lit(None).cast("struct<ts:timestamp,value:double>").alias("_sample"),
    )
    taken = F.unix_micros(F.col("ts").cast("timestamp"))
    reached = F.array_distinct(F.array(F.floor(taken / width), F.floor((taken + reach - 1) / width)))
    seen = samples.filter("ts IS NOT NULL AND value IS NOT NULL").select(
        *keys, taken.alias("_t"), F.lit(0).alias("_kind"), F.explode(reached).alias("_slice"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), sample.alias("_sample"),
    )
    order = Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind", "_sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = asked.unionByName(seen).withColumn("_last", F.last("_sample", ignorenulls=True).over(order)).filter("_kind = 1")
    near = F.col("_t") - F.unix_micros("_last.ts") < F.lit(reach)
    first = samples.filter("ts IS NOT NULL AND value IS NOT NULL").groupBy(*keys).agg(F.min(taken).alias("_first"))
    placed = join_same(carried, first, keys, "left")
    state = F.when(near, "fresh").when(F.col("_first") <= F.col("_t"), "stale").otherwise("missing")
    return placed.select(
        *keys, *[F.col("_row")[c].alias(c) for c in own],
        F.when(near, F.col("_last.value")).alias("value"), F.when(near, F.col("_last.ts")).alias("ts"), state.alias("state"),
    )


def max_over_time(samples: DataFrame, by: Sequence[str], range_s: int, step_s: int | None = None) -> DataFrame:
    """Highest raw value per label set over a range."""
    return _over_range(samples, by, "value", F.max, range_s, step_s)


def telemetry_gaps(load_runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Hours in which the load was served by a cloud that sent no telemetry."""
    served_hours = (
        load_runs.filter(F.col("ok") > 0)
        .groupBy("cloud", F.date_trunc("HOUR", "run_at").alias("hour"))
        .agg(F.sum("ok").alias("ok"))
    )
    seen = samples.groupBy("cloud", F.date_trunc("HOUR", "ts").alias("hour")).agg(F.lit(1).alias("_one"))
    return served_hours.join(seen, ["cloud", "hour"], "left_anti")


def undercount(app: DataFrame, stored: DataFrame, series: Sequence[str]) -> DataFrame:
    """What the app counted against what was stored, per series; a missing label equals an empty one."""
    left = app.select(*series, F.col("value").alias("app_value"))
    right = stored.select(*series, F.col("value").alias("stored_value"))
    missing = F.coalesce("app_value", F.lit(0.0)) - F.coalesce("stored_value", F.lit(0.0))
    return join_same(left, right, list(series), "full", empty=True).withColumn("missing", missing)


def total_increase(deltas: DataFrame, series: Sequence[str]) -> DataFrame:
    """Everything each series counted, over all its restarts."""
    return deltas.groupBy(*series).agg(F.sum("delta").alias("value"))
