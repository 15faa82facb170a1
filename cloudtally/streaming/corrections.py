"""What late samples change in steps a stream has already emitted.

A stream emits a step once, when the watermark has passed it, and leaves out
samples that come later. They are kept beside it, with the batch they came
in, and a batch job works out by how much the emitted steps are off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.labels import join_same
from cloudtally.operators.series import SERIES, counter_deltas


def late_samples(kept: DataFrame, step_s: int = 60, delay_s: int = 120) -> DataFrame:
    """Kept samples (with their ``batch``) whose step was closed before their batch came.

    The watermark of a batch is the newest time of the batches before it, less
    the delay; there is one row for each batch to find it from.
    """
    newest = kept.groupBy("batch").agg(F.max("ts").alias("_newest"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = newest.select("batch", (F.unix_micros(F.max("_newest").over(before)) - 1 - F.lit(delay_s * 1_000_000)).alias("_mark"))
    closes = (F.floor((F.unix_micros("ts") - 1) / F.lit(step_s * 1_000_000)) + 1) * step_s * 1_000_000
    return kept.join(marks, "batch").filter(closes <= F.col("_mark")).drop("_mark")


def corrections(
    kept: DataFrame, emitted: DataFrame, step_s: int = 60, delay_s: int = 120, series: Sequence[str] = SERIES
) -> DataFrame:
    """``series, ts, delta``: what to add to the emitted increments of closed steps.

    ``kept`` holds all samples of the stream with their batch. Only series with
    a late sample are worked out again, all of their closed steps, since a
    late sample can move an increment from one step to another. Added to what
    was emitted, the result is what a batch over all samples gives. A step that
    is still open is left to the stream. Run twice, it gives the same, so its
    result replaces that of an earlier run.
    """
    keys = list(series)
    touched = late_samples(kept, step_s, delay_s).select(*keys).distinct()
    newest = kept.agg(F.max("ts").alias("_newest"))
    step = F.lit(step_s * 1_000_000)
    at = (F.floor((F.unix_micros("ts") - 1) / step) * step).cast("long")
    deltas = counter_deltas(join_same(kept.drop("batch"), touched, keys, "left_semi"), keys)
    whole = deltas.groupBy(*keys, at.alias("_at")).agg(F.sum("delta").alias("_delta"))
    closed = whole.join(F.broadcast(newest)).filter(
        F.col("_at") + step <= F.unix_micros("_newest") - 1 - F.lit(delay_s * 1_000_000)
    ).drop("_newest")
    told = join_same(emitted, touched, keys, "left_semi").select(*keys, F.unix_micros("ts").alias("_at"), (-F.col("delta")).alias("_delta"))
    off = closed.unionByName(told).groupBy(*keys, "_at").agg(F.sum("_delta").alias("delta"))
    return off.filter("delta <> 0").select(*keys, F.timestamp_micros("_at").alias("ts"), "delta")


def corrected(emitted: DataFrame, found: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Emitted increments with their corrections added; a step that is left with nothing stays, with zero."""
    keys = list(series)
    both = emitted.select(*keys, "ts", "delta").unionByName(found.select(*keys, "ts", "delta"))
    return both.groupBy(*keys, "ts").agg(F.sum("delta").alias("delta"))
