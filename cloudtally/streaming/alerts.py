"""Breaches and incidents on a stream of increments."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cloudtally.functions.labels import matches
from cloudtally.operators.incidents import AlertRules
from cloudtally.operators.metrics import SERVER_ERROR, served, with_quantile
from cloudtally.operators.series import INFINITY, LATENCY_BOUNDS, bound_label

# State processors travel with the query, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EVENTS = (
    "policy string, cloud string, event string, opened long, last long, evaluations long, peak double"
)


def stream_error_breaches(
    increments: DataFrame, rules: AlertRules = AlertRules(), delay: str = "2 minutes"
) -> DataFrame:
    """Evaluations over the error threshold, each emitted once its range is complete.

    A range without rows gives nothing, and a cloud without any 5xx series
    gives no ratio, so silence never breaches.
    """
    rows = served(increments).withWatermark("ts", delay)
    bad = matches(rows, *SERVER_ERROR)
    grid = F.window("ts", f"{rules.range_s} seconds", f"{rules.every_s} seconds")
    sums = rows.groupBy("cloud", grid).agg(
        F.sum(F.when(bad, F.col("delta"))).alias("errors"), F.sum("delta").alias("total")
    )
    ratio = F.try_divide("errors", "total")
    busy = F.col("total") / F.lit(float(rules.range_s)) > F.lit(rules.floor_rate)
    return sums.filter(busy & (ratio > F.lit(rules.error_ratio))).select(
        F.lit("error ratio").alias("policy"), "cloud", F.col("window.end").alias("eval_ts"), ratio.alias("value"), "window"
    )


def stream_latency_breaches(
    increments: DataFrame, rules: AlertRules = AlertRules(), delay: str = "2 minutes", bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Evaluations whose 95th percentile is over its threshold, from increments of histogram buckets.

    Each bound is a sum of its own, so one aggregation holds a range's whole
    histogram. Buckets of a bound that is not listed are left out.
    """
    rows = served(increments).withWatermark("ts", delay)
    grid = F.window("ts", f"{rules.range_s} seconds", f"{rules.every_s} seconds")
    labels = [*[(b, bound_label(b)) for b in bounds], (float("inf"), INFINITY)]
    counts = [F.sum(F.when(F.col("le") == label, F.col("delta")).otherwise(0.0)) for _, label in labels]
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_n{i}").alias("n")) for i, (b, _) in enumerate(labels)])
    sums = rows.groupBy("cloud", grid).agg(*[c.alias(f"_n{i}") for i, c in enumerate(counts)])
    slow = with_quantile(0.95, sums.withColumn("_b", buckets), ["cloud", "window"], total="total")
    busy = F.col("total") / F.lit(float(rules.range_s)) > F.lit(rules.floor_rate)
    return slow.filter(busy & (F.col("value") > F.lit(float(rules.latency_s)))).select(
        F.lit("p95 latency").alias("policy"), "cloud", F.col("window.end").alias("eval_ts"), "value", "window"
    )


class _Incidents(StatefulProcessor):
    """Holds a breach, opens an incident, closes it on an event-time timer.

    State is one row per policy and cloud: when the unbroken run began, the
    last breach, and the open incident if there is one. Times are whole
    microseconds, which mean the same on every machine.
    """

    _STATE = "since long, breach long, opened long, firing long, evaluations long, peak double"

    def __init__(self, rules: AlertRules) -> None:
        self._step = rules.every_s * 1_000_000
        self._hold = rules.hold_s * 1_000_000
        self._quiet = rules.close_after_s * 1_000_000

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("incident", self._STATE)

    def _event(self, key, event: str, opened: int, last: int, n: int, peak: float) -> Row:
        return Row(policy=key[0], cloud=key[1], event=event, opened=opened, last=last, evaluations=n, peak=peak)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since, breach, opened, firing, n, peak = self._state.get() or (None, None, None, None, 0, None)
        # One row per evaluation that breached, so a batch's share is short.
        for row in sorted(rows, key=lambda r: r["at"]):
            now, value = row["at"], row["value"]
            if breach is None or now - breach > self._step:
                since = now
            breach = now
            if now - since < self._hold:
                continue
            if opened is not None and now - firing > self._quiet:
                yield self._event(key, "closed", opened, firing, n, peak)
                opened = None
            if opened is None:
                opened, n, peak = now, 0, value
                yield self._event(key, "opened", now, now, 1, value)
            firing, n, peak = now, n + 1, max(peak, value)
        self._state.update((since, breach, opened, firing, n, peak))
        if opened is not None:
            for old in list(self._handle.listTimers()):
                self._handle.deleteTimer(old)
            self._handle.registerTimer((firing + self._quiet) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        since, breach, opened, firing, n, peak = self._state.get()
        if opened is not None:
            yield self._event(key, "closed", opened, firing, n, peak)
            self._state.update((since, breach, None, None, 0, None))

    def close(self) -> None:
        pass


def stream_incidents(breaches: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """An ``opened`` event when a breach has held, a ``closed`` one when it is over."""
    rows = breaches.withColumn("at", F.unix_micros("eval_ts")).drop("eval_ts")
    events = rows.groupBy("policy", "cloud").transformWithState(_Incidents(rules), _EVENTS, "append", "eventTime")
    return events.select(
        "policy",
        "cloud",
        "event",
        F.timestamp_micros("opened").alias("opened_at"),
        F.timestamp_micros("last").alias("last_firing"),
        "evaluations",
        "peak",
    )
