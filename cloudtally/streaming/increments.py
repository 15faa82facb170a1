"""Counter samples to increments per step, with the last value kept per series.

A window over raw samples loses the increment across its left edge, so the
stream keeps each series' last value and windows increments instead. Within one
process a counter only grows, so a step's highest value is all that matters:
samples are first reduced to one row per series, process and step, and custom
state sees those few rows instead of every sample.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cloudtally.operators.series import SERIES

# State processors travel with the query, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _StepIncrements(StatefulProcessor):
    """Adds up a series' steps in time order, from the last value of its process.

    Times are whole microseconds, which mean the same on every machine.
    """

    def __init__(self, names: Sequence[str]) -> None:
        self._names = list(names)

    def init(self, handle) -> None:
        self._last = handle.getValueState("last", "start long, value double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        labels = dict(zip(self._names, key))
        last = self._last.get()
        # A series has one row per step and process here, so a batch's share is short.
        ordered = sorted(rows, key=lambda r: (r["at"], r["start"] if r["start"] is not None else -1))
        for at, step in groupby(ordered, key=lambda r: r["at"]):
            delta = 0.0
            for row in step:
                start, top = row["start"], row["top"]
                if last is None:
                    delta += 0.0 if start is None else top
                elif last[0] == start and top >= last[1]:
                    delta += top - last[1]
                else:
                    delta += top
                last = (start, top)
            yield Row(**labels, at=at, delta=delta)
        if last is not None:
            self._last.update(last)

    def close(self) -> None:
        pass


def step_increments(
    samples: DataFrame, step: str = "60 seconds", delay: str = "2 minutes", series: Sequence[str] = SERIES
) -> DataFrame:
    """``series, ts, delta`` per step, ``ts`` being the step's start.

    A sample taken at a step's end belongs to it, as evaluations count it: it
    is windowed a microsecond earlier.

    A step is emitted once, when the watermark has passed its end; samples
    later than ``delay`` are dropped and counted in the query's progress. The
    closed-day recompute over the stored samples stays a batch job.
    """
    keys = list(series)
    tops = (
        samples.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
        .withWatermark("ts", delay)
        .groupBy(*keys, "start_ts", F.window("ts", step))
        .agg(F.max("value").alias("top"))
        .select(
            *keys,
            F.unix_micros("start_ts").alias("start"),
            F.unix_micros("window.start").alias("at"),
            "top",
        )
    )
    schema = ", ".join(f"{k} string" for k in keys) + ", at long, delta double"
    counted = tops.groupBy(*keys).transformWithState(_StepIncrements(keys), schema, "append", "none")
    return counted.select(*keys, F.timestamp_micros("at").alias("ts"), "delta")
