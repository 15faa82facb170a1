"""From requests to counter and histogram series, and from counters to increments."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.labels import join_same

# Upper bounds of the latency histogram in seconds, the routes
# that are never measured, the label of a path no route serves, and the series
# an app process creates at zero.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
UNMEASURED = ("/health", "/metrics")
UNMATCHED = "unmatched"
KNOWN_ROUTES = ("/", "/flaky")
KNOWN_STATUSES = ("200", "500")
START_METRIC = r"^process_start_time(_seconds)?$"

SERIES = ("cloud", "route", "method", "status")
HISTOGRAM_SERIES = ("cloud", "route", "method")
INFINITY = "+Inf"


def route_template(path: Column, templates: Sequence[str]) -> Column:
    """The first template a path fits, ``unmatched`` if none does.

    ``{name}`` in a template stands for one path segment. Templates are a short
    parameter list, so they become one expression rather than a joined table.
    """
    fit = None
    for template in templates:
        parts = re.split(r"\{[^}]*\}", template)
        if len(parts) == 1:
            hit = path == template
        else:
            hit = path.rlike("^" + "[^/]+".join(re.escape(p) for p in parts) + "$")
        fit = F.when(hit, template) if fit is None else fit.when(hit, template)
    return F.lit(UNMATCHED) if fit is None else fit.otherwise(UNMATCHED)


def with_route(requests: DataFrame, templates: Sequence[str], path: str = "path") -> DataFrame:
    return requests.withColumn("route", route_template(F.col(path), templates))


def measured(requests: DataFrame, unmeasured: Sequence[str] = UNMEASURED) -> DataFrame:
    return requests.filter(~F.col("route").isin(*unmeasured))


def _slice(ts: str, width: str) -> Column:
    return F.window(F.col(ts), width)["start"]


def cumulative_counter(
    requests: DataFrame,
    series: Sequence[str] = SERIES,
    ts: str = "ts",
    tie: str = "event_id",
    restart: Sequence[str] = ("start_ts",),
    slice_width: str = "1 minute",
) -> DataFrame:
    """Running count of requests per series, one sample per request.

    A busy series may hold much of the table, so it is not ranked in one piece:
    rows are numbered inside a time slice, and each slice starts from the total
    of the slices before it, which comes from one small count per slice. A
    slice must fit one task; the width is the parameter to set for that.
    """
    keys = [*series, *restart]
    rows = requests.withColumn("_slice", _slice(ts, slice_width))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    numbered = rows.withColumn("_nth", F.row_number().over(inside))
    return (
        join_same(numbered, starts, [*keys, "_slice"])
        .withColumn("value", (F.col("_before") + F.col("_nth")).cast("double"))
        .drop("_slice", "_before", "_nth")
    )


def bound_label(bound: float) -> str:
    return repr(float(bound))


def latency_histogram(
    requests: DataFrame, by: Sequence[str], seconds: str = "seconds", bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative bucket counts in one pass, one row per group and upper bound."""
    wide = requests.groupBy(*by).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(seconds).alias("_all"),
    )
    return long_buckets(wide, list(by), bounds)


def long_buckets(wide: DataFrame, by: list[str], bounds: Sequence[float], count: str = "count") -> DataFrame:
    buckets = F.array(
        *[F.struct(F.lit(bound_label(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit(INFINITY).alias("le"), F.col("_all").alias("n")),
    )
    return wide.select(*by, F.explode(buckets).alias("_x")).select(*by, "_x.le", F.col("_x.n").alias(count))


def zero_series(
    processes: DataFrame,
    routes: Sequence[str] = KNOWN_ROUTES,
    statuses: Sequence[str] = KNOWN_STATUSES,
    method: str = "GET",
) -> DataFrame:
    """The samples a process writes when it starts: every known series at zero."""
    known = F.array(
        *[F.struct(F.lit(r).alias("route"), F.lit(s).alias("status")) for r in routes for s in statuses]
    )
    return processes.select("cloud", "start_ts", F.explode(known).alias("_k")).select(
        "cloud",
        "_k.route",
        F.lit(method).alias("method"),
        "_k.status",
        "start_ts",
        F.col("start_ts").alias("ts"),
        F.lit(0.0).alias("value"),
    )


def with_zero_series(samples: DataFrame, processes: DataFrame, **known) -> DataFrame:
    """Samples preceded by the zero samples of the processes that wrote them."""
    zeros = zero_series(processes, **known)
    return samples.select(*zeros.columns).unionByName(zeros)


def stamp_labels(df: DataFrame, **labels: Column | str) -> DataFrame:
    """Set labels at collection time; one that is already there is overwritten."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in labels.items()})


def collection_labels(df: DataFrame, cloud: Column | str, location: str, namespace: str, service: str) -> DataFrame:
    """The labels a collector puts on everything it sends: the estate is also the cluster."""
    return stamp_labels(df, location=location, cluster=cloud, namespace=namespace, service=service, cloud=cloud)


def stamp_start_time(
    samples: DataFrame, target: Sequence[str] = ("target",), ts: str = "ts", pattern: str = START_METRIC
) -> DataFrame:
    """Give every sample of a scrape the process start time read in the same scrape.

    A scrape without that metric leaves the start unknown (NULL).
    """
    is_start = F.coalesce(F.col("metric").rlike(pattern), F.lit(False))
    # A scrape is one exposition text: its lines meet in one window, and the samples are read once.
    scrape = Window.partitionBy(*target, ts)
    micros = F.max(F.when(is_start, F.round(F.col("value") * 1000000).cast("long"))).over(scrape)
    return (
        samples.withColumn("_is_start", is_start)
        .withColumn("start_ts", F.timestamp_micros(micros))
        .filter(~F.col("_is_start"))
        .drop("_is_start")
    )


def counter_deltas(
    samples: DataFrame,
    series: Sequence[str] = SERIES,
    ts: str = "ts",
    slice_width: str = "1 day",
) -> DataFrame:
    """How much each sample adds to its counter, in a ``delta`` column.

    The first sample counts from zero when its start time is known, and adds
    nothing when it is not. A lower value or a new start time is a restart, and
    the whole value counts. Series are cut into time slices, so that a series
    with much of the data is spread over tasks. Inside a slice a sample finds
    the one before it; a slice's first sample finds it among the first and last
    ones of all slices, two rows each. Both come off one shuffle, so samples
    are read once. A day of half-minute scrapes is 2880 rows; for samples taken
    per request use narrow slices.
    """
    keys = list(series)
    # At one moment a process that ended comes before the one that replaced it.
    order = (ts, "start_ts", "value")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_slice", *order)
    here = F.struct(F.col("value").alias("v"), F.col("start_ts").alias("s"))
    rows = samples.withColumn("_slice", _slice(ts, slice_width)).withColumns(
        {"_prior": F.lag(here).over(inside), "_last": F.lead(F.lit(1)).over(inside).isNull()}
    )
    first = F.col("_prior").isNull()
    # Every column is needed on both sides, which makes their shuffles the same one.
    edges = rows.filter(first | F.col("_last")).withColumns({"_first": first, "_before": F.lag(here).over(across)})
    opening = edges.filter("_first").withColumn("_prior", F.col("_before")).drop("_first", "_before")
    return (
        rows.filter(~first)
        .unionByName(opening)
        .withColumn("delta", increment(F.col("value"), F.col("start_ts"), F.col("_prior.v"), F.col("_prior.s")))
        .drop("_slice", "_prior", "_last")
    )


def increment(value: Column, start: Column, prior_value: Column, prior_start: Column) -> Column:
    """What one sample adds, given the sample before it (NULL if it is the first)."""
    restarted = (value < prior_value) | ~start.eqNullSafe(prior_start)
    return (
        F.when(prior_value.isNull(), F.when(start.isNotNull(), value).otherwise(0.0))
        .when(restarted, value)
        .otherwise(value - prior_value)
    )
