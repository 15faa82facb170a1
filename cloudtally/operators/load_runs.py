"""Load runs, their latencies, and application logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.labels import join_same
from cloudtally.schemas import LOG_RECORD

# Fixed value: the shape of a result line, with the four fields that are kept.
RESULT_LINE = r"load cloud=([a-z]+) sent=([0-9]+) ok=([0-9]+) .* at=([0-9TZ:-]+)"

# Log severities, lowest first.
SEVERITIES = ("DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY")


def parse_load_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Result lines out of run logs; other lines are passed over."""
    # The pattern is matched once: the fields of the match come out with a mark between them.
    mark = "\u0001"
    swapped = F.regexp_replace(F.col(text), f"^.*?{RESULT_LINE}.*$", mark + mark.join(f"${g}" for g in range(1, 5)))
    fields = lines.select("run_id", F.split(swapped, mark).alias("_f")).filter(F.size("_f") == 5)
    return fields.select(
        "run_id",
        F.col("_f")[1].alias("cloud"),
        F.col("_f")[2].cast("long").alias("sent"),
        F.col("_f")[3].cast("long").alias("ok"),
        F.col("_f")[4].cast("timestamp").alias("run_at"),
    )


def runs_without_result(lines: DataFrame, text: str = "value") -> DataFrame:
    """Runs whose log has no result line at all: skipped by the reader, listed here."""
    return (
        lines.groupBy("run_id")
        .agg(F.count_if(F.col(text).rlike(RESULT_LINE)).alias("results"))
        .filter(F.col("results") == 0)
        .select("run_id")
    )


def completed_runs(runs: DataFrame, start: datetime) -> DataFrame:
    """Finished runs created from ``start`` on."""
    return runs.filter((F.col("status") == "completed") & (F.col("created_at") >= F.lit(start)))


def runs_per_day(load_runs: DataFrame) -> DataFrame:
    return (
        load_runs.groupBy(F.to_date("run_at").alias("day"), "cloud")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("ok").alias("ok"))
        .orderBy("day", "cloud")
    )


def run_success(load_runs: DataFrame) -> DataFrame:
    """Whether every request of a run succeeded on every estate it reached."""
    return load_runs.groupBy("run_id").agg(
        F.bool_and(F.col("sent") == F.col("ok")).alias("succeeded"),
        F.count(F.lit(1)).alias("estates"),
        F.sum("sent").alias("sent"),
        F.sum("ok").alias("ok"),
    )


def schedule_coverage(load_runs: DataFrame, first: date, last: date, expected: int = 24) -> DataFrame:
    """Distinct runs per UTC day against a schedule; days with none count as zero."""
    spark = load_runs.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    seen = (
        load_runs.groupBy(F.to_date("run_at").alias("day"), "run_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("runs"))
    )
    runs = F.coalesce("runs", F.lit(0).cast("long"))
    return days.join(seen, "day", "left").select(
        "day", runs.alias("runs"), F.round(runs / F.lit(expected), 6).alias("coverage")
    )


def percentiles(
    rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float], bin_width: float = 0.001
) -> DataFrame:
    """Exact percentiles with linear interpolation, for groups of any size.

    The built-in keeps every distinct value of a group in one task. Here values
    are first counted in bins of a fixed width, the bins holding the wanted
    ranks are found from those counts, and only the values in those bins are
    then ranked, bin by bin, after equal values have been merged.
    """
    by = list(by)
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    known = known.withColumn("_bin", F.floor(F.col("_v") / F.lit(bin_width)))
    through = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        known.groupBy(*by, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(through), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_all") - 1)).alias("at"))
            for name, q in points.items()
        ]
    )
    ranked = bins.select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.explode(wanted).alias("_p"))
    # The value at rank floor(at), and the one after it, may sit in two bins.
    lower = F.floor("_p.at")
    hits = ranked.filter((lower < F.col("_upto")) & (F.ceil("_p.at") >= F.col("_before")))
    needed = hits.groupBy(*by, "_bin", "_before").agg(F.collect_list("_p").alias("_points"))  # one entry per point

    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (
        join_same(known, needed.select(*by, "_bin"), [*by, "_bin"], "left_semi")
        .groupBy(*by, "_bin", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(inside))
    )
    values = join_same(values, needed, [*by, "_bin"]).select(
        *by,
        "_v",
        (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_from"),
        (F.col("_before") + F.col("_upto")).alias("_to"),
        F.explode("_points").alias("_p"),
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    at = F.col("_at")
    per_point = (
        values.select(*by, "_v", "_from", "_to", F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at"))
        .groupBy(*by, "_name", "_at")
        .agg(at_rank(F.floor(at)).alias("_low"), at_rank(F.ceil(at)).alias("_high"))
        .withColumn("_value", F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at)))
    )
    return per_point.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in points]
    )


#: One part in so many of a group's rows is what a sketched rank may be off by.
SKETCH = 1000


def sketched_percentiles(rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float], *also: Column) -> DataFrame:
    """Exact percentiles with linear interpolation, and any other aggregates, in two reads whatever the scale of the values.

    The first read makes a quantile sketch of each group, which partial sketches
    merge into. It gives two values that a wanted rank lies between for
    certain, as its error is bounded; a group too small for that is ranked
    whole. The second read counts what is below them and ranks what is between,
    after equal values have been merged: a few in a thousand of a group's rows
    for each point.
    """
    by = list(by)
    names = list(points)
    # Twice the bound to each side, so that the ranks beside a wanted one are inside too.
    slack = 2.0 / SKETCH
    probes = [min(max(q + s, 0.0), 1.0) for q in points.values() for s in (-slack, slack)]
    sketch = F.percentile_approx(F.when(~F.isnan(value), F.col(value).cast("double")), F.array(*[F.lit(p) for p in probes]), F.lit(SKETCH))
    known = F.count_if(F.col(value).isNotNull() & ~F.isnan(value))
    groups = rows.groupBy(*by).agg(sketch.alias("_probes"), known.alias("_all"), F.min(value).alias("_least"), F.max(value).alias("_most"), *also)

    # Always true; as it names every column, both uses below are of one and the same aggregate, which is then made once.
    groups = groups.filter(F.xxhash64(*[c for c in groups.columns if c not in by]) % 1 == 0)
    few = F.col("_all") < 4 / slack

    def bracket(i: int, q: float) -> Column:
        low = F.when(F.lit(q <= slack) | few, F.col("_least")).otherwise(F.col("_probes")[2 * i])
        high = F.when(F.lit(q >= 1 - slack) | few, F.col("_most")).otherwise(F.col("_probes")[2 * i + 1])
        at = F.lit(q) * (F.col("_all") - 1)
        return F.struct(F.lit(i).alias("point"), low.alias("low"), high.alias("high"), at.alias("at"))

    wanted = groups.filter("_all > 0").select(*by, F.array(*[bracket(i, q) for i, q in enumerate(points.values())]).alias("_brackets"))
    mine = join_same(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), wanted, by)
    # What is below a bracket is one row of a group and point, under no value.
    told = mine.select(*by, "_v", F.explode("_brackets").alias("_b")).filter(F.col("_v") <= F.col("_b.high"))
    inside = F.when(F.col("_v") >= F.col("_b.low"), F.col("_v"))
    merged = told.groupBy(*by, "_b.point", "_b.at", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by, "point").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n"))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")) & F.col("_v").isNotNull(), F.col("_v")))

    at = F.col("at")
    low, high = at_rank(F.floor(at)), at_rank(F.ceil(at))
    per_point = ranked.groupBy(*by, "point", "at").agg(low.alias("_low"), high.alias("_high"))
    # The sketch's bound makes this impossible; a wrong figure would be worse than none.
    held = F.when(F.col("_low").isNull() | F.col("_high").isNull(), F.raise_error(F.lit("a rank is outside its bracket")).cast("double"))
    found = per_point.withColumn("_value", held.otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))))
    values = found.groupBy(*by).agg(*[F.max(F.when(F.col("point") == i, F.col("_value"))).alias(n) for i, n in enumerate(names)])
    return join_same(groups.drop("_probes", "_all", "_least", "_most"), values, by, "left")


def latency_summary(timings: DataFrame, by: Sequence[str], ts: str = "ts", seconds: str = "seconds") -> DataFrame:
    """First, median, 95th percentile and slowest request of each run and cloud."""
    edges = (F.min_by(seconds, ts).alias("first_s"), F.max(seconds).alias("max_s"), F.count(seconds).alias("timed"))
    return sketched_percentiles(timings, by, seconds, {"p50_s": 0.5, "p95_s": 0.95}, *edges)


def parse_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON log lines as columns; what is not such a line has a NULL severity."""
    kept = [c for c in lines.columns if c != text]
    record = F.from_json(F.col(text), LOG_RECORD)
    return lines.withColumn("_r", record).select(
        *kept,
        "_r.severity",
        "_r.message",
        "_r.logger",
        F.try_to_timestamp("_r.time", F.lit("yyyy-MM-dd'T'HH:mm:ssxx")).alias("ts"),
    )


def severity_rank(severity: Column) -> Column:
    """Place in the severity order, NULL for an unknown one."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def unknown_severities(logs: DataFrame) -> DataFrame:
    """Severities the order does not know, with their counts: ``at_least`` cannot place them."""
    odd = F.col("severity").isNotNull() & ~F.col("severity").isin(*SEVERITIES)
    return logs.filter(odd).groupBy("severity").agg(F.count(F.lit(1)).alias("records"))


def at_least(logs: DataFrame, severity: str = "ERROR") -> DataFrame:
    floor = SEVERITIES.index(severity)
    return logs.filter(F.col("severity").isin(*SEVERITIES[floor:]))


def latest_errors(logs: DataFrame, as_of: datetime, hours: int = 1, limit: int = 20) -> DataFrame:
    """The newest errors inside a freshness window; the limit is part of the report."""
    end = F.lit(as_of).cast("timestamp")
    fresh = (F.col("ts") > end - F.make_interval(hours=F.lit(hours))) & (F.col("ts") <= end)
    ties = [c for c in ("cloud", "message") if c in logs.columns]
    return at_least(logs, "ERROR").filter(fresh).orderBy(F.desc("ts"), *ties).limit(limit)


def mentions_any(
    logs: DataFrame, terms: Sequence[str] = ("error", "denied", "credential"), ignore_case: bool = False
) -> DataFrame:
    """Records whose message holds any of the terms."""
    message = F.lower("message") if ignore_case else F.col("message")
    wanted = [t.lower() if ignore_case else t for t in terms]
    hit = F.lit(False)
    for term in wanted:
        hit = hit | message.contains(term)
    return logs.filter(hit)
