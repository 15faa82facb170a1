"""Counters, quantiles, look-back and incidents on hand-made and random rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudtally.operators import incidents as inc
from cloudtally.operators import load_runs as lr
from cloudtally.operators import metrics as m
from cloudtally.operators import series as sr
from cloudtally.plans import derived as d

T0 = datetime(2026, 10, 10, 12)
SAMPLE = "cloud string, route string, method string, status string, ts timestamp, start_ts timestamp, value double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def samples(spark, *points, cloud="aws", route="/", status="200"):
    """Points are (seconds, value, start); a start of None is unknown."""
    rows = [
        (cloud, route, "GET", status, at(s), None if start is None else at(start), float(v)) for s, v, start in points
    ]
    return spark.createDataFrame(rows, SAMPLE)


def deltas_of(df, **options):
    return [r["delta"] for r in sr.counter_deltas(df, **options).orderBy("ts", "start_ts").collect()]


def test_first_sample_counts_from_a_known_start(spark):
    assert deltas_of(samples(spark, (0, 1, -60), (30, 6, -60))) == [1.0, 5.0]
    assert deltas_of(samples(spark, (0, 1, None), (30, 6, None))) == [0.0, 5.0]


def test_restarts(spark):
    assert deltas_of(samples(spark, (0, 2, 0), (30, 7, 0), (60, 1, 40), (90, 4, 40))) == [2.0, 5.0, 1.0, 3.0]
    # A new start counts in full even if the value is higher than before.
    assert deltas_of(samples(spark, (0, 2, 0), (30, 9, 20))) == [2.0, 9.0]
    # Without start times a drop is all there is to go by.
    assert sum(deltas_of(samples(spark, (0, 2, None), (30, 7, None), (60, 1, None), (90, 4, None)))) == 9.0


def test_old_and_new_process_at_one_moment(spark):
    assert deltas_of(samples(spark, (0, 5, -60), (60, 8, -60), (60, 0, 60), (90, 2, 60))) == [5.0, 3.0, 0.0, 2.0]


def test_increments_do_not_depend_on_slices(spark):
    rng = random.Random(7)
    points, value, start = [], 0, 0
    for s in range(0, 40000, 400):
        if rng.random() < 0.1:
            value, start = 0, s
        value += rng.randrange(5)
        points.append((s, value, start))
    rows = samples(spark, *points)
    expected = deltas_of(rows, slice_width="30 days")
    for width in ("7 minutes", "1 hour", "5 hours"):
        assert deltas_of(rows, slice_width=width) == expected


def test_one_busy_series_is_spread_over_tasks(spark):
    """All rows in one series: no task may hold more than a few slices of it."""
    rows = spark.range(20000).select(
        F.lit("aws").alias("cloud"),
        F.timestamp_seconds(F.col("id") * 30 + 1791000000).alias("ts"),
        F.timestamp_seconds(F.lit(1791000000)).alias("start_ts"),
        F.col("id").cast("double").alias("value"),
        F.col("id").alias("event_id"),
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        for made in (sr.counter_deltas(rows, ["cloud"], slice_width="2 hours"), sr.cumulative_counter(rows, ["cloud"], slice_width="2 hours")):
            sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 20000 and max(sizes) < 20000 / 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sr.counter_deltas(rows, ["cloud"]).agg(F.sum("delta")).first()[0] == 19999.0


def test_running_count_does_not_depend_on_slices(spark):
    rng = random.Random(11)
    rows = [(i, at(rng.randrange(20000)), rng.choice("ab"), at(0)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, cloud string, start_ts timestamp")
    expected, seen = {}, {}
    for i, ts, cloud, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        seen[cloud] = seen.get(cloud, 0) + 1
        expected[i] = float(seen[cloud])
    for width in ("1 minute", "1 hour", "1 day"):
        got = sr.cumulative_counter(df, ["cloud"], slice_width=width).collect()
        assert {r["event_id"]: r["value"] for r in got} == expected


def test_late_series_starts_at_zero(spark):
    """A series made at zero on start shows its first request in a short range."""
    first = samples(spark, (50000, 1, 0), status="500", route="/flaky")
    process = spark.createDataFrame([("aws", at(0))], "cloud string, start_ts timestamp")
    filled = sr.with_zero_series(first, process)
    assert filled.count() == 5
    grown = sr.counter_deltas(filled).filter(F.col("ts") > F.lit(at(1000))).agg(F.sum("delta")).first()[0]
    assert grown == 1.0


def test_start_time_stamp(spark):
    rows = [("t", at(0), "c", 3.0), ("t", at(0), "process_start_time_seconds", 1000.5), ("t", at(30), "c", 4.0)]
    df = spark.createDataFrame(rows, "target string, ts timestamp, metric string, value double")
    got = {r["ts"]: r["s"] for r in sr.stamp_start_time(df).select("ts", F.unix_millis("start_ts").alias("s")).collect()}
    assert got == {at(0): 1000500, at(30): None}


def test_route_templates(spark):
    df = spark.createDataFrame([("/",), ("/u/7",), ("/u/7/x",), ("/u/",), ("/health",)], "path string")
    got = {r["path"]: r["route"] for r in sr.with_route(df, ["/", "/u/{id}", "/health"]).collect()}
    assert got == {"/": "/", "/u/7": "/u/{id}", "/u/7/x": "unmatched", "/u/": "unmatched", "/health": "/health"}


def test_unmeasured_routes(spark):
    df = spark.createDataFrame([("/",), ("/health",), ("/metrics",)], "route string")
    assert [r["route"] for r in sr.measured(df).collect()] == ["/"]


def test_labels_overwrite(spark):
    df = spark.createDataFrame([("old", 1)], "cloud string, v int")
    row = sr.collection_labels(df, "aws", "l", "n", "s").first()
    assert (row["cloud"], row["cluster"], row["location"]) == ("aws", "aws", "l")


def buckets(spark, counts):
    bounds = [*map(sr.bound_label, sr.LATENCY_BOUNDS), "+Inf"]
    return spark.createDataFrame([("aws", le, float(n)) for le, n in zip(bounds, counts)], "cloud string, le string, value double")


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ([60] * 10, 0.00475),  # all in the first bucket
        ([0, 0, 0, 0, 0, 0, 0, 0, 0, 10], 2.5),  # beyond the last bound
        ([0] * 10, None),  # nothing observed
        ([0, 0, 0, 0, 0, 0, 100, 200, 200, 200], 0.95),
        ([90, 90, 90, 90, 90, 100, 100, 100, 100, 100], 0.175),
    ],
)
def test_quantile(spark, counts, expected):
    value = m.histogram_quantile(0.95, buckets(spark, counts), ["cloud"]).first()["value"]
    assert value == (None if expected is None else pytest.approx(expected))


def test_ratio_with_and_without_zero_fill(spark):
    ok = sr.counter_deltas(samples(spark, (0, 10, -60)))
    assert m.error_ratio(ok).count() == 0
    assert [r["value"] for r in m.error_ratio_or_zero(ok).collect()] == [0.0]


def test_increase_over_a_sliding_range(spark):
    rows = sr.counter_deltas(samples(spark, *[(s, s // 30 + 1, -1) for s in range(0, 600, 30)]))
    by_end = {r["eval_ts"]: r["value"] for r in m.increase(rows, ["cloud"], 300, 60).collect()}
    assert by_end[at(300)] == 10.0 and by_end[at(600)] == 9.0 and by_end[at(60)] == 3.0 and by_end[at(840)] == 1.0
    # A window holds its start and not its end; a moment earlier turns that round.
    moved = F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")
    direct = rows.groupBy("cloud", F.window(moved, "300 seconds", "60 seconds")["end"].alias("e")).agg(F.sum("delta").alias("v"))
    assert {r["e"]: r["v"] for r in direct.collect()} == by_end


def test_lookback(spark):
    rows = samples(spark, (0, 1, 0), (100, 2, 0))
    for moment, expected in ((100, [2.0]), (399, [2.0]), (400, []), (99, [1.0])):
        got = m.instant_value(rows, sr.SERIES, at(moment)).collect()
        assert [r["value"] for r in got] == expected, moment
    grid = m.instant_values(rows, sr.SERIES, 60, 300)
    got = {int((r["eval_ts"] - T0).total_seconds()): r["value"] for r in grid.collect()}
    expected = {t: (2.0 if t >= 100 else 1.0) for t in range(0, 400, 60) if t < 400}
    assert got == expected


def test_patterns_match_the_whole_label(spark):
    df = spark.createDataFrame([("500",), ("5000",), (None,)], "status string")
    from cloudtally.functions.labels import select_series

    assert [r["status"] for r in select_series(df, ("status", "=~", "5..")).collect()] == ["500"]
    assert select_series(df, ("status", "=", "")).count() == 1
    assert select_series(df, ("pod", "!=", "")).count() == 0
    with pytest.raises(ValueError):
        select_series(df, ("status", "~", "5"))


def test_vector_or_and_and(spark):
    left = spark.createDataFrame([("a", T0, 1.0)], "cloud string, eval_ts timestamp, value double")
    right = spark.createDataFrame([("a", T0, 9.0), ("b", T0, 2.0)], "cloud string, eval_ts timestamp, value double")
    assert {(r["cloud"], r["value"]) for r in m.vector_or(left, right, ["cloud"]).collect()} == {("a", 1.0), ("b", 2.0)}
    assert [(r["cloud"], r["value"]) for r in m.vector_and(right, left, ["cloud"]).collect()] == [("a", 9.0)]


@pytest.mark.parametrize("width", [0.001, 0.05, 10.0])
def test_percentiles_are_exact(spark, width):
    rng = random.Random(3)
    rows = [("a", rng.random()) for _ in range(500)] + [("b", 0.25)] * 50 + [("c", 1.5), ("d", 1.0), ("d", 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["g"]: r for r in lr.percentiles(df, ["g"], "v", points, width).collect()}
    for g in "abcd":
        values = [v for k, v in rows if k == g]
        for name, q in points.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), abs=1e-12), (g, name)
    assert "e" not in got


def test_load_line_fields(spark):
    lines = [
        (1, "2026 load cloud=aws sent=60 ok=58 first_s=0.2 p50_s=.1 p95_s=.2 max_s=1 at=2026-10-05T18:04:00Z"),
        (1, "load cloud=AWS sent=60 ok=60 x at=2026-10-05T18:04:00Z"),
        (2, "nothing here"),
    ]
    df = spark.createDataFrame(lines, "run_id long, value string")
    rows = lr.parse_load_lines(df).collect()
    assert [(r["run_id"], r["cloud"], r["sent"], r["ok"], r["run_at"]) for r in rows] == [
        (1, "aws", 60, 58, datetime(2026, 10, 5, 18, 4))
    ]
    assert [r["run_id"] for r in lr.runs_without_result(df).collect()] == [2]


# --- incidents ---------------------------------------------------------------


def flaky_run(spark, seconds=180, failing=10, clouds=("gcp", "aws", "azure"), first=0):
    """A request a second, ``failing`` of every ten with a 500, sampled at the end of each second."""
    rows = []
    for cloud in clouds:
        ok = bad = 0
        for s in range(seconds):
            if s % 10 < failing:
                bad += 1
            else:
                ok += 1
            for status, value in (("200", ok), ("500", bad)):
                rows.append((cloud, "/flaky", "GET", status, at(first + s + 1), at(first - 1), float(value)))
    return spark.createDataFrame(rows, SAMPLE)


def test_a_firing_test_opens_one_incident_per_cloud(spark):
    breaches = inc.error_breaches(sr.counter_deltas(flaky_run(spark, failing=3)))
    got = inc.incidents(breaches).collect()
    assert sorted(r["cloud"] for r in got) == ["aws", "azure", "gcp"]
    assert all(r["peak"] == pytest.approx(0.3) for r in got)
    assert all(r["opened_at"] == at(120) for r in got)  # true at 60 s, held at 120 s


def test_quiet_and_silent_clouds_do_not_fire(spark):
    one = sr.counter_deltas(samples(spark, (0, 1, -60), status="500", route="/flaky"))
    assert inc.error_breaches(one).count() == 0
    assert inc.error_breaches(one.filter(F.lit(False))).count() == 0
    few_errors = sr.counter_deltas(flaky_run(spark, failing=1, clouds=("aws",)))
    assert inc.error_breaches(few_errors).count() == 0  # 0.1 is not over 0.1


def test_exactly_fifteen_requests_are_not_enough(spark):
    enough = {n: sr.counter_deltas(samples(spark, (0, n, -60), status="500", route="/flaky")) for n in (15, 16)}
    assert inc.error_breaches(enough[15]).count() == 0
    assert inc.error_breaches(enough[16]).count() > 0


def breach_rows(spark, minutes):
    rows = [("p", "aws", at(60 * k), float(k)) for k in minutes]
    return spark.createDataFrame(rows, "policy string, cloud string, eval_ts timestamp, value double")


@pytest.mark.parametrize(
    ("minutes", "expected"),
    [
        ([1], []),  # not held
        ([1, 2], [(2, 2)]),
        ([1, 3, 5], []),  # never two in a row
        ([1, 2, 20, 21, 22], [(2, 22)]),  # firing again within half an hour
        ([1, 2, 32, 33], [(2, 2), (33, 33)]),  # 31 minutes later
        ([1, 2, 31, 32], [(2, 32)]),  # exactly half an hour
    ],
)
def test_incident_spells(spark, minutes, expected):
    rows = inc.incidents(breach_rows(spark, minutes)).orderBy("incident").collect()
    assert [(r["opened_at"], r["last_firing"]) for r in rows] == [(at(60 * a), at(60 * b)) for a, b in expected]


def test_open_incident_has_no_closing_time(spark):
    rows = inc.incidents(breach_rows(spark, [1, 2]), as_of=at(60 * 31)).collect()
    assert rows[0]["closed_at"] is None
    rows = inc.incidents(breach_rows(spark, [1, 2]), as_of=at(60 * 32)).collect()
    assert rows[0]["closed_at"] == at(60 * 32)


def test_slow_cloud_fires(spark):
    requests = spark.createDataFrame(
        [("aws", "/", "GET", "200", at(s), at(-1), 2.0) for s in range(180)],
        "cloud string, route string, method string, status string, ts timestamp, start_ts timestamp, seconds double",
    )
    slow = sr.counter_deltas(d.scrape_histograms(requests), [*sr.HISTOGRAM_SERIES, "le"])
    got = inc.incidents(inc.latency_breaches(slow)).collect()
    assert [r["policy"] for r in got] == ["p95 latency"]


def test_stored_scrapes_are_read_once(spark, folder):
    rows = [("t", at(0), "process_start_time_seconds", 5.0), ("t", at(0), "m", 1.0)]
    spark.createDataFrame(rows, "target string, ts timestamp, metric string, value double").write.parquet(folder)
    stamped = sr.stamp_start_time(spark.read.parquet(folder))
    assert stamped._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_sketched_percentiles_are_exact_on_any_scale(spark, scale):
    rng = random.Random(9)
    rows = [("a", rng.lognormvariate(0, 3) * scale) for _ in range(20_000)] + [("b", 0.25)] * 50 + [("b", 0.5)] * 3
    rows += [("c", 1.5), ("d", 1.0), ("d", 2.0), ("e", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = {"low": 0.0, "mid": 0.5, "p95": 0.95, "near": 0.9999, "top": 1.0}
    got = {r["g"]: r for r in lr.sketched_percentiles(df, ["g"], "v", points, F.count("v").alias("n")).collect()}
    for g in ("a", "b", "c", "d", None):
        values = [v for k, v in rows if k == g]
        for name, q in points.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12), (g, name)
    assert (got["e"]["mid"], got["e"]["n"], got["a"]["n"]) == (None, 0, 20_000)


def test_latencies_are_read_twice_and_no_more(spark, folder):
    spark.createDataFrame([("r", at(i), float(i)) for i in range(30)], "run string, ts timestamp, seconds double").write.parquet(folder)
    made = lr.latency_summary(spark.read.parquet(folder), ["run"])
    row = made.first()
    assert (row["first_s"], row["p50_s"], row["max_s"], row["timed"]) == (0.0, 14.5, 29.0, 30)
    made.collect()
    final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2 and "ReusedExchange" in final


def slow_value_at(asked, rows, lookback):
    out = []
    for cloud, t in asked:
        before = [(s, v) for c, s, v in rows if c == cloud and t is not None and s <= t]
        last = max(before, default=None)
        near = last is not None and t - last[0] < lookback
        out.append((cloud, t, last[1] if near else None, "fresh" if near else "stale" if before else "missing"))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", [1, 3, 100])
def test_value_at_any_instant(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["aws", "gcp", None]), rng.randrange(-20_000, 20_000), float(rng.randrange(9))) for _ in range(300)]
    asked = [(rng.choice(["aws", "gcp", "none", None]), rng.randrange(-25_000, 25_000)) for _ in range(300)] + [("aws", None), ("aws", 7), ("aws", 7)]
    asked += [(c, s + d) for c, s, _ in rows[:40] for d in (0, 299, 300)]
    samples_ = spark.createDataFrame([(c, at(s), v) for c, s, v in rows] + [("aws", None, 1.0), ("aws", at(0), None)], "cloud string, ts timestamp, value double")
    probes = spark.createDataFrame([(c, None if s is None else at(s), s) for c, s in asked], "cloud string, at timestamp, s long")
    got = m.value_at(probes, samples_, ["cloud"], lookback_s=300, slices=slices).collect()
    assert sorted([(r["cloud"], r["s"], r["value"], r["state"]) for r in got], key=str) == slow_value_at(asked, rows, 300)


def test_instants_of_a_busy_series_are_spread_over_tasks(spark):
    rows = spark.range(20000).select(
        F.lit("aws").alias("cloud"), F.timestamp_seconds(F.col("id") * 30 + 1791000000).alias("ts"), F.col("id").cast("double").alias("value")
    )
    asked = rows.select("cloud", F.col("ts").alias("at"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        told = m.value_at(asked, rows, ["cloud"])
        sizes = [r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 3
    assert told.filter("state = 'fresh'").agg(F.sum("value")).first()[0] == sum(range(20000))


def test_stored_samples_are_read_once_for_their_increments(spark, folder):
    rows = spark.range(3000).select(
        F.lit("aws").alias("cloud"), F.timestamp_seconds(F.col("id") * 300 + 1791000000).alias("ts"), F.timestamp_seconds(F.lit(1791000000)).alias("start_ts"),
        F.col("id").cast("double").alias("value"), F.lit("kept").alias("note"),
    )
    rows.write.parquet(folder)
    made = sr.counter_deltas(spark.read.parquet(folder), ["cloud"])
    assert sum(r["delta"] for r in made.collect()) == 2999.0
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
