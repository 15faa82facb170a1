"""Streams against their batch definitions, over several batches and a restart."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_telemetry import SAMPLE, at, flaky_run

from cloudtally.operators import incidents as inc
from cloudtally.operators import series as sr
from cloudtally.operators.incidents import AlertRules
from cloudtally.streaming import alerts, corrections, increments, sinks, sources


def feed(spark, df, root, cuts):
    """Write rows as one file per time range, oldest first."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = df.filter((F.col("ts") >= F.lit(at(a))) & (F.col("ts") < F.lit(at(b)))).coalesce(1)
        part.write.mode("append").parquet(f"{root}/in")


def run(df, root, name):
    sinks.write_stream(df, f"{root}/{name}", f"{root}/{name}-ck", None, 2).awaitTermination()


def step_stream(spark, root, files=1):
    schema = spark.read.parquet(f"{root}/in").schema
    return increments.step_increments(sources.stream_files(spark, f"{root}/in", schema, files_per_trigger=files))


def by_step(rows):
    return {(r["cloud"], r["status"], r["ts"]): r["delta"] for r in rows}


def test_stream_agrees_with_batch_over_batches_and_restarts(spark, folder):
    first = flaky_run(spark, seconds=200, failing=3, clouds=("aws", "gcp"))
    second = flaky_run(spark, seconds=200, failing=3, clouds=("aws", "gcp"), first=230)  # a new process
    everything = first.unionByName(second)
    feed(spark, everything, folder, [0, 70, 150, 300])
    run(step_stream(spark, folder), folder, "steps")  # stops, then goes on from its checkpoint
    feed(spark, everything, folder, [300, 400, 500])
    feed(spark, flaky_run(spark, seconds=1, clouds=("aws",), first=2000), folder, [2000, 2100])  # moves the watermark
    run(step_stream(spark, folder), folder, "steps")

    step = F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), "60 seconds")["start"]
    batch = sr.counter_deltas(everything).groupBy("cloud", "status", step.alias("ts")).agg(F.sum("delta").alias("delta"))
    got = spark.read.parquet(f"{folder}/steps")
    assert by_step(got.collect()) == by_step(batch.collect())

    # The same incidents as the batch replay.
    rules = AlertRules()
    columns = ["cloud", "route", "method", "status", "ts", "delta"]
    tail = spark.createDataFrame([("aws", "/", "GET", "200", at(90000), 0.0)], got.select(*columns).schema)
    tail.write.mode("append").parquet(f"{folder}/steps-in")
    got.write.mode("append").parquet(f"{folder}/steps-in")
    stream = sources.stream_files(spark, f"{folder}/steps-in", got.schema)
    run(alerts.stream_incidents(alerts.stream_error_breaches(stream, rules), rules), folder, "events")
    events = spark.read.parquet(f"{folder}/events")
    spell = ["cloud", "opened_at", "last_firing", "evaluations"]
    closed = events.filter("event = 'closed'").select(*spell).collect()
    replay = inc.incidents(inc.error_breaches(sr.counter_deltas(everything), rules), rules).select(*spell).collect()
    assert sorted(closed) == sorted(replay)
    assert events.filter("event = 'opened'").count() == len(replay) == 2


def test_a_late_sample_is_dropped(spark, folder):
    def one(second, value):
        row = [("aws", "/", "GET", "200", at(second), at(-1), float(value))]
        return spark.createDataFrame(row, SAMPLE)

    for second, value in ((10, 1), (3000, 5), (20, 99), (6000, 7)):
        one(second, value).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(step_stream(spark, folder), folder, "steps")
    got = spark.read.parquet(f"{folder}/steps").orderBy("ts").collect()
    assert [r["delta"] for r in got] == [1.0, 4.0]


def test_log_stream_keeps_records_only(spark, folder):
    lines = ['{"severity":"ERROR","message":"m","logger":"l","time":"2026-10-10T12:00:00+0000"}', "junk"]
    rows = spark.createDataFrame([("aws", x) for x in lines], "cloud string, value string")
    rows.coalesce(1).write.json(f"{folder}/in")
    run(sources.stream_logs(spark, f"{folder}/in"), folder, "out")
    got = spark.read.parquet(f"{folder}/out").collect()
    assert [(r["severity"], r["ts"]) for r in got] == [("ERROR", datetime(2026, 10, 10, 12))]


def test_settings_are_given_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with sinks.stream_settings(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == sinks.STATE_STORE
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_files_per_trigger_limits_a_batch(spark, folder):
    rows = flaky_run(spark, seconds=30, clouds=("aws",))
    feed(spark, rows, folder, [0, 10, 20, 30])
    stream = sources.stream_files(spark, f"{folder}/in", rows.schema, files_per_trigger=1)
    run(stream, folder, "out")
    commits = [f for f in os.listdir(f"{folder}/out-ck/commits") if not f.startswith(".")]
    assert len(commits) == 3




def test_a_stream_on_an_interval_picks_up_new_files(spark, folder):
    rows = flaky_run(spark, seconds=20, clouds=("aws",))
    feed(spark, rows, folder, [0, 12])
    query = sinks.write_stream(sources.stream_files(spark, f"{folder}/in", rows.schema), f"{folder}/out", f"{folder}/ck", every="1 second")
    try:
        query.processAllAvailable()
        early = spark.read.parquet(f"{folder}/out").count()
        feed(spark, rows, folder, [12, 60])
        query.processAllAvailable()
        assert query.isActive and 0 < early < spark.read.parquet(f"{folder}/out").count() == rows.count()
    finally:
        query.stop()


def lines(spark, folder, *rows):
    kind = "kind string, target string, cloud string, ts timestamp, value string"
    spark.createDataFrame([(k, "t", "aws", at(0), v) for k, v in rows], kind).coalesce(1).write.mode("append").json(f"{folder}/in")


LOG = '{"severity":"ERROR","message":"m","logger":"l","time":"2026-10-10T12:00:00+0000"}'


def test_a_batch_repeated_after_a_stop_adds_nothing_twice(spark, folder):
    """The log sink fails after the metric sink has had the batch; the stream is started again."""
    failing = [True]

    def logs(batch):
        if failing and batch.filter("value LIKE '%second%'").count():
            raise RuntimeError("the log sink is away")
        return sources.collected_logs(batch)

    targets = {f"{folder}/samples": sources.collected_samples, f"{folder}/logs": logs}

    def export():
        query = sinks.export_batches(sources.stream_collected(spark, f"{folder}/in", 1), targets, f"{folder}/ck", every="1 second")
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    lines(spark, folder, ("scrape", "m 1"), ("log", LOG))
    export()
    lines(spark, folder, ("scrape", "m 2"), ("log", LOG.replace('"m"', '"second"')))
    with pytest.raises(Exception, match="the log sink is away"):
        export()
    assert sorted(r["value"] for r in spark.read.parquet(f"{folder}/samples").collect()) == [1.0, 2.0]
    assert spark.read.parquet(f"{folder}/logs").count() == 1
    failing.clear()
    lines(spark, folder, ("scrape", "m 3"), ("log", "junk"))
    export()
    assert sorted(r["value"] for r in spark.read.parquet(f"{folder}/samples").collect()) == [1.0, 2.0, 3.0]
    assert sorted(r["message"] for r in spark.read.parquet(f"{folder}/logs").collect()) == ["m", "second"]


def test_a_bad_line_goes_to_its_own_table_and_the_stream_goes_on(spark, folder):
    lines(spark, folder, ("scrape", 'm{a="x",a="y"} 1'), ("scrape", "m 2"))
    lines(spark, folder, ("scrape", 'm{a="x} 1'), ("scrape", "m 3"))
    targets = {f"{folder}/samples": sources.collected_samples, f"{folder}/rejects": sources.collected_rejects}
    sinks.export_batches(sources.stream_collected(spark, f"{folder}/in", 1), targets, f"{folder}/ck", every=None).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(f"{folder}/samples").collect()) == [2.0, 3.0]
    rejects = spark.read.parquet(f"{folder}/rejects").collect()
    assert sorted((r["target"], r["ts"], r["reason"]) for r in rejects) == [("t", at(0), "grammar"), ("t", at(0), "repeated label")]


def kept_of(spark, folder, files=1):
    schema = spark.read.parquet(f"{folder}/in").schema
    source = sources.stream_files(spark, f"{folder}/in", schema, files_per_trigger=files)
    sinks.export_batches(source, {f"{folder}/kept": lambda batch: batch}, f"{folder}/kept-ck", every=None).awaitTermination()
    return spark.read.parquet(f"{folder}/kept")


def test_late_samples_correct_the_steps_they_missed(spark, folder):
    def one(second, value):
        row = [("aws", "/", "GET", "200", at(second), at(-1), float(value))]
        return spark.createDataFrame(row, SAMPLE)

    # 10 s: 1; 3000 s: 5; then, late, 20 s: 3 and 70 s: 4; and 6000 s: 7
    for second, value in ((10, 1), (3000, 5), (20, 3), (70, 4), (6000, 7), (9000, 9)):
        one(second, value).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(step_stream(spark, folder), folder, "steps")
    emitted, kept = spark.read.parquet(f"{folder}/steps"), kept_of(spark, folder)
    late = corrections.late_samples(kept)
    assert sorted(r["value"] for r in late.collect()) == [3.0, 4.0]
    for _ in range(2):
        found = corrections.corrections(kept, emitted)
        assert {r["ts"]: r["delta"] for r in found.collect()} == {at(0): 2.0, at(60): 1.0, at(2940): -3.0}
    whole = corrections.corrected(emitted, found)
    assert {r["ts"]: r["delta"] for r in whole.collect()} == {at(0): 3.0, at(60): 1.0, at(2940): 1.0, at(5940): 2.0}


def test_a_stream_out_of_order_with_its_corrections_is_the_batch(spark, folder):
    rng = random.Random(5)
    rows = flaky_run(spark, seconds=400, failing=3, clouds=("aws", "gcp")).collect()
    rng.shuffle(rows)
    schema = flaky_run(spark, seconds=1, clouds=("aws",)).schema
    for k in range(0, len(rows), 1 + len(rows) // 5):
        spark.createDataFrame(rows[k : k + 1 + len(rows) // 5], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run(step_stream(spark, folder), folder, "steps")
    emitted, kept = spark.read.parquet(f"{folder}/steps"), kept_of(spark, folder)
    found = corrections.corrections(kept, emitted)
    assert found.count() > 0
    everything = spark.read.parquet(f"{folder}/in")
    step = F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), "60 seconds")["start"]
    batch = sr.counter_deltas(everything).groupBy("cloud", "status", step.alias("ts")).agg(F.sum("delta").alias("delta"))
    closed = {k: v for k, v in by_step(batch.collect()).items() if k[2].timestamp() + 60 <= max(r["ts"] for r in rows).timestamp() - 120.000001}
    got = {k: v for k, v in by_step(corrections.corrected(emitted, found).collect()).items()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in closed.items() if v}


def test_nothing_late_means_no_correction(spark, folder):
    feed(spark, flaky_run(spark, seconds=200, clouds=("aws",)), folder, [0, 70, 150, 300])
    run(step_stream(spark, folder), folder, "steps")
    assert corrections.corrections(kept_of(spark, folder), spark.read.parquet(f"{folder}/steps")).count() == 0
