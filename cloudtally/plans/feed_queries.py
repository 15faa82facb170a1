"""Registered queries that load, register views or run streams, then read back.

What they write goes to the shared scratch folder; each run takes a new one.
"""

from __future__ import annotations

import contextlib
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.functions.tags import tags_as_text
from cloudtally.operators import cost, focus, metrics, policy
from cloudtally.operators.series import HISTOGRAM_SERIES, SERIES, counter_deltas
from cloudtally.plans import cost_queries as cq
from cloudtally.plans import derived as d
from cloudtally.plans.load_queries import _LOGS
from cloudtally.plans.oracle_parts import ASSIGNED, BILL, RUNS, UNIT, dbl
from cloudtally.plans import check_queries as ck
from cloudtally.plans.load_queries import SCRAPED
from cloudtally.plans.telemetry_queries import BOUNDS, SAMPLES, ntz
from cloudtally.schemas import LOAD_RUNS, REQUESTS_DAILY
from cloudtally.session import scratch_dir
from cloudtally.sources import files, months, views
from cloudtally.streaming import alerts, corrections, increments, sinks, sources

S = SparkSession
DELAY, DELAY_S = "10 minutes", 600
STATE_PARTITIONS = 8
# Files a trigger takes: what bounds a batch when a stream catches up.
FILES = 64


def monthly_load(spark: S, sf: str) -> DataFrame:
    """The two-month load run twice: the second run replaces, so nothing is counted twice."""
    root = scratch_dir(spark, "aws-load")
    bill = d.aws_bill(spark, sf).withColumn("billing_period", F.date_format("billing_month", "yyyy-MM"))
    bill.drop("billing_month").write.partitionBy("billing_period").parquet(f"{root}/export")
    for _ in range(2):
        audit = months.load_aws(spark, f"{root}/export", f"{root}/raw", d.AS_OF)
    return audit.withColumn("billed_cost", F.col("billed_cost").cast("double"))


def pruned_unit_cost(spark: S, sf: str) -> DataFrame:
    """Recent unit cost over loaded tables: only the months that matter are read."""
    root = scratch_dir(spark, "pruned")
    d.aws_bill(spark, sf).write.partitionBy("billing_month").parquet(f"{root}/aws")
    d.azure_bill(spark, sf).write.partitionBy("billing_month").parquet(f"{root}/azure")
    raw = [files.read_export(spark, f"{root}/{name}") for name in ("aws", "azure")]
    since = cost.report_start(d.AS_OF, start=d.START)
    bills = focus.focus_since(*raw, d.gcp_bill(spark, sf), since)
    return cq._unit_out(cost.recent_unit_cost(cost.unit_cost(bills, d.load_runs(spark, sf), since, d.PLATFORM), d.AS_OF))


def azure_monthly_load(spark: S, sf: str) -> DataFrame:
    """The text bill's two months loaded from CSV, older copies of each month lying beside the newest."""
    root = scratch_dir(spark, "azure-load")
    bill = d.azure_bill(spark, sf).withColumn("subscriptionName", F.lit("lab, main"))
    for period, last in (("202312", "20231231"), ("202401", "20240131")):
        month = bill.filter(F.date_format("billing_month", "yyyyMM") == period).drop("billing_month")
        # An older copy holds part of the month; what is written last is the newest.
        for copy, rows in enumerate((month.filter(F.col("meterCategory") != "Storage"), month)):
            folder = f"{root}/export/{period}01-{last}/run-{9 - copy}"
            rows.write.option("escape", '"').csv(folder, header=True)
    for _ in range(2):
        audit = months.load_azure(spark, f"{root}/export", f"{root}/raw", d.AS_OF, line_breaks=False)
    return audit.withColumn("billed_cost", F.col("billed_cost").cast("double"))


def emptied_month(spark: S, sf: str) -> DataFrame:
    """A month rewritten with no rows, and another with a new column: what the table then holds."""
    root = scratch_dir(spark, "emptied")
    bill = d.aws_bill(spark, sf)
    parts = {p: bill.filter(F.date_format("billing_month", "yyyy-MM") == p).select("ProviderName", "BilledCost") for p in ("2023-12", "2024-01")}
    for period, rows in parts.items():
        months.replace_month(rows, f"{root}/raw", period)
    months.replace_month(parts["2023-12"].limit(0), f"{root}/raw", "2023-12")
    months.replace_month(parts["2024-01"].withColumn("x_Added", F.lit("new")), f"{root}/raw", "2024-01")
    held = files.read_export(spark, f"{root}/raw")
    return held.groupBy(F.col("billing_month").cast("date").alias("billing_month"), "x_Added").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("BilledCost").cast("decimal(38,9)")).alias("billed")
    ).withColumn("billed", cq.flat_money("billed"))


def failed_rewrite(spark: S, sf: str) -> DataFrame:
    """Two months loaded, then both rewritten by writes that break on some row: what the table then holds."""
    root = scratch_dir(spark, "failed-rewrite")
    bill = d.aws_bill(spark, sf).select("ResourceId", "BilledCost", F.date_format("billing_month", "yyyy-MM").alias("_period"))
    broken = F.when(F.col("ResourceId").endswith("3"), F.raise_error(F.lit("a row that cannot be written")).cast("double"))
    for period in ("2023-12", "2024-01"):
        month = bill.filter(F.col("_period") == period)
        months.replace_month(month.select("ResourceId", "BilledCost"), f"{root}/raw", period)
        twice = month.select("ResourceId", broken.otherwise(F.col("BilledCost") * 2).alias("BilledCost"))
        with contextlib.suppress(PySparkException, Py4JJavaError):
            months.replace_month(twice, f"{root}/raw", period)
    held = files.read_export(spark, f"{root}/raw")
    return held.groupBy(F.col("billing_month").cast("date").alias("billing_month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("BilledCost").cast("decimal(38,9)")).alias("billed")
    ).withColumn("billed", cq.flat_money("billed"))


def requests_daily_table(spark: S, sf: str) -> DataFrame:
    """Daily request counts kept as a table that every run replaces."""
    root = scratch_dir(spark, "requests-daily")
    deltas = counter_deltas(d.counter_samples(spark, sf))
    for as_of in (date(2024, 1, 20), d.AS_OF):
        daily = metrics.daily_requests(deltas, d.START, as_of).select(*REQUESTS_DAILY.names)
        files.replace_table(daily, f"{root}/table")
    return files.read_export(spark, f"{root}/table").select(*REQUESTS_DAILY.names)


def plan_files_verdicts(spark: S, sf: str) -> DataFrame:
    """Plans kept as files, one document each and named by its root, read whole and judged."""
    root = scratch_dir(spark, "plan-files")
    documents = d.plan_documents(spark, sf, keep_batch=True)
    files.write_documents(documents, f"{root}/plans", "root", "batch")
    read = files.read_documents(spark, f"{root}/plans", named_by="root")
    return policy.verdicts(policy.plan_findings(read), (*d.ROOTS, "empty"))


def text_csv_bill(spark: S, sf: str) -> DataFrame:
    """The text bill written as CSV, with quotes and line breaks in values, and read back."""
    root = scratch_dir(spark, "azure-csv")
    d.azure_bill(spark, sf).drop("billing_month").write.option("escape", '"').csv(f"{root}/csv", header=True)
    bill = focus.focus_azure(files.read_text_csv(spark, f"{root}/csv"))
    return (
        bill.groupBy("SubAccountName", "ChargeCategory", "ServiceName", tags_as_text(F.col("Tags")).alias("tags"))
        .agg(F.count(F.lit(1)).alias("charges"), F.sum("BilledCost").alias("billed"))
        .withColumn("billed", cq.flat_money("billed"))
    )


def split_csv_bill(spark: S, sf: str) -> DataFrame:
    """The same bill read by many tasks: values with quotes and line breaks, the files cut anywhere."""
    root = scratch_dir(spark, "split-csv")
    d.azure_bill(spark, sf).drop("billing_month").write.option("escape", '"').csv(f"{root}/csv", header=True)
    bill = focus.focus_azure(files.read_split_csv(spark, f"{root}/csv"))
    return (
        bill.groupBy("SubAccountName", "ChargeCategory", "ServiceName", tags_as_text(F.col("Tags")).alias("tags"))
        .agg(F.count(F.lit(1)).alias("charges"), F.sum("BilledCost").alias("billed"))
        .withColumn("billed", cq.flat_money("billed"))
    )


def json_table_load(spark: S, sf: str) -> DataFrame:
    """Load runs as JSON lines, read with their schema, the table replaced twice."""
    root = scratch_dir(spark, "load-runs")
    runs = d.load_runs(spark, sf).withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    runs.write.json(f"{root}/lines")
    for _ in range(2):
        files.replace_table(files.read_json_lines(spark, f"{root}/lines", LOAD_RUNS), f"{root}/table")
    return ntz(files.read_export(spark, f"{root}/table"), "run_at")


def _views(spark: S, sf: str) -> None:
    raw = {
        "aws_focus": d.aws_bill, "azure_actual": d.azure_bill, "gcp_focus": d.gcp_bill,
        "gcp_detailed": d.gcp_detailed, "load_runs": d.load_runs,
    }
    for name, make in raw.items():
        make(spark, sf).createOrReplaceTempView(name)
    views.create_views(spark, d.START, d.PLATFORM)


def view_recent_unit_cost(spark: S, sf: str) -> DataFrame:
    _views(spark, sf)
    return cq._unit_out(views.recent_unit_cost(spark, d.AS_OF, d.START, d.PLATFORM))


def view_recent_spend(spark: S, sf: str) -> DataFrame:
    _views(spark, sf)
    return views.recent_spend(spark, d.AS_OF, above=1000.0).withColumn("cost", cq.flat_money("cost", 4))


def log_stream(spark: S, sf: str) -> DataFrame:
    """Logs streamed into a table, then counted."""
    root = scratch_dir(spark, "logs")
    d.app_logs(spark, sf).write.json(f"{root}/in")
    query = sinks.write_stream(sources.stream_logs(spark, f"{root}/in"), f"{root}/out", f"{root}/ck", every=None)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("cloud", "severity").agg(F.count(F.lit(1)).alias("records"))


def scrape_stream(spark: S, sf: str) -> DataFrame:
    """Exposition text streamed into sample rows, then counted."""
    root = scratch_dir(spark, "scrapes")
    d.exposition_lines(spark, sf).write.json(f"{root}/in")
    stream = sources.stream_scrapes(spark, f"{root}/in", files_per_trigger=4)
    sinks.write_stream(stream, f"{root}/out", f"{root}/ck", every=None).awaitTermination()
    counters = spark.read.parquet(f"{root}/out").filter(F.col("metric") == "app_requests_total")
    return counters.groupBy("cloud", F.col("labels")["route"].alias("route"), F.col("labels")["status"].alias("status")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("highest")
    )


def _collected(spark: S, sf: str, scrapes: DataFrame, root: str) -> DataFrame:
    """Scrapes and logs in one folder of JSON lines, as a stream."""
    lines = scrapes.select(F.lit(sources.SCRAPE).alias("kind"), "target", "cloud", "ts", "value")
    logs = d.app_logs(spark, sf).select(
        F.lit(sources.LOG).alias("kind"), F.lit(None).cast("string").alias("target"), "cloud", F.lit(None).cast("timestamp").alias("ts"), "value"
    )
    lines.unionByName(logs).write.json(f"{root}/in")
    return sources.stream_collected(spark, f"{root}/in", files_per_trigger=FILES)


def two_sink_export(spark: S, sf: str) -> DataFrame:
    """What a collector takes in, sent to a metric table and a log table on an interval, the stream stopped and started again."""
    root = scratch_dir(spark, "export")
    stream = _collected(spark, sf, d.exposition_lines(spark, sf), root)
    targets = {f"{root}/samples": sources.collected_samples, f"{root}/logs": sources.collected_logs}
    for _ in range(2):
        query = sinks.export_batches(stream, targets, f"{root}/ck", every="1 second")
        query.processAllAvailable()
        query.stop()
    samples, logs = (spark.read.parquet(path) for path in targets)
    counted = [
        rows.groupBy("cloud", name.alias("name")).agg(F.count(F.lit(1)).alias("rows")).withColumn("sink", F.lit(sink))
        for sink, rows, name in (("metrics", samples, F.col("metric")), ("logs", logs, F.col("severity")))
    ]
    return counted[0].unionByName(counted[1])


def scrape_quarantine(spark: S, sf: str) -> DataFrame:
    """Scrapes with lines that break the rules: samples go to one table, those lines to another, and the stream goes on."""
    root = scratch_dir(spark, "quarantine")
    stream = _collected(spark, sf, d.broken_exposition_lines(spark, sf), root)
    targets = {f"{root}/samples": sources.collected_samples, f"{root}/rejects": sources.collected_rejects}
    sinks.export_batches(stream, targets, f"{root}/ck", every=None).awaitTermination()
    samples = spark.read.parquet(f"{root}/samples").filter(F.col("metric") == "app_requests_total").withColumn("reason", F.lit("none"))
    rejects = spark.read.parquet(f"{root}/rejects")
    rows = samples.select("target", "ts", "reason").unionByName(rejects.select("target", "ts", "reason"))
    return rows.groupBy(F.substring_index("target", "/", 1).alias("cloud"), "reason").agg(
        F.count(F.lit(1)).alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).transform(lambda df: ntz(df, "first_ts", "last_ts"))


def stream_corrected(spark: S, sf: str) -> DataFrame:
    """Increments off a stream whose samples come in no order, most of them late, with the corrections added."""
    root = scratch_dir(spark, "corrected")
    # Every file holds some samples of all times, so after the first files most steps are closed.
    d.counter_samples(spark, sf).repartition(12, F.xxhash64("cloud", "route", "status", "ts")).write.parquet(f"{root}/samples")
    schema = spark.read.parquet(f"{root}/samples").schema
    source = lambda: sources.stream_files(spark, f"{root}/samples", schema, files_per_trigger=3)
    made = increments.step_increments(source(), f"{d.STEP_S} seconds", DELAY)
    sinks.write_stream(made, f"{root}/increments", f"{root}/ck1", None, STATE_PARTITIONS).awaitTermination()
    sinks.export_batches(source(), {f"{root}/kept": lambda batch: batch}, f"{root}/ck2", every=None).awaitTermination()
    emitted, kept = spark.read.parquet(f"{root}/increments"), spark.read.parquet(f"{root}/kept")
    found = corrections.corrections(kept, emitted, d.STEP_S, DELAY_S)
    return ntz(corrections.corrected(emitted, found).select("cloud", "route", "status", "ts", "delta"), "ts")


def _increments(spark: S, root: str, samples: DataFrame, series: tuple[str, ...] = SERIES) -> str:
    samples.write.parquet(f"{root}/samples")
    schema = spark.read.parquet(f"{root}/samples").schema
    stream = increments.step_increments(
        sources.stream_files(spark, f"{root}/samples", schema, files_per_trigger=FILES), f"{d.STEP_S} seconds", DELAY, series
    )
    sinks.write_stream(stream, f"{root}/increments", f"{root}/ck1", None, STATE_PARTITIONS).awaitTermination()
    return f"{root}/increments"


def _incident_events(spark: S, root: str, path: str, breaches) -> DataFrame:
    # Increments leave the first stream once and in time order, a batch's files together.
    rows = sources.stream_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=FILES)
    rules = d.alert_rules()
    events = alerts.stream_incidents(breaches(rows, rules, DELAY), rules)
    sinks.write_stream(events, f"{root}/events", f"{root}/ck2", None, STATE_PARTITIONS).awaitTermination()
    return ntz(spark.read.parquet(f"{root}/events"), "opened_at", "last_firing").withColumn("peak", F.round("peak", 9))


def stream_increments(spark: S, sf: str) -> DataFrame:
    """Increments per step off a stream of samples, for the steps the watermark closed."""
    made = spark.read.parquet(_increments(spark, scratch_dir(spark, "increments"), d.counter_samples(spark, sf)))
    return ntz(made.select("cloud", "route", "status", "ts", "delta"), "ts")


def stream_incidents(spark: S, sf: str) -> DataFrame:
    """Samples to increments to breaches to incident events, all streamed."""
    root = scratch_dir(spark, "incidents")
    return _incident_events(spark, root, _increments(spark, root, d.counter_samples(spark, sf)), alerts.stream_error_breaches)


def stream_latency_incidents(spark: S, sf: str) -> DataFrame:
    """The same for the 95th percentile, from histogram buckets."""
    root = scratch_dir(spark, "latency-incidents")
    path = _increments(spark, root, d.bucket_samples(spark, sf), (*HISTOGRAM_SERIES, "le"))
    return _incident_events(spark, root, path, alerts.stream_latency_breaches)


QUERIES = {
    f.__name__: f
    for f in (
        monthly_load, azure_monthly_load, emptied_month, failed_rewrite, pruned_unit_cost, requests_daily_table, plan_files_verdicts, text_csv_bill, split_csv_bill,
        json_table_load, view_recent_unit_cost, view_recent_spend, log_stream, scrape_stream, two_sink_export, scrape_quarantine,
        stream_increments, stream_corrected, stream_incidents, stream_latency_incidents,
    )
}

# Steps the watermark has closed: it trails the newest sample by ten minutes.
CLOSED = SAMPLES + """,
steps AS (
  SELECT cloud, route, status, CAST(date_trunc('hour', ts - INTERVAL 1 MICROSECOND) AS TIMESTAMP) AS ts, CAST(sum(n) AS DOUBLE) AS delta
  FROM samples GROUP BY cloud, route, status, date_trunc('hour', ts - INTERVAL 1 MICROSECOND)
),
closed AS (SELECT * FROM steps WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM samples) - INTERVAL '600000001 microseconds')"""

# From breaches (bad: cloud, eval_ts, value) on to incidents.
SPELLS = """,
islands AS (SELECT *, epoch(eval_ts)::BIGINT // 3600 - row_number() OVER (PARTITION BY cloud ORDER BY eval_ts) AS island FROM bad),
held AS (SELECT *, min(eval_ts) OVER (PARTITION BY cloud, island) AS since FROM islands),
firing AS (SELECT * FROM held WHERE eval_ts > since),
marked AS (SELECT *, CASE WHEN lag(eval_ts) OVER w IS NULL OR eval_ts - lag(eval_ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh
  FROM firing WINDOW w AS (PARTITION BY cloud ORDER BY eval_ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY cloud ORDER BY eval_ts) AS incident FROM marked),
incidents AS (SELECT cloud, incident, min(eval_ts) AS opened_at, max(eval_ts) AS last_firing, count(*) AS evaluations,
  max(value) AS peak, arg_min(value, eval_ts) AS first_value, max(incident) OVER (PARTITION BY cloud) AS newest FROM numbered GROUP BY 1, 2)"""

EVENTS = CLOSED + """,
good AS (SELECT * FROM closed WHERE route <> 'unmatched'),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM good),
evals AS (
  SELECT cloud, CAST(ts + INTERVAL 1 HOUR * k AS TIMESTAMP) AS eval_ts, sum(CASE WHEN status = '500' THEN delta END) AS errors, sum(delta) AS total
  FROM good, (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2
),
bad AS (SELECT cloud, eval_ts, errors / total AS value FROM evals, mark WHERE eval_ts <= wm AND total > 15 AND errors / total > 0.3)""" + SPELLS

LATENCY_EVENTS = SCRAPED + f""",
stepped AS (SELECT *, CAST(date_trunc('hour', scrape_ts - INTERVAL 1 MICROSECOND) AS TIMESTAMP) AS step FROM scraped WHERE route <> 'unmatched'),
good AS (SELECT * FROM stepped WHERE step + INTERVAL 1 HOUR <= (SELECT max(scrape_ts) FROM scraped) - INTERVAL '600000001 microseconds'),
mark AS (SELECT max(step) - INTERVAL 10 MINUTE AS wm FROM good),
bk AS (SELECT cloud, CAST(step + INTERVAL 1 HOUR * k AS TIMESTAMP) AS eval_ts, le, count(*) FILTER (seconds <= le) AS n
  FROM good, (SELECT unnest(range(1, 7)) AS k), {BOUNDS} GROUP BY 1, 2, 3),
edges AS (SELECT *, lag(le, 1, 0.0) OVER w AS lo, lag(n, 1, 0) OVER w AS below, max(n) OVER (PARTITION BY cloud, eval_ts) AS total
  FROM bk WINDOW w AS (PARTITION BY cloud, eval_ts ORDER BY le)),
p95 AS (SELECT cloud, eval_ts, total, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * ((0.95::DOUBLE * total - below) / (n - below)) END AS value
  FROM edges WHERE n >= 0.95::DOUBLE * total AND below < 0.95::DOUBLE * total),
bad AS (SELECT cloud, eval_ts, value FROM p95, mark WHERE eval_ts <= wm AND total > 15 AND value > 0.15)""" + SPELLS


def _events_sql(policy: str, events: str) -> str:
    return f"""WITH {events}
        SELECT '{policy}' AS policy, cloud, 'opened' AS event, opened_at, opened_at AS last_firing, CAST(1 AS BIGINT) AS evaluations,
          round(first_value, 9) AS peak FROM incidents
        UNION ALL
        SELECT '{policy}', cloud, 'closed', opened_at, last_firing, evaluations, round(peak, 9) FROM incidents, mark
        WHERE incident < newest OR last_firing + INTERVAL 4 HOUR <= wm"""


ORACLE = {
    "monthly_load": f"""WITH {BILL} SELECT strftime(month, '%Y-%m') AS period, count(*) AS row_count, {dbl('sum(gross)', 'billed_cost', 4)}
        FROM charge WHERE provider = 'AWS' GROUP BY 1""",
    "azure_monthly_load": f"""WITH {BILL} SELECT strftime(month, '%Y-%m') AS period, count(*) AS row_count, {dbl('sum(gross)', 'billed_cost', 4)}
        FROM charge WHERE provider = 'Microsoft' GROUP BY 1""",
    "emptied_month": f"""WITH {BILL} SELECT DATE '2024-01-01' AS billing_month, 'new' AS "x_Added", count(*) AS row_count, {dbl('sum(gross)', 'billed')}
        FROM charge WHERE provider = 'AWS' AND month = DATE '2024-01-01'""",
    "failed_rewrite": f"""WITH {BILL} SELECT month AS billing_month, count(*) AS row_count, {dbl('sum(gross)', 'billed')}
        FROM charge WHERE provider = 'AWS' GROUP BY 1""",
    "pruned_unit_cost": f"WITH {UNIT} {cq._UNIT_SELECT} WHERE day >= DATE '2024-01-23'",
    "requests_daily_table": f"""WITH {SCRAPED} SELECT CAST(scrape_ts - INTERVAL 1 MICROSECOND AS DATE) AS day, cloud, count(*)::DOUBLE AS requests
        FROM scraped WHERE route <> 'unmatched' AND scrape_ts > TIMESTAMP '2024-01-01' AND scrape_ts <= TIMESTAMP '2024-01-30' GROUP BY 1, 2""",
    "plan_files_verdicts": ck.ORACLE["policy_verdicts"],
    "text_csv_bill": f"""WITH {BILL}, f AS ({cq._AZURE_FLAT}) SELECT "SubAccountName", "ChargeCategory", "ServiceName", "Tags" AS tags,
        count(*) AS charges, CAST(sum(CAST("BilledCost" AS DECIMAL(38,6))) AS DOUBLE) AS billed FROM f GROUP BY 1, 2, 3, 4""",
    "split_csv_bill": f"""WITH {BILL}, f AS ({cq._AZURE_FLAT}) SELECT "SubAccountName", "ChargeCategory", "ServiceName", "Tags" AS tags,
        count(*) AS charges, CAST(sum(CAST("BilledCost" AS DECIMAL(38,6))) AS DOUBLE) AS billed FROM f GROUP BY 1, 2, 3, 4""",
    "json_table_load": f"WITH {RUNS} SELECT run_id, cloud, sent, ok, run_at FROM runs",
    "view_recent_unit_cost": f"WITH {UNIT} {cq._UNIT_SELECT} WHERE day >= DATE '2024-01-23'",
    "view_recent_spend": f"""WITH {ASSIGNED} SELECT day, provider AS "ProviderName", service AS "ServiceName", project,
        {dbl('sum(billed)', 'cost', 4)} FROM assigned WHERE day >= DATE '2024-01-23' GROUP BY 1, 2, 3, 4
        HAVING round(sum(billed), 4) > 1000""",
    "log_stream": f"""WITH {_LOGS} SELECT cloud, severity, count(*) AS records FROM logs WHERE event_id % 101 <> 0 GROUP BY 1, 2""",
    "scrape_stream": f"""WITH {SAMPLES} SELECT cloud, route, status, count(*) AS samples, max(value) AS highest FROM samples GROUP BY 1, 2, 3""",
    "two_sink_export": f"""WITH {SAMPLES}, logs AS (SELECT cloud, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'WARNING' ELSE 'INFO' END AS severity
          FROM req WHERE event_id % 101 <> 0)
        SELECT 'metrics' AS sink, cloud, name, count(*) AS rows FROM samples, (VALUES ('app_requests_total'), ('process_start_time_seconds')) n(name) GROUP BY 2, 3
        UNION ALL SELECT 'logs', cloud, severity, count(*) FROM logs GROUP BY 2, 3""",
    "scrape_quarantine": f"""WITH {SAMPLES} SELECT cloud,
          CASE CAST(epoch(ts) AS BIGINT) // 600 % 11 WHEN 1 THEN 'repeated label' WHEN 2 THEN 'grammar' WHEN 3 THEN 'grammar' WHEN 4 THEN 'no number' ELSE 'none' END AS reason,
          count(*) AS lines, CAST(min(ts) AS TIMESTAMP) AS first_ts, CAST(max(ts) AS TIMESTAMP) AS last_ts FROM samples GROUP BY 1, 2""",
    "stream_corrected": f"WITH {CLOSED} SELECT cloud, route, status, ts, delta FROM closed",
    "stream_increments": f"WITH {CLOSED} SELECT cloud, route, status, ts, delta FROM closed",
    "stream_incidents": _events_sql("error ratio", EVENTS),
    "stream_latency_incidents": _events_sql("p95 latency", LATENCY_EVENTS),
}
