"""Registered queries for load runs, latencies and logs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.operators import load_runs as lr
from cloudtally.operators.cost import estate_requests
from cloudtally.operators.metrics import daily_requests, telemetry_gaps
from cloudtally.operators.reconcile import compare_request_counts
from cloudtally.operators.series import counter_deltas
from cloudtally.plans import derived as d
from cloudtally.plans.oracle_parts import REQ, RUNS

S = SparkSession


def load_lines_parsed(spark: S, sf: str) -> DataFrame:
    return lr.parse_load_lines(d.load_lines(spark, sf)).withColumn("run_at", F.col("run_at").cast("timestamp_ntz"))


def runs_without_result(spark: S, sf: str) -> DataFrame:
    return lr.runs_without_result(d.load_lines(spark, sf))


def completed_runs(spark: S, sf: str) -> DataFrame:
    runs = lr.completed_runs(d.run_list(spark, sf), datetime(2024, 1, 5))
    return runs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def runs_per_day(spark: S, sf: str) -> DataFrame:
    return lr.runs_per_day(d.load_runs(spark, sf))


def run_success(spark: S, sf: str) -> DataFrame:
    return lr.run_success(d.load_runs(spark, sf))


def schedule_coverage(spark: S, sf: str) -> DataFrame:
    """Counting only runs that reached every request; days without any are kept."""
    good = d.load_runs(spark, sf).filter(F.col("ok") == F.col("sent"))
    return lr.schedule_coverage(good, date(2023, 12, 30), date(2024, 1, 31))


def latency_by_run(spark: S, sf: str) -> DataFrame:
    timed = d.requests(spark, sf).withColumn("run_id", (F.unix_seconds(F.date_trunc("HOUR", "ts")) / 3600).cast("long"))
    return _rounded(lr.latency_summary(timed, ["run_id", "cloud"]))


def latency_by_cloud(spark: S, sf: str) -> DataFrame:
    """The same over all of a cloud's requests: a group that holds a third of the table."""
    return _rounded(lr.latency_summary(d.requests(spark, sf), ["cloud"]))


def _rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns({c: F.round(c, 9) for c in ("first_s", "max_s", "p50_s", "p95_s")})


def logs_by_severity(spark: S, sf: str) -> DataFrame:
    logs = lr.parse_logs(d.app_logs(spark, sf))
    return logs.groupBy("cloud", "severity", "logger").agg(
        F.count(F.lit(1)).alias("records"), F.max("ts").cast("timestamp_ntz").alias("newest")
    )


def errors_by_cloud(spark: S, sf: str) -> DataFrame:
    logs = lr.at_least(lr.parse_logs(d.app_logs(spark, sf)), "WARNING")
    return logs.groupBy("cloud", F.to_date("ts").alias("day"), lr.severity_rank(F.col("severity")).alias("rank")).agg(
        F.count(F.lit(1)).alias("records")
    )


def latest_errors(spark: S, sf: str) -> DataFrame:
    found = lr.latest_errors(lr.parse_logs(d.app_logs(spark, sf)), datetime(2024, 1, 20, 12), hours=24)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def messages_with_terms(spark: S, sf: str) -> DataFrame:
    logs = lr.parse_logs(d.app_logs(spark, sf))
    exact = lr.mentions_any(logs).groupBy("cloud").agg(F.count(F.lit(1)).alias("exact"))
    loose = lr.mentions_any(logs, ignore_case=True).groupBy("cloud").agg(F.count(F.lit(1)).alias("any_case"))
    return exact.join(loose, "cloud", "full")


def request_count_check(spark: S, sf: str) -> DataFrame:
    """Load record against telemetry; one cloud's collector missed its first days."""
    sent = estate_requests(d.load_runs(spark, sf)).withColumnRenamed("estate", "cloud")
    samples = d.counter_samples(spark, sf).filter((F.col("cloud") != "azure") | (F.col("start_ts") >= "2024-01-08"))
    stored = daily_requests(counter_deltas(samples), d.START, d.AS_OF)
    return compare_request_counts(sent, stored)


def telemetry_gap_hours(spark: S, sf: str) -> DataFrame:
    """Hours served according to the load, with no sample from that cloud."""
    down = (F.col("cloud") == "gcp") & (F.to_date("ts") == "2024-01-10")
    gaps = telemetry_gaps(d.load_runs(spark, sf), d.counter_samples(spark, sf).filter(~down))
    return gaps.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


QUERIES = {
    "load_lines_parsed": load_lines_parsed,
    "runs_without_result": runs_without_result,
    "completed_runs": completed_runs,
    "runs_per_day": runs_per_day,
    "run_success": run_success,
    "schedule_coverage": schedule_coverage,
    "latency_by_run": latency_by_run,
    "latency_by_cloud": latency_by_cloud,
    "logs_by_severity": logs_by_severity,
    "errors_by_cloud": errors_by_cloud,
    "latest_errors": latest_errors,
    "messages_with_terms": messages_with_terms,
    "request_count_check": request_count_check,
    "telemetry_gap_hours": telemetry_gap_hours,
}

_LOGS = REQ + """,
logs AS (
  SELECT cloud, event_id, ts, day,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS severity,
    event_type || ' request ' || event_id || CASE WHEN event_id % 10 = 0 THEN ' Denied' ELSE '' END AS message
  FROM req
)"""

# Requests with the scrape that first counts them.
SCRAPED = REQ + """,
scraped AS (
  SELECT *, CAST(time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS TIMESTAMP) AS scrape_ts FROM req
)"""


def _latency(by: str, group: str) -> str:
    return f"""WITH {REQ},
      t AS (SELECT *, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS run_id FROM req)
      SELECT {by}, round(arg_min(seconds, ts), 9) AS first_s, round(max(seconds), 9) AS max_s, count(*) AS timed,
        round(quantile_cont(seconds, 0.5), 9) AS p50_s, round(quantile_cont(seconds, 0.95), 9) AS p95_s
      FROM t GROUP BY {group}"""


ORACLE = {
    "load_lines_parsed": f"WITH {RUNS} SELECT run_id, cloud, sent, ok, run_at FROM runs WHERE run_id % 50 <> 0",
    "runs_without_result": f"WITH {RUNS} SELECT DISTINCT run_id FROM runs WHERE run_id % 50 = 0",
    "completed_runs": f"""WITH {RUNS} SELECT run_id, min(run_at) AS created_at, 'completed' AS status FROM runs
        WHERE run_id % 7 <> 0 AND run_at >= TIMESTAMP '2024-01-05' GROUP BY 1""",
    "runs_per_day": f"""WITH {RUNS} SELECT CAST(run_at AS DATE) AS day, cloud, count(*) AS runs, CAST(sum(ok) AS BIGINT) AS ok
        FROM runs GROUP BY 1, 2""",
    "run_success": f"""WITH {RUNS} SELECT run_id, bool_and(sent = ok) AS succeeded, count(*) AS estates,
        CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(ok) AS BIGINT) AS ok FROM runs GROUP BY 1""",
    "schedule_coverage": f"""WITH {RUNS},
      days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
      g AS (SELECT CAST(run_at AS DATE) AS day, count(DISTINCT run_id) AS runs FROM runs WHERE ok = sent GROUP BY 1)
      SELECT days.day, coalesce(runs, 0) AS runs, round(coalesce(runs, 0) / 24.0::DOUBLE, 6) AS coverage
      FROM days LEFT JOIN g ON days.day = g.day""",
    "latency_by_run": _latency("run_id, cloud", "run_id, cloud"),
    "latency_by_cloud": _latency("cloud", "cloud"),
    "logs_by_severity": f"""WITH {_LOGS},
      p AS (SELECT cloud, CASE WHEN event_id % 101 <> 0 THEN severity END AS severity,
              CASE WHEN event_id % 101 <> 0 THEN 'app' END AS logger, CASE WHEN event_id % 101 <> 0 THEN ts END AS ts FROM logs)
      SELECT cloud, severity, logger, count(*) AS records, CAST(date_trunc('second', max(ts)) AS TIMESTAMP) AS newest FROM p GROUP BY 1, 2, 3""",
    "errors_by_cloud": f"""WITH {_LOGS} SELECT cloud, day, CASE severity WHEN 'ERROR' THEN CAST(6 AS INTEGER) ELSE CAST(5 AS INTEGER) END AS rank,
        count(*) AS records FROM logs WHERE event_id % 101 <> 0 AND severity IN ('ERROR', 'WARNING') GROUP BY 1, 2, 3""",
    "latest_errors": f"""WITH {_LOGS} SELECT cloud, severity, message, 'app' AS logger, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts
        FROM logs WHERE event_id % 101 <> 0 AND severity = 'ERROR' AND date_trunc('second', ts) > TIMESTAMP '2024-01-19 12:00:00'
        AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20 12:00:00'
        ORDER BY date_trunc('second', ts) DESC, cloud, message LIMIT 20""",
    "messages_with_terms": f"""WITH {_LOGS} SELECT cloud, count(*) FILTER (severity = 'ERROR') AS exact,
        count(*) FILTER (severity = 'ERROR' OR event_id % 10 = 0) AS any_case
        FROM logs WHERE event_id % 101 <> 0 GROUP BY 1""",
    "request_count_check": f"""WITH {RUNS},
      sent AS (SELECT CAST(run_at AS DATE) AS day, cloud, CAST(sum(ok) AS DOUBLE) AS a FROM runs GROUP BY 1, 2),
      scr AS (SELECT *, CAST(time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS TIMESTAMP) AS scrape_ts FROM req),
      stored AS (SELECT CAST(scrape_ts - INTERVAL 1 MICROSECOND AS DATE) AS day, cloud, CAST(count(*) AS DOUBLE) AS b FROM scr
        WHERE route <> 'unmatched' AND scrape_ts <= TIMESTAMP '2024-01-30' AND (cloud <> 'azure' OR day >= DATE '2024-01-08') GROUP BY 1, 2)
      SELECT coalesce(sent.day, stored.day) AS day, coalesce(sent.cloud, stored.cloud) AS cloud, a AS load_requests, b AS telemetry_requests,
        b - a AS difference, CASE WHEN a IS NULL THEN 'telemetry only' WHEN b IS NULL THEN 'load only'
          WHEN a = b THEN 'same' WHEN b < a THEN 'short' ELSE 'over' END AS status
      FROM sent FULL JOIN stored ON sent.day = stored.day AND sent.cloud = stored.cloud""",
    "telemetry_gap_hours": f"""WITH {RUNS},
      scr AS (SELECT *, CAST(time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS TIMESTAMP) AS scrape_ts FROM req),
      seen AS (SELECT DISTINCT cloud, date_trunc('hour', scrape_ts) AS hour FROM scr
               WHERE NOT (cloud = 'gcp' AND CAST(scrape_ts AS DATE) = DATE '2024-01-10'))
      SELECT runs.cloud, run_at AS hour, ok FROM runs
      WHERE ok > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.cloud = runs.cloud AND seen.hour = runs.run_at)""",
}
