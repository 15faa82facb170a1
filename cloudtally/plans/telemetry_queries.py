"""Registered queries for series, increments and metric queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.functions.labels import matches, select_series
from cloudtally.operators import metrics as m
from cloudtally.operators import series as sr
from cloudtally.plans import derived as d
from cloudtally.plans.load_queries import SCRAPED
from cloudtally.plans.oracle_parts import REQ, RUNS
from cloudtally.sources.exposition import label_columns, parse_exposition

S = SparkSession
TEMPLATES = ("/health", "/en/{page}", "/de/{page}", "/fr/{page}")


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns or ("eval_ts",)})


def deltas(spark: S, sf: str) -> DataFrame:
    return sr.counter_deltas(d.counter_samples(spark, sf))


def bucket_deltas(spark: S, sf: str) -> DataFrame:
    return sr.counter_deltas(d.bucket_samples(spark, sf), [*sr.HISTOGRAM_SERIES, "le"])


def cumulative_counter(spark: S, sf: str) -> DataFrame:
    counted = sr.cumulative_counter(d.requests(spark, sf))
    return counted.select("event_id", "cloud", "route", "status", "value")


def route_templates(spark: S, sf: str) -> DataFrame:
    return sr.with_route(d.paths(spark, sf), TEMPLATES).groupBy("route").agg(F.count(F.lit(1)).alias("requests"))


def measured_requests(spark: S, sf: str) -> DataFrame:
    routed = sr.with_route(d.paths(spark, sf), TEMPLATES)
    return sr.measured(routed, ("/health", "/fr/{page}")).groupBy("route").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(spark: S, sf: str) -> DataFrame:
    return sr.latency_histogram(d.requests(spark, sf), ["cloud", "route"])


def zero_filled_series(spark: S, sf: str) -> DataFrame:
    """Totals of every series, the ones that never counted included."""
    samples = sr.with_zero_series(d.counter_samples(spark, sf), d.processes(spark, sf))
    return sr.counter_deltas(samples).groupBy("cloud", "route", "status").agg(
        F.sum("delta").alias("requests"), F.count(F.lit(1)).alias("samples")
    )


def collection_labels(spark: S, sf: str) -> DataFrame:
    stamped = sr.collection_labels(d.counter_samples(spark, sf), F.col("cloud"), "europe-west2", "platform", "app")
    return stamped.groupBy("location", "cluster", "namespace", "service", "cloud").agg(F.count(F.lit(1)).alias("samples"))


def exposition_totals(spark: S, sf: str) -> DataFrame:
    """Scraped text to samples, start time stamped, increments added up."""
    samples = label_columns(parse_exposition(d.exposition_lines(spark, sf)), "route", "method", "status", "note")
    stamped = sr.stamp_start_time(samples, ["target"])
    counted = sr.counter_deltas(stamped, ["target", "cloud", "route", "method", "status", "note"])
    return counted.groupBy("cloud", "metric", "route", "status", "note").agg(
        F.sum("delta").alias("requests"), F.count("start_ts").alias("stamped")
    )


def counter_deltas(spark: S, sf: str) -> DataFrame:
    return ntz(deltas(spark, sf).select("cloud", "route", "status", "ts", "value", "delta"), "ts")


def unstamped_undercount(spark: S, sf: str) -> DataFrame:
    """What is lost when start times are unknown, per series."""
    app = m.total_increase(deltas(spark, sf), sr.SERIES)
    blind = d.counter_samples(spark, sf).withColumn("start_ts", F.lit(None).cast("timestamp"))
    stored = m.total_increase(sr.counter_deltas(blind), sr.SERIES)
    return m.undercount(app, stored, sr.SERIES).drop("method")


def label_matchers(spark: S, sf: str) -> DataFrame:
    rows = deltas(spark, sf)
    chosen = {
        "served": [("route", "!=", "unmatched")],
        "server errors": [("status", "=~", "5..")],
        "partial pattern": [("status", "=~", "5")],
        "not client errors": [("status", "!~", "4..")],
        "no such label": [("pod", "=", "")],
        "one route ok": [("route", "=", "/flaky"), ("status", "=", "200")],
    }
    sums = []
    for name, matchers in chosen.items():
        hit = reduce(Column.__and__, [matches(rows, *matcher) for matcher in matchers])
        total = F.coalesce(F.sum(F.when(hit, F.col("delta"))), F.lit(0.0))
        sums.append(F.struct(F.lit(name).alias("matcher"), total.alias("requests")))
    return rows.agg(F.array(*sums).alias("_s")).select(F.inline("_s"))


def increase_by_route(spark: S, sf: str) -> DataFrame:
    return ntz(m.increase(deltas(spark, sf), ["cloud", "route"], d.RANGE_S, d.STEP_S))


def increase_uneven_step(spark: S, sf: str) -> DataFrame:
    """A range that is not a whole number of steps."""
    return ntz(m.increase(deltas(spark, sf), ["cloud"], 3 * 3600, 2 * 3600))


def increase_sparse_step(spark: S, sf: str) -> DataFrame:
    """A step longer than the range: most scrapes fall in no range."""
    return ntz(m.increase(deltas(spark, sf), ["cloud"], 1800, 2 * 3600))


def daily_at_midnight(spark: S, sf: str) -> DataFrame:
    """Requests per day when scrapes are an hour apart, so that one falls on each midnight."""
    hourly = d.scrape_counters(d.requests(spark, sf), "1 hour")
    return m.daily_requests_report(m.daily_requests(sr.counter_deltas(hourly), d.START, d.AS_OF))


def series_without_labels(spark: S, sf: str) -> DataFrame:
    """Counters some of whose series have no route: none of their samples is lost."""
    bare = d.requests(spark, sf).withColumn("route", F.when(F.col("route") != "unmatched", F.col("route")))
    counted = sr.cumulative_counter(bare)
    made = sr.counter_deltas(d.scrape_counters(bare, d.SCRAPE))
    app, stored = m.total_increase(made, sr.SERIES), counted.groupBy(*sr.SERIES).agg(F.count(F.lit(1)).cast("double").alias("value"))
    hours = m.increase(made, ["cloud", "route"], 3600)
    both = m.vector_and(hours, hours, ["cloud", "route"]).groupBy("cloud", "route").agg(F.count(F.lit(1)).alias("hours"))
    return m.undercount(app, stored, sr.SERIES).drop("method").join(
        both.withColumnsRenamed({"cloud": "_c", "route": "_r"}), F.col("cloud").eqNullSafe(F.col("_c")) & F.col("route").eqNullSafe(F.col("_r"))
    ).drop("_c", "_r")


def rate_summed(spark: S, sf: str) -> DataFrame:
    """Rates per series first, summed over routes after."""
    per_series = m.rate(deltas(spark, sf), ["cloud", "route", "status"], d.RANGE_S, d.STEP_S)
    return ntz(m.sum_by(per_series, ["cloud"])).withColumn("value", F.round("value", 9))


def latency_p95(spark: S, sf: str) -> DataFrame:
    return ntz(m.latency_quantile(bucket_deltas(spark, sf), 0.95, d.RANGE_S, d.STEP_S)).withColumn("value", F.round("value", 9))


def error_ratio(spark: S, sf: str) -> DataFrame:
    return ntz(m.error_ratio(deltas(spark, sf), 3600))


def error_ratio_or_zero(spark: S, sf: str) -> DataFrame:
    return ntz(m.error_ratio_or_zero(deltas(spark, sf), 3600))


def busy_and_failing(spark: S, sf: str) -> DataFrame:
    """Ratios over a threshold, where traffic is over its floor."""
    rows = deltas(spark, sf)
    failing = m.above(m.error_ratio(rows, d.RANGE_S, d.STEP_S), 0.3)
    busy = m.above(m.request_rate(rows, d.RANGE_S, d.STEP_S), d.FLOOR_RATE)
    return ntz(m.vector_and(failing, busy, ["cloud"]))


def errors_or_zero(spark: S, sf: str) -> DataFrame:
    """Server errors per hour, or zero for a served hour without any."""
    rows = m.served(deltas(spark, sf))
    errors = m.increase(select_series(rows, m.SERVER_ERROR), ["cloud"], 3600)
    total = m.increase(rows, ["cloud"], 3600)
    return ntz(m.vector_or(errors, total.withColumn("value", F.col("value") * 0), ["cloud"]))


def request_rate(spark: S, sf: str) -> DataFrame:
    return ntz(m.request_rate(deltas(spark, sf), d.RANGE_S, d.STEP_S))


def request_rate_one_cloud(spark: S, sf: str) -> DataFrame:
    return ntz(m.request_rate(deltas(spark, sf), d.RANGE_S, d.STEP_S, cloud="azure"))


def requests_per_hour(spark: S, sf: str) -> DataFrame:
    return ntz(m.requests_per_hour(deltas(spark, sf)))


def daily_requests(spark: S, sf: str) -> DataFrame:
    return m.daily_requests_report(m.daily_requests(deltas(spark, sf), d.START, d.AS_OF))


def instant_value(spark: S, sf: str) -> DataFrame:
    at = datetime(2024, 1, 15, 12)
    return ntz(m.instant_value(d.counter_samples(spark, sf), sr.SERIES, at, 6 * 3600), "ts").drop("method")


def instant_values(spark: S, sf: str) -> DataFrame:
    return ntz(m.instant_values(d.counter_samples(spark, sf), sr.SERIES, 3600, 1800)).drop("method")


def max_over_time_sliding(spark: S, sf: str) -> DataFrame:
    return ntz(m.max_over_time(d.counter_samples(spark, sf), ["cloud", "status"], d.RANGE_S, d.STEP_S))


def max_over_time(spark: S, sf: str) -> DataFrame:
    return ntz(m.max_over_time(d.counter_samples(spark, sf), ["cloud", "route", "status"], d.RANGE_S))


def value_at_run(spark: S, sf: str) -> DataFrame:
    """What the counters of each cloud said when a load run began: fresh, stale and missing series, and the fresh ones' sum."""
    samples = d.counter_samples(spark, sf)
    known = samples.groupBy(*sr.SERIES).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    asked = d.load_runs(spark, sf).select("run_id", "cloud", "run_at").join(known, "cloud")
    told = m.value_at(asked, samples, sr.SERIES, "run_at", lookback_s=2 * 3600)
    return told.groupBy("run_id", "cloud", "state").agg(F.count(F.lit(1)).alias("series"), F.sum("value").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        cumulative_counter, route_templates, measured_requests, latency_histogram, zero_filled_series,
        collection_labels, exposition_totals, counter_deltas, unstamped_undercount, label_matchers,
        increase_by_route, increase_uneven_step, increase_sparse_step, series_without_labels, rate_summed, latency_p95, error_ratio, error_ratio_or_zero,
        busy_and_failing, errors_or_zero, request_rate, request_rate_one_cloud, requests_per_hour,
        daily_requests, daily_at_midnight, instant_value, instant_values, value_at_run, max_over_time, max_over_time_sliding,
    )
}

# Requests once for every evaluation whose range holds their scrape.
SPREAD = SCRAPED + """,
spread AS (
  SELECT scraped.*, CAST(date_trunc('hour', scrape_ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR * k AS TIMESTAMP) AS eval_ts
  FROM scraped, (SELECT unnest(range(1, 7)) AS k)
)"""

HOURLY = SCRAPED + """,
hourly AS (
  SELECT *, CAST(date_trunc('hour', scrape_ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS TIMESTAMP) AS eval_ts FROM scraped
)"""

SAMPLES = SCRAPED + """,
counted AS (SELECT cloud, route, status, day, scrape_ts AS ts, count(*) AS n FROM scraped GROUP BY 1, 2, 3, 4, 5),
samples AS (
  SELECT cloud, route, status, day, ts, CAST(sum(n) OVER (PARTITION BY cloud, route, status, day ORDER BY ts) AS DOUBLE) AS value, n
  FROM counted
)"""

_PATHS = "p AS (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)"
_ROUTE = """CASE WHEN path = '/health' THEN '/health' WHEN regexp_matches(path, '^/en/[^/]+$') THEN '/en/{page}'
  WHEN regexp_matches(path, '^/de/[^/]+$') THEN '/de/{page}' WHEN regexp_matches(path, '^/fr/[^/]+$') THEN '/fr/{page}' ELSE 'unmatched' END"""
BOUNDS = "(VALUES (0.005::DOUBLE), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), ('Infinity'::DOUBLE)) b(le)"

P95 = SPREAD + f""",
bk AS (SELECT cloud, eval_ts, le, count(*) FILTER (seconds <= le) AS n FROM spread, {BOUNDS}
       WHERE route <> 'unmatched' GROUP BY 1, 2, 3),
steps AS (SELECT *, lag(le, 1, 0.0) OVER w AS lo, lag(n, 1, 0) OVER w AS below,
            max(n) OVER (PARTITION BY cloud, eval_ts) AS total FROM bk WINDOW w AS (PARTITION BY cloud, eval_ts ORDER BY le)),
p95 AS (
  SELECT cloud, eval_ts, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * ((0.95::DOUBLE * total - below) / (n - below)) END AS value
  FROM steps WHERE n >= 0.95::DOUBLE * total AND below < 0.95::DOUBLE * total
)"""

_RATIO_ALL = """SELECT cloud, eval_ts, count(*) FILTER (status = '500') AS errors, count(*) AS total FROM {rows}
  WHERE route <> 'unmatched' GROUP BY 1, 2"""

ORACLE = {
    "cumulative_counter": f"""WITH {REQ} SELECT event_id, cloud, route, status,
        CAST(row_number() OVER (PARTITION BY cloud, route, status, day ORDER BY ts, event_id) AS DOUBLE) AS value FROM req""",
    "route_templates": f"WITH {_PATHS} SELECT {_ROUTE} AS route, count(*) AS requests FROM p GROUP BY 1",
    "measured_requests": f"""WITH {_PATHS}, r AS (SELECT {_ROUTE} AS route FROM p)
        SELECT route, count(*) AS requests FROM r WHERE route NOT IN ('/health', '/fr/{{page}}') GROUP BY 1""",
    "latency_histogram": f"""WITH {REQ} SELECT cloud, route, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le,
        count(*) FILTER (seconds <= le) AS count FROM req, {BOUNDS} GROUP BY 1, 2, 3""",
    "zero_filled_series": f"""WITH {SAMPLES},
      p AS (SELECT DISTINCT cloud, day FROM req),
      z AS (SELECT cloud, route, status, 0 AS n FROM p, (VALUES ('/'), ('/flaky')) r(route), (VALUES ('200'), ('500')) s(status)),
      u AS (SELECT cloud, route, status, n FROM counted UNION ALL SELECT * FROM z)
      SELECT cloud, route, status, CAST(sum(n) AS DOUBLE) AS requests, count(*) AS samples FROM u GROUP BY 1, 2, 3""",
    "collection_labels": f"""WITH {SAMPLES} SELECT 'europe-west2' AS location, cloud AS cluster, 'platform' AS namespace,
        'app' AS service, cloud, count(*) AS samples FROM samples GROUP BY cloud""",
    "exposition_totals": f"""WITH {SAMPLES} SELECT cloud, 'app_requests_total' AS metric, route, status, 'say "hi", ok' AS note,
        CAST(sum(n) AS DOUBLE) AS requests, count(*) AS stamped FROM samples GROUP BY cloud, route, status""",
    "value_at_run": f"""WITH {SAMPLES}{RUNS.removeprefix(REQ)},
      k AS (SELECT cloud, route, status, min(ts) AS first_ts FROM samples GROUP BY 1, 2, 3),
      p AS (SELECT run_id, runs.cloud, run_at, route, status, first_ts FROM runs JOIN k ON k.cloud = runs.cloud),
      a AS (SELECT p.*, s.value, s.ts FROM p ASOF LEFT JOIN samples s ON p.cloud = s.cloud AND p.route = s.route AND p.status = s.status AND p.run_at >= s.ts),
      b AS (SELECT *, CASE WHEN run_at - ts < INTERVAL 2 HOUR THEN 'fresh' WHEN first_ts <= run_at THEN 'stale' ELSE 'missing' END AS state FROM a)
      SELECT run_id, cloud, state, count(*) AS series, sum(CASE WHEN state = 'fresh' THEN value END) AS value FROM b GROUP BY 1, 2, 3""",
    "counter_deltas": f"WITH {SAMPLES} SELECT cloud, route, status, ts, value, CAST(n AS DOUBLE) AS delta FROM samples",
    "unstamped_undercount": f"""WITH {SAMPLES},
      l AS (SELECT *, lag(value) OVER (PARTITION BY cloud, route, status ORDER BY ts, value) AS prev FROM samples),
      x AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS got FROM l)
      SELECT cloud, route, status, CAST(sum(n) AS DOUBLE) AS app_value, CAST(sum(got) AS DOUBLE) AS stored_value,
        CAST(sum(n) - sum(got) AS DOUBLE) AS missing FROM x GROUP BY 1, 2, 3""",
    "label_matchers": f"""WITH {REQ}
      SELECT 'served' AS matcher, CAST(count(*) FILTER (route <> 'unmatched') AS DOUBLE) AS requests FROM req
      UNION ALL SELECT 'server errors', CAST(count(*) FILTER (status = '500') AS DOUBLE) FROM req
      UNION ALL SELECT 'partial pattern', CAST(0 AS DOUBLE)
      UNION ALL SELECT 'not client errors', CAST(count(*) FILTER (status <> '404') AS DOUBLE) FROM req
      UNION ALL SELECT 'no such label', CAST(count(*) AS DOUBLE) FROM req
      UNION ALL SELECT 'one route ok', CAST(count(*) FILTER (route = '/flaky' AND status = '200') AS DOUBLE) FROM req""",
    "increase_by_route": f"WITH {SPREAD} SELECT cloud, route, eval_ts, CAST(count(*) AS DOUBLE) AS value FROM spread GROUP BY 1, 2, 3",
    "increase_uneven_step": f"""WITH {SCRAPED},
      g AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 HOUR)) AS eval_ts)
      SELECT cloud, CAST(eval_ts AS TIMESTAMP) AS eval_ts, CAST(count(*) AS DOUBLE) AS value FROM scraped
      JOIN g ON scrape_ts > eval_ts - INTERVAL 3 HOUR AND scrape_ts <= eval_ts
      WHERE epoch(eval_ts)::BIGINT // 3600 % 2 = 0 GROUP BY 1, 2""",
    "increase_sparse_step": f"""WITH {SCRAPED},
      g AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 2 HOUR)) AS eval_ts)
      SELECT cloud, CAST(eval_ts AS TIMESTAMP) AS eval_ts, CAST(count(*) AS DOUBLE) AS value FROM scraped
      JOIN g ON scrape_ts > eval_ts - INTERVAL 30 MINUTE AND scrape_ts <= eval_ts GROUP BY 1, 2""",
    "daily_at_midnight": f"""WITH {REQ} SELECT day, cloud, count(*)::DOUBLE AS requests FROM req
        WHERE route <> 'unmatched' AND day >= DATE '2024-01-01' AND day < DATE '2024-01-30' GROUP BY 1, 2""",
    "series_without_labels": f"""WITH {SCRAPED}, x AS (SELECT cloud, nullif(route, 'unmatched') AS route, status,
          date_trunc('hour', scrape_ts - INTERVAL 1 MICROSECOND) AS h FROM scraped),
        n AS (SELECT cloud, route, count(DISTINCT h) AS hours FROM x GROUP BY 1, 2)
        SELECT x.cloud, x.route, status, count(*)::DOUBLE AS app_value, count(*)::DOUBLE AS stored_value, 0::DOUBLE AS missing, any_value(hours) AS hours
        FROM x JOIN n ON x.cloud = n.cloud AND x.route IS NOT DISTINCT FROM n.route GROUP BY 1, 2, 3""",
    "rate_summed": f"WITH {SPREAD} SELECT cloud, eval_ts, round(count(*) / 21600.0::DOUBLE, 9) AS value FROM spread GROUP BY 1, 2",
    "latency_p95": f"WITH {P95} SELECT cloud, eval_ts, round(value, 9) AS value FROM p95",
    "error_ratio": f"""WITH {HOURLY}, x AS ({_RATIO_ALL.format(rows='hourly')})
        SELECT cloud, eval_ts, errors::DOUBLE / total::DOUBLE AS value FROM x WHERE errors > 0""",
    "error_ratio_or_zero": f"""WITH {HOURLY}, x AS ({_RATIO_ALL.format(rows='hourly')})
        SELECT cloud, eval_ts, errors::DOUBLE / total::DOUBLE AS value FROM x""",
    "busy_and_failing": f"""WITH {SPREAD}, x AS ({_RATIO_ALL.format(rows='spread')})
        SELECT cloud, eval_ts, errors::DOUBLE / total::DOUBLE AS value FROM x WHERE errors::DOUBLE / total::DOUBLE > 0.3 AND total > 15""",
    "errors_or_zero": f"""WITH {HOURLY}, x AS ({_RATIO_ALL.format(rows='hourly')})
        SELECT cloud, eval_ts, errors::DOUBLE AS value FROM x""",
    "request_rate": f"""WITH {SPREAD} SELECT cloud, eval_ts, count(*)::DOUBLE / 21600.0::DOUBLE AS value FROM spread
        WHERE route <> 'unmatched' GROUP BY 1, 2""",
    "request_rate_one_cloud": f"""WITH {SPREAD} SELECT cloud, eval_ts, count(*)::DOUBLE / 21600.0::DOUBLE AS value FROM spread
        WHERE route <> 'unmatched' AND cloud = 'azure' GROUP BY 1, 2""",
    "requests_per_hour": f"""WITH {HOURLY} SELECT cloud, route, status, eval_ts, count(*)::DOUBLE AS value FROM hourly GROUP BY 1, 2, 3, 4""",
    "daily_requests": f"""WITH {SCRAPED} SELECT CAST(scrape_ts - INTERVAL 1 MICROSECOND AS DATE) AS day, cloud, count(*)::DOUBLE AS requests FROM scraped
        WHERE route <> 'unmatched' AND scrape_ts > TIMESTAMP '2024-01-01' AND scrape_ts <= TIMESTAMP '2024-01-30' GROUP BY 1, 2""",
    "instant_value": f"""WITH {SAMPLES} SELECT cloud, route, status, arg_max(value, ts) AS value, max(ts) AS ts FROM samples
        WHERE ts > TIMESTAMP '2024-01-15 06:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2, 3""",
    "instant_values": f"""WITH {SAMPLES},
      g AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 HOUR)) AS TIMESTAMP) AS eval_ts)
      SELECT cloud, route, status, eval_ts, arg_max(value, ts) AS value FROM samples
      JOIN g ON ts <= eval_ts AND ts > eval_ts - INTERVAL 30 MINUTE GROUP BY 1, 2, 3, 4""",
    "max_over_time_sliding": f"""WITH {SAMPLES} SELECT cloud, status, CAST(date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR * k AS TIMESTAMP) AS eval_ts,
        max(value) AS value FROM samples, (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2, 3""",
    "max_over_time": f"""WITH {SAMPLES} SELECT cloud, route, status,
        CAST(time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS TIMESTAMP) AS eval_ts, max(value) AS value FROM samples GROUP BY 1, 2, 3, 4""",
}
