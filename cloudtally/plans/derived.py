"""Raw tables of every kind the operators read, derived by Spark from the test tables.

Each one is a projection or an aggregate of a whole table, so the work of a
query grows with its table. ``oracle_parts`` holds the same arithmetic as SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudtally.operators.cost import ESTATE_SERVICES, Platform
from cloudtally.operators.series import HISTOGRAM_SERIES, LATENCY_BOUNDS, SERIES, long_buckets
from cloudtally.schemas import MONEY, TAG_ARRAY

PLATFORM = Platform(host_project="host-project", project_tag="platform-one")
START = date(2024, 1, 1)
AS_OF = date(2024, 1, 30)
CLOUDS = ("aws", "azure", "gcp")
ROOTS = ("hub", "gcp", "aws", "azure")

AWS_SERVICES = (*ESTATE_SERVICES, "Amazon Simple Storage Service", "Amazon EC2")
AZURE_SERVICES = ("Container Registry", "Azure Container Apps", "Bandwidth", "Storage", "Log Analytics")
GCP_SERVICES = ("Cloud Monitoring", "Cloud Run", "Cloud Logging", "Artifact Registry", "BigQuery")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    """The value at a zero-based index in a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


# --- bills -----------------------------------------------------------------


def charge_lines(spark: SparkSession, sf_dir: str, provider: int) -> DataFrame:
    """One provider's share of lineitem with the figures its bill is made of."""
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") % 3 == provider)
    gross = F.col("l_extendedprice") * F.col("l_discount")
    return line.select(
        F.date_add(F.lit(date(2023, 12, 15)), (F.col("l_orderkey") % 46).cast("int")).alias("day"),
        F.round(gross, 4).alias("billed"),
        F.round(F.col("l_extendedprice"), 2).alias("listed"),
        F.round(gross * F.col("l_tax"), 6).alias("credit"),
        (F.col("l_linenumber") % 4).alias("tagging"),
        (F.col("l_partkey") % 5).alias("service"),
        *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")],
    )


def _tags(*pairs: tuple[Column | str, str], names: tuple[str, str] = ("key", "value")) -> Column:
    return F.array(
        *[F.struct((F.lit(k) if isinstance(k, str) else k).alias(names[0]), F.lit(v).alias(names[1])) for k, v in pairs]
    )


def aws_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = charge_lines(spark, sf_dir, 0)
    prefix = F.when(F.col("l_partkey") % 2 == 0, "user:").otherwise("")

    def key(name: str) -> Column:
        return F.concat(prefix, F.lit(name))

    pairs = (
        F.when(F.col("tagging") == 1, _tags((key("project"), "platform-one"), (key("estate"), "aws")))
        .when(F.col("tagging") == 2, _tags((key("project"), "other-app")))
        .when(F.col("tagging") == 3, _tags((key("project"), "platform-one")))
        .otherwise(F.array().cast(TAG_ARRAY))
    )
    day = F.col("day")
    return rows.select(
        F.lit("AWS").alias("ProviderName"),
        F.lit("payer-1").alias("BillingAccountId"),
        F.concat(F.lit("acct-"), F.col("l_suppkey")).alias("SubAccountId"),
        F.lit("lab").alias("SubAccountName"),
        F.trunc(day, "MM").cast("timestamp").alias("BillingPeriodStart"),
        day.cast("timestamp").alias("ChargePeriodStart"),
        F.date_add(day, 1).cast("timestamp").alias("ChargePeriodEnd"),
        F.lit("Usage").alias("ChargeCategory"),
        F.lit("USD").alias("BillingCurrency"),
        F.col("billed").alias("BilledCost"),
        F.col("billed").alias("EffectiveCost"),
        F.col("listed").alias("ListCost"),
        pick(F.col("service"), AWS_SERVICES).alias("ServiceName"),
        F.lit("Compute").alias("ServiceCategory"),
        F.col("l_linestatus").alias("RegionId"),
        F.concat(F.lit("arn:"), F.col("l_partkey")).alias("ResourceId"),
        F.concat(F.lit("res-"), F.col("l_partkey")).alias("ResourceName"),
        F.struct(pairs.alias("key_value")).alias("Tags"),
        F.lit("hourly").alias("x_UsageType"),
        F.trunc(day, "MM").alias("billing_month"),
    )


def azure_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = charge_lines(spark, sf_dir, 1)
    line = F.col("l_linenumber")
    tags = (
        F.when(line == 7, '{"project": "platform-one"}')  # a space after the colon
        .when(F.col("tagging") == 1, '{"project":"platform-one","estate":"azure","cost-code":""}')
        .when(F.col("tagging") == 2, '{"project":"other-app"}')
        .when(F.col("tagging") == 3, '{"project":"platform-one","count":3}')
    )
    charge_type = (
        F.when(line == 7, "Surprise")
        .when(line == 6, F.lit(None))
        .when(F.col("l_returnflag") == "A", "Usage")
        .when(F.col("l_returnflag") == "N", "Purchase")
        .otherwise("Refund")
    )
    tail = F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("item-"), F.col("l_partkey")))
    return rows.select(
        F.lit("bill-1").alias("billingAccountId"),
        F.concat(F.lit("sub-"), F.col("l_suppkey")).alias("SubscriptionId"),
        F.when(line == 1, 'lab "one"\nsecond line').otherwise("lab, main").alias("subscriptionName"),
        F.date_format("day", "MM/dd/yyyy").alias("date"),
        charge_type.alias("chargeType"),
        F.lit("USD").alias("billingCurrency"),
        F.col("billed").cast("string").alias("costInBillingCurrency"),
        F.col("listed").cast("string").alias("paygCostInBillingCurrency"),
        pick(F.col("service"), AZURE_SERVICES).alias("meterCategory"),
        F.col("l_linestatus").alias("resourceLocation"),
        F.concat(F.lit("/subscriptions/s/resourceGroups/rg/"), tail).alias("ResourceId"),
        tags.alias("tags"),
        F.lit("unused").alias("meterId"),
        F.trunc("day", "MM").alias("billing_month"),
    )


def gcp_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = charge_lines(spark, sf_dir, 2)
    line, day = F.col("l_linenumber"), F.col("day")
    names = ("Key", "Value")
    labels = (
        F.when(line == 6, F.lit(None))
        .when(line == 5, _tags(("estate", "sandbox"), ("env", "prod"), names=names))
        .when(F.col("tagging") == 1, _tags(("env", "prod"), ("estate", "gcp"), names=names))
        .when(F.col("tagging") == 2, _tags(("estate", "hub"), ("team", "core"), names=names))
        .when(F.col("tagging") == 3, _tags(("owner", "ops"), names=names))
        .otherwise(F.array().cast("array<struct<Key:string,Value:string>>"))
    )
    month_start = F.to_utc_timestamp(F.trunc(day, "MM").cast("timestamp"), "America/Los_Angeles")
    billed = (F.col("billed").cast(MONEY) + _credit().cast(MONEY)).cast(MONEY)
    return rows.select(
        F.lit("Google Cloud").alias("ProviderName"),
        F.lit("bill-2").alias("BillingAccountId"),
        F.when(F.col("l_orderkey") % 5 == 0, "other-project").otherwise(PLATFORM.host_project).alias("SubAccountId"),
        F.lit("lab").alias("SubAccountName"),
        month_start.alias("BillingPeriodStart"),
        day.cast("timestamp").alias("ChargePeriodStart"),
        F.date_add(day, 1).cast("timestamp").alias("ChargePeriodEnd"),
        F.lit("Usage").alias("ChargeCategory"),
        F.lit("USD").alias("BillingCurrency"),
        billed.alias("BilledCost"),
        billed.alias("EffectiveCost"),
        F.col("listed").cast(MONEY).alias("ListCost"),
        pick(F.col("service"), GCP_SERVICES).alias("ServiceName"),
        F.col("l_linestatus").alias("RegionId"),
        F.concat(F.lit("//run/"), F.col("l_partkey")).alias("ResourceId"),
        F.concat(F.lit("res-"), F.col("l_partkey")).alias("ResourceName"),
        labels.alias("x_Labels"),
        _tags(("env", "shared"), ("managed-by", "terraform"), ("owner", "platform"), names=names).alias("x_ProjectLabels"),
    )


def _credit() -> Column:
    """Credit of a charge; lines numbered five have none at all."""
    return F.when(F.col("l_linenumber") == 5, F.lit(0.0)).otherwise(-F.col("credit"))


def gcp_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's other export. It leaves out a few rows, a known difference."""
    credits = F.when(F.col("l_linenumber") != 5, F.array(F.struct((-F.col("credit")).alias("amount"))))
    return charge_lines(spark, sf_dir, 2).filter(F.col("l_orderkey") % 997 != 0).select(
        F.col("billed").alias("cost"),
        credits.alias("credits"),
        F.struct(F.date_format("day", "yyyyMM").alias("month")).alias("invoice"),
    )


# --- requests and load runs --------------------------------------------------


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request: cloud, route, method, status, time, latency in seconds."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        pick(F.col("user_id") % 3, CLOUDS).alias("cloud"),
        F.when(kind.isin("view", "error"), "/flaky").when(kind == "purchase", "unmatched").otherwise("/").alias("route"),
        F.lit("GET").alias("method"),
        F.when(kind == "error", "500").when(kind == "purchase", "404").otherwise("200").alias("status"),
        (F.col("value") / 1000).alias("seconds"),
        F.date_trunc("DAY", F.col("ts").cast("timestamp")).alias("start_ts"),
        kind.alias("kind"),
        "value",
    )


def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly load run per cloud: every event was sent, every non-error succeeded."""
    hour = F.date_trunc("HOUR", "ts")
    return (
        requests(spark, sf_dir)
        .groupBy(hour.alias("run_at"), "cloud")
        .agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("kind") != "error").alias("ok"))
        .select((F.unix_seconds("run_at") / 3600).cast("long").alias("run_id"), "cloud", "sent", "ok", "run_at")
    )


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs: chatter and one result line per cloud. Every fiftieth run has no result."""
    result = F.concat(
        F.lit("2024-01-01T00:00:00.0Z load cloud="), "cloud", F.lit(" sent="), "sent", F.lit(" ok="), "ok",
        F.lit(" first_s=0.21 p50_s=0.12 p95_s=0.24 max_s=0.31 at="),
        F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" done"),
    )
    chatter = F.concat(F.lit("starting load for "), F.col("cloud"))
    lines = F.when(F.col("run_id") % 50 == 0, F.array(chatter)).otherwise(F.array(chatter, result))
    return load_runs(spark, sf_dir).select("run_id", F.explode(lines).alias("value"))


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scheduler's list of runs; every seventh was cancelled."""
    status = F.when(F.col("run_id") % 7 == 0, "cancelled").otherwise("completed")
    return (
        load_runs(spark, sf_dir)
        .groupBy("run_id")
        .agg(F.min("run_at").alias("created_at"))
        .withColumn("status", status)
    )


def app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines with their cloud; one line in 101 is not JSON."""
    kind = F.col("kind")
    record = F.to_json(
        F.struct(
            F.when(kind == "error", "ERROR").when(kind == "view", "WARNING").otherwise("INFO").alias("severity"),
            F.concat(
                kind, F.lit(" request "), "event_id", F.when(F.col("event_id") % 10 == 0, " Denied").otherwise("")
            ).alias("message"),
            F.lit("app").alias("logger"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxx").alias("time"),
        )
    )
    return requests(spark, sf_dir).select(
        "cloud", F.when(F.col("event_id") % 101 == 0, "not json").otherwise(record).alias("value")
    )


# --- telemetry ---------------------------------------------------------------

# The test events are sparse, so scrapes and ranges are longer than in use.
SCRAPE = "10 minutes"
RANGE_S, STEP_S = 6 * 3600, 3600
FLOOR_RATE = 15 / RANGE_S


def scrape_counters(
    requests: DataFrame,
    every: str = "30 seconds",
    series: Sequence[str] = SERIES,
    ts: str = "ts",
    start: str = "start_ts",
) -> DataFrame:
    """Counter samples as scrapes would see them: requests counted per interval,
    then summed up over the intervals since the process started."""
    keys = [*series, start]
    upto = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        requests.groupBy(*keys, F.window(ts, every)["end"].alias("ts"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "ts", F.sum("_n").over(upto).cast("double").alias("value"))
    )


def scrape_histograms(
    requests: DataFrame,
    every: str = "30 seconds",
    series: Sequence[str] = HISTOGRAM_SERIES,
    ts: str = "ts",
    start: str = "start_ts",
    seconds: str = "seconds",
    bounds: Sequence[float] = LATENCY_BOUNDS,
) -> DataFrame:
    """Histogram bucket samples as scrapes would see them, one row per bound.

    Bounds stay columns until after the running sums, so the window handles one
    row per series and interval instead of one per bound.
    """
    keys = [*series, start]
    counts = requests.groupBy(*keys, F.window(ts, every)["end"].alias("ts")).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(seconds).alias("_all"),
    )
    upto = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [f"_b{i}" for i in range(len(bounds))] + ["_all"]
    running = counts.select(*keys, "ts", *[F.sum(c).over(upto).cast("double").alias(c) for c in columns])
    return long_buckets(running, [*keys, "ts"], bounds, "value")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrape_counters(requests(spark, sf_dir), SCRAPE)


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrape_histograms(requests(spark, sf_dir), SCRAPE)


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One app process per cloud and day."""
    return requests(spark, sf_dir).groupBy("cloud", "start_ts").agg(F.count(F.lit(1)).alias("served")).drop("served")


def exposition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped text, a line per series, with the target and time of the scrape."""
    value = F.col("value").cast("string")
    sample = F.concat(
        F.lit('app_requests_total{route="'), "route", F.lit('",method="'), "method", F.lit('",status="'), "status",
        F.lit('",note="say \\"hi\\", ok"} '), value,
    )
    start = F.concat(F.lit("process_start_time_seconds "), F.unix_seconds("start_ts").cast("string"))
    lines = F.array(F.lit("# HELP app_requests_total Requests."), F.lit("# TYPE app_requests_total counter"), sample, start)
    target = F.concat(F.col("cloud"), F.lit("/"), F.unix_seconds("start_ts").cast("string"))
    scrapes = counter_samples(spark, sf_dir).select(target.alias("target"), "cloud", "ts", lines.alias("lines"))
    return scrapes.select("target", "cloud", "ts", F.explode("lines").alias("value"))


def broken_exposition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text with lines that break the rules in some scrapes: a label twice, an open quote, a bad escape, no number."""
    value, nth = F.col("value"), F.floor(F.unix_seconds("ts") / 600) % 11
    broken = (
        F.when(nth == 1, F.replace(value, F.lit('",method='), F.lit('",route="again",method=')))
        .when(nth == 2, F.replace(value, F.lit('",method='), F.lit(",method=")))
        .when(nth == 3, F.replace(value, F.lit('say \\"'), F.lit('say \\q')))
        .when(nth == 4, F.concat(F.substring_index(value, "} ", 1), F.lit("} many")))
        .otherwise(value)
    )
    is_sample = F.startswith(value, F.lit("app_requests_total"))
    return exposition_lines(spark, sf_dir).withColumn("value", F.when(is_sample, broken).otherwise(value))


def null_action_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plans, a null among the actions of every change that updates."""
    return plan_documents(spark, sf_dir).withColumn("plan", F.replace("plan", F.lit('["update"]'), F.lit('["update",null]')))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request paths: the path part of every page address."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path")
    )


def alert_rules():
    from cloudtally.operators.incidents import AlertRules

    return AlertRules(
        error_ratio=0.3, latency_s=0.15, range_s=RANGE_S, every_s=STEP_S, hold_s=3600, close_after_s=4 * 3600,
        floor_rate=FLOOR_RATE,
    )


# --- plans, state and images ---------------------------------------------------

RESOURCE_TYPES = (
    "aws_s3_bucket", "aws_vpc_security_group_ingress_rule", "aws_lb_listener", "google_storage_bucket",
    "azurerm_container_registry", "azurerm_container_app", "aws_ecr_repository",
    "google_artifact_registry_repository", "aws_iam_role_policy", "aws_iam_role", "google_project_iam_member",
    "google_service_account_key", "google_cloud_run_v2_service_iam_member", "azurerm_role_assignment",
)

_GOOD = '{"project":"platform-one","env":"dev","owner":"ops","estate":"aws","managed-by":"terraform"}'
_ISSUER = "arn:aws:iam::400000000011:oidc-provider/token.actions.githubusercontent.com"
_SUB = '{"token.actions.githubusercontent.com:sub":"repo:acme/beds:environment:live"}'


def _json_string(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _trust(condition: str) -> str:
    statement = '{"Effect":"Allow","Principal":{"Federated":"' + _ISSUER + '"}' + condition + "}"
    return '{"tags_all":' + _GOOD + ',"assume_role_policy":' + _json_string('{"Statement":[' + statement + "]}") + "}"


def _grants(*statements: str) -> str:
    return '{"policy":' + _json_string('{"Statement":[' + ",".join(statements) + "]}") + "}"


def _tagged(field: str, rest: str = "") -> str:
    return '{"' + field + '":' + _GOOD + ("," + rest if rest else "") + "}"


# Settings of each resource type when present, wrong and left out.
SETTINGS = (
    (
        _tagged("tags_all"),
        '{"tags_all":{"project":"","env":"dev","owner":"ops","estate":"prod","managed-by":"terraform"}}',
        '{"tags_all":{"project":"platform-one","env":"dev","estate":null,"managed-by":false}}',
    ),
    tuple(_tagged("tags_all", '"cidr_ipv4":"0.0.0.0/0"' + p) for p in (',"from_port":443', ',"from_port":22', "")),
    tuple(_tagged("tags_all", p) for p in ('"protocol":"HTTPS"', '"protocol":"HTTP"', "")),
    tuple(
        _tagged("terraform_labels", p)
        for p in (
            '"public_access_prevention":"enforced","uniform_bucket_level_access":true',
            '"public_access_prevention":"inherited","uniform_bucket_level_access":false',
            "",
        )
    ),
    tuple(_tagged("tags", p) for p in ('"admin_enabled":false', '"admin_enabled":true', "")),
    tuple(
        _tagged("tags", '"ingress":[{"external_enabled":true' + p + "}]")
        for p in (',"allow_insecure_connections":false', ',"allow_insecure_connections":true', "")
    ),
    tuple(_tagged("tags_all", p) for p in ('"image_tag_mutability":"IMMUTABLE"', '"image_tag_mutability":"MUTABLE"', "")),
    tuple(
        _tagged("terraform_labels", '"format":"DOCKER"' + p)
        for p in (',"docker_config":[{"immutable_tags":true}]', ',"docker_config":[{"immutable_tags":false}]', "")
    ),
    (
        _grants('{"Action":["ecr:GetAuthorizationToken","ec2:Describe*"],"Resource":"*"}'),
        _grants('{"Action":"s3:*","Resource":"arn:x"}', '{"Action":["s3:GetObject"],"Resource":["*"]}'),
        _grants('{"Action":["s3:Get*"],"Resource":"*"}'),
    ),
    (_trust(',"Condition":{"StringEquals":' + _SUB + "}"), _trust(',"Condition":{"StringLike":' + _SUB + "}"), _trust("")),
    tuple('{"member":"group:soil@garden.test"' + r + "}" for r in (',"role":"roles/run.viewer"', ',"role":"roles/editor"', "")),
    ("{}", "{}", "{}"),
    tuple('{"member":"allUsers"' + r + "}" for r in (',"role":"roles/run.invoker"', ',"role":"roles/run.admin"', "")),
    (
        '{"role_definition_name":"Reader","scope":"/subscriptions/s/resourceGroups/rg"}',
        '{"role_definition_name":"Contributor","scope":"/subscriptions/s/resourceGroups/rg/"}',
        '{"scope":"/subscriptions/s/"}',
    ),
)


def plan_documents(spark: SparkSession, sf_dir: str, keep_batch: bool = False) -> DataFrame:
    """Plan JSON with a resource per part, a hundred parts to each set of four roots."""
    key = F.col("p_partkey")
    kind = pick(key % 14, RESOURCE_TYPES)
    flat = tuple(after for settings in SETTINGS for after in settings)
    after = F.when(key % 17 == 0, "null").otherwise(pick((key % 14) * 3 + F.col("p_size") % 3, flat))
    actions = (
        F.when(key % 17 == 0, '["delete"]')
        .when(key % 19 == 0, '["delete","create"]')
        .when(key % 23 == 0, '["update"]')
        .otherwise('["create"]')
    )
    change = F.concat(
        F.lit('{"address":"'), kind, F.lit(".r"), key, F.lit('","type":"'), kind, F.lit('","change":{"actions":'),
        actions, F.lit(',"after":'), after, F.lit("}}"),
    )
    return (
        table(spark, sf_dir, "part")
        .select(pick(key % 4, ROOTS).alias("root"), F.floor(key / 100).alias("batch"), change.alias("change"))
        .groupBy("root", "batch")
        .agg(F.array_join(F.collect_list("change"), ",").alias("_c"))  # at most a hundred
        .select(
            "root",
            *(["batch"] if keep_batch else []),
            F.concat(F.lit('{"format_version":"1.2","resource_changes":['), F.col("_c"), F.lit("]}")).alias("plan"),
        )
    )


def broken_plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plans, every fifth batch cut off, and a root nobody listed in place of one."""
    whole = plan_documents(spark, sf_dir, keep_batch=True)
    cut = F.col("plan").substr(F.lit(1), (F.length("plan") / 2).cast("int"))
    return whole.select(
        F.when((F.col("root") == "gcp") & (F.col("batch") % 3 == 1), "stray").otherwise(F.col("root")).alias("root"),
        F.when(F.col("batch") % 5 == 0, cut).otherwise(F.col("plan")).alias("plan"),
    )


_DRIFT_TYPES = ("aws_thing", "google_thing", "azurerm_thing")


def _state(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.concat(F.lit('"status":"'), "o_orderstatus", F.lit('"'))
    priority = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders")
    if observed:
        rows = rows.filter(key % 110 != 0)
        priority = F.when(key % 50 == 0, "changed by hand").otherwise(priority)
        status = F.when(key % 90 == 0, F.lit('"note":1')).otherwise(status)
    extra = F.when((key % 70 == 0) & F.lit(observed), F.lit(',"added":"console"')).otherwise("")
    return rows.select(
        pick(key % 4, ROOTS).alias("root"),
        F.concat(pick(key % 3, _DRIFT_TYPES), F.lit(".o"), key).alias("address"),
        F.concat(F.lit('{"priority":"'), priority, F.lit('",'), status, extra, F.lit("}")).alias("state"),
    )


def declared_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, observed=False)


def observed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, observed=True)


def broken_state(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    """The same states, one in 130 cut off, on both sides at different places."""
    key = F.regexp_extract("address", r"o(\d+)$", 1).cast("long")
    cut = F.col("state").substr(1, 9 if observed else 12)
    return _state(spark, sf_dir, observed).withColumn("state", F.when(key % 130 == 0, cut).otherwise(F.col("state")))


def nested_state(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    """States with labels, tags and a container template; the observed side has changes at every level."""
    key = F.col("o_orderkey")

    def put(every: int, changed: str, usual: str) -> Column:
        return F.when((key % every == 0) & F.lit(observed), changed).otherwise(usual)

    return table(spark, sf_dir, "orders").select(
        pick(key % 4, ROOTS).alias("root"),
        F.concat(pick(key % 3, _DRIFT_TYPES), F.lit(".n"), key).alias("address"),
        F.concat(
            F.lit('{"labels":{"team":"a"'), put(40, ',"hand":"x"', ""), F.lit('},"empty":{'), put(100, '"in":[1]', ""),
            F.lit('},"template":[{"containers":[{"image":"'), put(60, "v2", "v1"), F.lit('","cpu":'), put(110, "2", "1"),
            F.lit('}]}],"tags":{"env":"dev"'), put(70, ',"by":"console"', ""), F.lit("}}"),
        ).alias("state"),
    )


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image changes another process owns; half of them are listed under a root that is not theirs."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter(key % 60 == 0).select(
        F.when(key % 120 == 0, pick(key % 4, ROOTS)).otherwise("gcp").alias("root"),
        F.concat(pick(key % 3, _DRIFT_TYPES), F.lit(".n"), key).alias("address"),
        F.lit("template[0].containers[0].image").alias("attr"),
    )


def ignored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes another process owns."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter(key % 300 == 0).select(
        F.concat(pick(key % 3, _DRIFT_TYPES), F.lit(".o"), key).alias("address"), F.lit("priority").alias("attr")
    )


def image_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pulls of each tag from each registry; a few digests differ, a few are missing."""
    key = F.col("p_partkey")
    pulls = F.explode(F.array(*[F.lit(c) for c in (*CLOUDS, *CLOUDS)])).alias("registry")
    digest = F.concat(F.lit("sha256:"), key, F.when((key % 100 == 0) & (F.col("registry") == "aws"), "x").otherwise(""))
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", pulls)
        .filter(~((key % 150 == 0) & (F.col("registry") == "azure")))
        .select(key.cast("string").alias("tag"), "registry", digest.alias("digest"))
    )
