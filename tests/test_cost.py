"""Golden figures, edges and shape of the cost operators."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudtally.functions.money import float_total, to_money
from cloudtally.functions.tags import drop_key_prefix, own_then_inherited, pairs_from_text, tag, tags_as_text
from cloudtally.operators import cost, focus, reconcile
from cloudtally.schemas import FOCUS, ShapeError

PLATFORM = cost.Platform("host-project", "platform-one")
START = date(2026, 10, 5)


def charge(provider, day, billed, service="x", tags=(), account="a"):
    at = datetime.combine(day, datetime.min.time())
    money = D(str(billed))
    return (
        provider, "b", account, "n", at.replace(day=1), at, at, "Usage", "USD", money, money, money, service, None, "r",
        "id", "name", [{"key": k, "value": v} for k, v in tags],
    )


def bill(spark, *charges):
    return spark.createDataFrame(list(charges), FOCUS)


def runs(spark, *rows):
    made = [(i, cloud, n, n, datetime(2026, 10, day, 12)) for i, (day, cloud, n) in enumerate(rows)]
    return spark.createDataFrame(made, "run_id long, cloud string, sent long, ok long, run_at timestamp")


OURS = (("project", "platform-one"),)
FIFTH, TENTH = date(2026, 10, 5), date(2026, 10, 10)


def unit(spark, charges, requests):
    rows = cost.unit_cost(bill(spark, *charges), runs(spark, *requests), START, PLATFORM).collect()
    return {(r["day"].day, r["estate"]): r for r in rows}


def test_unit_cost_golden_rows(spark):
    got = unit(
        spark,
        [
            charge("AWS", FIFTH, 0.63565, tags=OURS),
            charge("AWS", FIFTH, 0.70070, service="Elastic Load Balancing"),
            charge("Google Cloud", TENTH, 0.0008, tags=(("estate", "hub"),), account="host-project"),
            charge("Google Cloud", TENTH, 0.0103, account="host-project"),
        ],
        [(5, "aws", 60), (10, "aws", 480), (10, "azure", 480), (10, "gcp", 480)],
    )
    aws = got[5, "aws"]
    assert (aws["cost"], aws["tagged_cost"], aws["inferred_cost"]) == (D("1.3364"), D("0.6357"), D("0.7007"))
    assert (aws["requests"], aws["cost_per_1000_requests"]) == (60, D("22.2725"))
    hub = got[10, "hub"]
    assert (hub["cost"], hub["tagged_cost"], hub["project_cost"]) == (D("0.0111"), D("0.0008"), D("0.0103"))
    assert (hub["requests"], hub["cost_per_1000_requests"]) == (1440, D("0.0077"))


def test_cost_drives_the_join(spark):
    """Requests without a charge give no row; a charge without requests gives no ratio."""
    got = unit(
        spark,
        [
            charge("AWS", FIFTH, 1, tags=OURS),
            charge("Google Cloud", FIFTH, 1, account="host-project"),
            charge("Google Cloud", FIFTH, 1, tags=(("estate", "sandbox"),), account="host-project"),
        ],
        [(5, "azure", 180), (5, "gcp", 180), (5, "aws", 180)],
    )
    assert set(got) == {(5, "aws"), (5, "hub"), (5, "sandbox")}
    assert got[5, "hub"]["requests"] == 540
    assert got[5, "sandbox"]["requests"] is None and got[5, "sandbox"]["cost_per_1000_requests"] is None


def test_no_requests_is_no_ratio(spark):
    got = unit(spark, [charge("AWS", FIFTH, 1, tags=OURS)], [(5, "aws", 0)])
    assert got[5, "aws"]["requests"] == 0 and got[5, "aws"]["cost_per_1000_requests"] is None


def test_a_cloud_called_hub_does_not_double_the_hub_row(spark):
    got = unit(spark, [charge("Google Cloud", FIFTH, 1, account="host-project")], [(5, "hub", 5), (5, "aws", 7)])
    assert len(got) == 1 and got[5, "hub"]["requests"] == 12


def test_outside_the_platform(spark):
    rows = bill(
        spark,
        charge("AWS", FIFTH, 1, service="Amazon EC2"),
        charge("AWS", FIFTH, 2, tags=(("project", "other"),), service="Elastic Load Balancing"),
        charge("Microsoft", FIFTH, 4),
        charge("Google Cloud", FIFTH, 8, account="someone-else"),
        charge("AWS", date(2026, 10, 4), 16),
    )
    got = cost.outside_charges(rows, START, PLATFORM).agg(F.sum("cost")).first()[0]
    assert got == 15
    assert cost.daily_cost(cost.attribute(cost.charges_since(rows, START), PLATFORM)).count() == 0


def test_wrong_shape_fails_before_anything_runs(spark):
    good = spark.createDataFrame([], FOCUS)
    with pytest.raises(ShapeError, match="BilledCost"):
        focus.focus_all(good, good.withColumn("BilledCost", F.col("BilledCost").cast("double")))
    with pytest.raises(ShapeError):
        focus.focus_all(good, good.select(*reversed(good.columns)))
    with pytest.raises(ShapeError, match="missing"):
        focus.focus_all(good, good.drop("Tags"))


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column).first()[0]


KV = "t array<struct<key:string,value:string>>"
GCP = "own array<struct<Key:string,Value:string>>, inherited array<struct<Key:string,Value:string>>"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"a":"x","b":""}', "a=x,b="),
        ('{"a": "x","b":"y"}', "b=y"),
        ('{"a":3,"b":"y"}', "b=y"),
        (None, ""),
        ("", ""),
    ],
)
def test_tag_text(spark, text, expected):
    assert one(spark, "t string", (text,), tags_as_text(pairs_from_text(F.col("t")))) == expected


def test_tag_key_prefix(spark):
    tags = drop_key_prefix(F.col("t"))
    assert one(spark, KV, ([("user:a", "1"), ("aws:user:b", "2")],), tags_as_text(tags)) == "a=1,aws:user:b=2"
    assert one(spark, KV, (None,), F.size(tags)) == 0


@pytest.mark.parametrize(
    ("own", "inherited", "expected"),
    [
        ([("a", "1")], [("a", "2"), ("b", "3")], "a=1,b=3"),
        (None, [("a", "2")], "a=2"),
        ([("a", "1")], None, "a=1"),
        (None, None, ""),
        ([("a", "1"), ("a", "9")], [], "a=1"),
    ],
)
def test_label_merge(spark, own, inherited, expected):
    merged = own_then_inherited(F.col("own"), F.col("inherited"))
    assert one(spark, GCP, (own, inherited), tags_as_text(merged)) == expected


def test_tag_lookup(spark):
    assert one(spark, KV, ([("a", "1"), ("a", "2")],), tag(F.col("t"), "a")) == "1"
    assert one(spark, KV, ([],), tag(F.col("t"), "a")) is None


def test_money(spark):
    assert one(spark, "t string", ("0.1234567894999",), to_money(F.col("t"))) == D("0.123456789")
    rows = spark.createDataFrame([(0.1,)] * 10, "v double")
    assert rows.agg(float_total(F.col("v"))).first()[0] == D("1.000000000")


def test_pacific_month_edge(spark):
    raw = spark.createDataFrame([(datetime(2026, 9, 1, 7),), (datetime(2026, 9, 1, 6, 59),)], "t timestamp")
    from cloudtally.functions.dates import pacific_midnight

    got = [r[0] for r in raw.select(pacific_midnight(F.col("t")).cast("date")).collect()]
    assert got == [date(2026, 9, 1), date(2026, 8, 31)]


def test_dates_need_both_digits(spark):
    from cloudtally.functions.dates import us_date

    with pytest.raises(Exception, match="1/5/2026"):
        one(spark, "t string", ("1/5/2026",), us_date(F.col("t")))


@pytest.mark.parametrize(
    ("kind", "expected"),
    [("Usage", "Usage"), ("Purchase", "Purchase"), ("Refund", "Credit"), ("Odd", "Adjustment"), (None, "Adjustment")],
)
def test_charge_category(spark, kind, expected):
    assert one(spark, "t string", (kind,), focus.charge_category(F.col("t"))) == expected


def test_last_path_segment(spark):
    assert one(spark, "t string", ("/a/b/c",), focus.last_path_segment(F.col("t"))) == "c"
    assert one(spark, "t string", ("/a/b/",), focus.last_path_segment(F.col("t"))) is None


MONTHLY = "ProviderName string, billing_month date, pipeline_billed decimal(38,9)"
SOURCE = "ProviderName string, billing_month date, source_billed decimal(38,9), source_name string"


def test_reconcile(spark):
    october, september = date(2026, 10, 1), date(2026, 9, 1)
    pipeline = spark.createDataFrame(
        [("AWS", october, D("9.796196")), ("Google Cloud", october, D("0.03")), ("AWS", september, D("1"))], MONTHLY
    )
    source = spark.createDataFrame(
        [("AWS", october, D("9.796196"), "s"), ("Google Cloud", october, D("0.028662"), "s"), ("Microsoft", october, D("1"), "s")],
        SOURCE,
    )
    got = {(r[0], r[1].month): r for r in reconcile.reconcile(pipeline, source, tolerance=0.01).collect()}
    assert got["AWS", 10]["difference"] == 0 and got["AWS", 10]["agrees"]
    assert got["Google Cloud", 10]["difference"] == D("0.001338") and got["Google Cloud", 10]["agrees"]
    assert got["Microsoft", 10]["pipeline_billed"] is None and not got["Microsoft", 10]["agrees"]
    assert got["AWS", 9]["source_billed"] is None and got["AWS", 9]["difference"] is None


def test_source_totals_with_missing_credits(spark):
    rows = spark.createDataFrame(
        [(1.0, [(-0.25,)], ("202610",)), (1.0, None, ("202610",)), (1.0, [(None,), (-0.5,)], ("202610",))],
        "cost double, credits array<struct<amount:double>>, invoice struct<month:string>",
    )
    got = reconcile.gcp_source_totals(rows).first()
    assert (got["billing_month"], got["source_billed"]) == (date(2026, 10, 1), D("2.25"))


def test_month_partitions_are_pruned(spark, folder):
    rows = [charge("AWS", date(2026, m, 2), 1) for m in (8, 9, 10)]
    raw = bill(spark, *rows).withColumn("Tags", F.struct(F.col("Tags").alias("key_value")))
    raw = raw.withColumns({c: F.col(c).cast("double") for c in ("BilledCost", "EffectiveCost", "ListCost")})
    raw.withColumn("billing_month", F.trunc("ChargePeriodStart", "MM")).write.partitionBy("billing_month").parquet(folder)
    kept = focus.focus_aws(focus.months_from(spark.read.parquet(folder), date(2026, 10, 5), widen=1))
    assert kept.count() == 2
    read = kept.groupBy("ProviderName").agg(F.sum("BilledCost"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(billing_month" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "BilledCost" in schema and "ListCost" not in schema and "Tags" not in schema


def test_charge_window_reaches_the_scan(spark, folder):
    raw = bill(spark, charge("Google Cloud", TENTH, 1)).drop("Tags", "ServiceCategory")
    labels = F.array().cast("array<struct<Key:string,Value:string>>")
    raw.withColumns({"x_Labels": labels, "x_ProjectLabels": labels}).write.parquet(folder)
    kept = cost.charges_since(focus.focus_gcp(spark.read.parquet(folder)), START)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ChargePeriodStart" in plan and "ListCost" not in plan.split("ReadSchema: ")[1]


def test_focus_contract_has_eighteen_columns():
    assert len(FOCUS.fields) == 18 and isinstance(FOCUS["BilledCost"].dataType, T.DecimalType)


def test_a_raw_table_must_have_what_it_passes_on(spark):
    whole = bill(spark, charge("AWS", TENTH, 1)).withColumn("Tags", F.struct(F.col("Tags").alias("key_value")))
    assert focus.focus_aws(whole).count() == 1
    for name in ("ProviderName", "ServiceName", "ListCost"):
        with pytest.raises(Exception, match=name):
            focus.focus_aws(whole.drop(name))


def test_months_need_their_column_unless_told(spark):
    raw = spark.range(3).withColumnRenamed("id", "x")
    with pytest.raises(ShapeError, match="billing_month"):
        focus.months_from(raw, TENTH)
    assert focus.months_from(raw, TENTH, partitioned=False).count() == 3


def test_a_summary_is_over_calendar_days(spark):
    rows = [(date(2026, 10, 1), "aws", D("4.00004"), D("1")), (date(2026, 10, 3), "aws", D("4.00004"), D("3"))]
    unit = spark.createDataFrame(rows, "day date, estate string, cost decimal(38,9), cost_per_1000_requests decimal(38,9)")
    got = cost.full_day_summary(unit, date(2026, 10, 1), date(2026, 10, 4)).first()
    assert (got["days"], float(got["cost_per_day"]), float(got["thirty_days"])) == (2, 2.0, 60.0)


def test_reports_read_their_own_months(spark, folder):
    def loaded(name, rows, *drop):
        rows.withColumn("billing_month", F.trunc("ChargePeriodStart", "MM")).drop(*drop).write.partitionBy("billing_month").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    days = [date(2026, m, 2) for m in (7, 8, 9, 10)]
    aws = loaded("aws", bill(spark, *[charge("AWS", t, 1) for t in days]).withColumn("Tags", F.struct(F.col("Tags").alias("key_value"))))
    names = "billingAccountId SubscriptionId subscriptionName chargeType billingCurrency costInBillingCurrency paygCostInBillingCurrency meterCategory resourceLocation ResourceId tags"
    text = spark.createDataFrame([(t, t.strftime("%m/%d/%Y")) for t in days], "ChargePeriodStart date, date string")
    azure = loaded("azure", text.withColumns({n: F.lit("1") for n in names.split()}), "ChargePeriodStart")
    gcp = bill(spark, charge("Google Cloud", days[3], 1)).drop("Tags", "ServiceCategory")
    labels = F.array().cast("array<struct<Key:string,Value:string>>")
    gcp = gcp.withColumns({"x_Labels": labels, "x_ProjectLabels": labels})
    as_of = date(2026, 10, 5)
    runs = spark.createDataFrame([(1, "aws", 1, 1, datetime(2026, 10, 2))], "run_id long, cloud string, sent long, ok long, run_at timestamp")
    since = cost.report_start(as_of, start=date(2026, 1, 1))
    platform = cost.Platform(host_project="h", project_tag="p")
    reports = (
        cost.recent_spend(focus.focus_since(aws, azure, gcp, since), as_of),
        cost.recent_unit_cost(cost.unit_cost(focus.focus_since(aws, azure, gcp, since), runs, since, platform), as_of),
        cost.spend_to_date(focus.billed_in(aws, azure, gcp, as_of), as_of),
    )
    for report in reports:
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(billing_month") == 2, plan
