"""Three providers' bills on one 18-column schema."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.functions.dates import month_of, pacific_midnight, us_date
from cloudtally.functions.money import to_money
from cloudtally.functions.tags import drop_key_prefix, own_then_inherited, pairs_from_text
from cloudtally.schemas import FOCUS, MONEY, ShapeError, require_shape

# Provider names in the shared schema.
AWS = "AWS"
GOOGLE = "Google Cloud"
MICROSOFT = "Microsoft"


def _shared(df: DataFrame, what: str, **computed: Column) -> DataFrame:
    """The shared columns in order: computed where given, passed through otherwise.

    A raw table must have every column that is passed through.
    """
    have = set(df.columns)  # asked once: each look at a plan's columns is a call to the driver's JVM
    missing = [f.name for f in FOCUS.fields if f.name not in computed and f.name not in have]
    if missing:
        raise ShapeError(f"{what}: the raw table has no " + ", ".join(missing))
    columns = [computed[f.name].alias(f.name) if f.name in computed else F.col(f.name) for f in FOCUS.fields]
    return require_shape(df.select(*columns), FOCUS, what)


def focus_aws(raw: DataFrame) -> DataFrame:
    """Already in the shared shape: trim, make costs money, clean the tag keys."""
    costs = {c: to_money(F.col(c)) for c in ("BilledCost", "EffectiveCost", "ListCost")}
    return _shared(raw, "focus_aws", Tags=drop_key_prefix(F.col("Tags.key_value")), **costs)


def charge_category(charge_type: Column) -> Column:
    """Purchases and usage keep their name; anything unknown, or NULL, is an adjustment."""
    return (
        F.when(charge_type.isin("Usage", "Purchase"), charge_type)
        .when(charge_type == "Refund", F.lit("Credit"))
        .otherwise(F.lit("Adjustment"))
    )


def last_path_segment(path: Column) -> Column:
    """What follows the last slash, NULL if nothing does."""
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def focus_azure(raw: DataFrame, lenient_tags: bool = False) -> DataFrame:
    """Every column of this export is text; names and types are mapped by hand.

    The export has no billing period, so it is the month of the charge date.
    There are no reservations, so what was billed is also the effective cost.
    """
    day = us_date(F.col("date"))
    billed = to_money(F.col("costInBillingCurrency"))
    return _shared(
        raw,
        "focus_azure",
        ProviderName=F.lit(MICROSOFT),
        BillingAccountId=F.col("billingAccountId"),
        SubAccountId=F.col("SubscriptionId"),
        SubAccountName=F.col("subscriptionName"),
        BillingPeriodStart=month_of(day).cast("timestamp"),
        ChargePeriodStart=day.cast("timestamp"),
        ChargePeriodEnd=F.date_add(day, 1).cast("timestamp"),
        ChargeCategory=charge_category(F.col("chargeType")),
        BillingCurrency=F.col("billingCurrency"),
        BilledCost=billed,
        EffectiveCost=billed,
        ListCost=to_money(F.col("paygCostInBillingCurrency")),
        ServiceName=F.col("meterCategory"),
        ServiceCategory=F.lit(None).cast("string"),
        RegionId=F.col("resourceLocation"),
        ResourceId=F.col("ResourceId"),
        ResourceName=last_path_segment(F.col("ResourceId")),
        Tags=pairs_from_text(F.col("tags"), lenient_tags),
    )


def focus_gcp(raw: DataFrame) -> DataFrame:
    """Labels become tags, and the Pacific billing month moves to midnight UTC."""
    return _shared(
        raw,
        "focus_gcp",
        BillingPeriodStart=pacific_midnight(F.col("BillingPeriodStart")),
        BilledCost=F.col("BilledCost").cast(MONEY),
        EffectiveCost=F.col("EffectiveCost").cast(MONEY),
        ListCost=F.col("ListCost").cast(MONEY),
        ServiceCategory=F.lit(None).cast("string"),
        Tags=own_then_inherited(F.col("x_Labels"), F.col("x_ProjectLabels")),
    )


def focus_all(*bills: DataFrame) -> DataFrame:
    """Stack the bills. A bill of another shape fails here, before any row is read."""
    checked = [require_shape(b, FOCUS, f"bill {i + 1}") for i, b in enumerate(bills)]
    return reduce(DataFrame.union, checked)


def months_from(
    raw: DataFrame, start: date, widen: int = 0, month_column: str = "billing_month", partitioned: bool = True
) -> DataFrame:
    """Keep raw partitions that can hold charges from ``start`` on.

    A charge date computed from text cannot reach the file scan, but the load's
    own month partition can. ``widen`` keeps earlier months too, for an export
    whose billing month does not line up with the charge date. A table without
    the month column is an error, unless it is said not to be ``partitioned``:
    then it is read whole.
    """
    if not partitioned:
        return raw
    if month_column not in raw.columns:
        raise ShapeError(f"a table partitioned by {month_column} has no such column")
    first = F.add_months(F.trunc(F.lit(start), "MM"), -widen)
    return raw.filter(F.col(month_column) >= first)


def focus_since(aws: DataFrame, azure: DataFrame, gcp: DataFrame, start: date) -> DataFrame:
    """The stacked bill from the month of ``start`` on, pruned to the months that matter.

    The loaded tables are partitioned by month. The third one is another
    system's table, read in place; its charge dates reach the scan by themselves.
    """
    return focus_all(
        focus_aws(months_from(aws, start, widen=1)),
        focus_gcp(gcp),
        focus_azure(months_from(azure, start)),
    )


def billed_in(aws: DataFrame, azure: DataFrame, gcp: DataFrame, month: date, month_column: str = "billing_month") -> DataFrame:
    """The stacked bill of one billing month; of the loaded tables only its partition is read."""
    first = F.trunc(F.lit(month), "MM")
    rows = focus_all(
        focus_aws(months_from(aws, month, month_column=month_column).filter(F.col(month_column) == first)),
        focus_gcp(gcp),
        focus_azure(months_from(azure, month, month_column=month_column).filter(F.col(month_column) == first)),
    )
    return rows.filter(F.col("BillingPeriodStart") == first.cast("timestamp"))
