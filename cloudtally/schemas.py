"""Column contracts of the shared bill and of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(38, 9)

TAG_ARRAY = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)

# The 18 shared columns. Order and type are the contract.
FOCUS = T.StructType(
    [
        T.StructField("ProviderName", T.StringType()),
        T.StructField("BillingAccountId", T.StringType()),
        T.StructField("SubAccountId", T.StringType()),
        T.StructField("SubAccountName", T.StringType()),
        T.StructField("BillingPeriodStart", T.TimestampType()),
        T.StructField("ChargePeriodStart", T.TimestampType()),
        T.StructField("ChargePeriodEnd", T.TimestampType()),
        T.StructField("ChargeCategory", T.StringType()),
        T.StructField("BillingCurrency", T.StringType()),
        T.StructField("BilledCost", MONEY),
        T.StructField("EffectiveCost", MONEY),
        T.StructField("ListCost", MONEY),
        T.StructField("ServiceName", T.StringType()),
        T.StructField("ServiceCategory", T.StringType()),
        T.StructField("RegionId", T.StringType()),
        T.StructField("ResourceId", T.StringType()),
        T.StructField("ResourceName", T.StringType()),
        T.StructField("Tags", TAG_ARRAY),
    ]
)

LOAD_RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("cloud", T.StringType()),
        T.StructField("sent", T.LongType()),
        T.StructField("ok", T.LongType()),
        T.StructField("run_at", T.TimestampType()),
    ]
)

REQUESTS_DAILY = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("cloud", T.StringType()),
        T.StructField("requests", T.DoubleType()),
    ]
)

LOG_RECORD = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)


class ShapeError(ValueError):
    """A table does not have the columns its contract names."""


def require_shape(df: DataFrame, contract: T.StructType, what: str = "table") -> DataFrame:
    """Fail while the plan is built if names, order or types differ (nullability may).

    Spark's positional union coerces mismatched columns and only fails, if at
    all, when rows are read, so the check has to be explicit.
    """
    want = [(f.name, f.dataType.simpleString()) for f in contract.fields]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if want != have:
        wrong = [f"{h} is not {w}" for w, h in zip(want, have) if w != h]
        wrong += [f"missing {w}" for w in want[len(have):]] + [f"unexpected {h}" for h in have[len(want):]]
        raise ShapeError(f"{what}: " + "; ".join(wrong))
    return df
