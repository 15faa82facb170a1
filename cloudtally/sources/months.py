"""Monthly billing exports: find them, load them once, check what was loaded.

An export is rewritten with the whole month so far, and late adjustments reach
a month after it closes. So a load replaces last month and this month, and
never appends.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.functions.money import to_money
from cloudtally.sources import versions
from cloudtally.sources.files import read_split_csv, read_text_csv

MONTH = "billing_month"


def billing_periods(as_of: date) -> list[str]:
    """Last month and this month as ``yyyy-MM``."""
    this_month = as_of.replace(day=1)
    last_month = (this_month - timedelta(days=1)).replace(day=1)
    return [last_month.strftime("%Y-%m"), this_month.strftime("%Y-%m")]


def month_start(period: str) -> date:
    return date.fromisoformat(f"{period}-01")


def _part(period: str) -> str:
    return f"{MONTH}={month_start(period)}"


def _or_none(read) -> DataFrame | None:
    """A folder that is not there means the month has no export yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_parquet_month(spark: SparkSession, root: str, period: str) -> DataFrame | None:
    """The Parquet files of one month's folder, ``None`` if there are none.

    Only that folder is listed, and files of other kinds in it are passed over.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    return _or_none(lambda: reader.parquet(f"{root}/billing_period={period}"))


def newest_export(spark: SparkSession, root: str, period: str) -> str | None:
    """Path of the latest file in a month's folder, named like ``20240101-20240131``.

    Every run holds the month so far, so the others are older copies. Files
    are listed with their times and not opened; one path comes back.
    """
    folder = f"{root}/{period.replace('-', '')}01-*"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
    files = _or_none(lambda: reader.load(folder))
    if files is None:
        return None
    return files.agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path")).first()["path"]


def read_azure_month(spark: SparkSession, root: str, period: str, line_breaks: bool = True) -> DataFrame | None:
    """The newest export of a month, ``None`` if there is none.

    A folder below the month's is that of one run, whose files are parts of
    one export. Files in the month's own folder are each a whole one.
    """
    path = newest_export(spark, root, period)
    if path is None:
        return None
    folder = path.rsplit("/", 1)[0]
    alone = folder.rsplit("/", 1)[-1].startswith(f"{period.replace('-', '')}01-")
    where = path if alone else f"{folder}/*.csv"
    return read_split_csv(spark, where) if line_breaks else read_text_csv(spark, where, line_breaks=False)


def replace_month(df: DataFrame, table_path: str, period: str) -> None:
    """Put ``df`` in place of one month's partition; other months stay as they are.

    The new version is published when all of it is written, so a write that
    fails leaves the month as it was, and a month rewritten without rows loses
    the ones it had.
    """
    versions.write_part(df.drop(MONTH), table_path, _part(period))


def load_audit(spark: SparkSession, table_path: str, period: str, cost: str) -> DataFrame:
    """Rows and billed total of a loaded month; only its files are listed and opened."""
    return (
        versions.read_table(spark, table_path, [_part(period)])
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum(to_money(F.col(cost))), 4).alias("billed_cost"))
        .select(F.lit(period).alias("period"), "row_count", "billed_cost")
    )


def _load(spark: SparkSession, read, root: str, table_path: str, periods: Sequence[str], cost: str) -> DataFrame | None:
    audits = None
    for period in periods:  # two periods, whatever the size of the data
        month = read(spark, root, period)
        if month is None:
            continue
        replace_month(month, table_path, period)
        audit = load_audit(spark, table_path, period, cost)
        audits = audit if audits is None else audits.unionByName(audit)
    return audits


def load_aws(spark: SparkSession, root: str, table_path: str, as_of: date) -> DataFrame | None:
    """Load the rolling two months of the Parquet export; returns the audit."""
    return _load(spark, read_parquet_month, root, table_path, billing_periods(as_of), "BilledCost")


def load_azure(spark: SparkSession, root: str, table_path: str, as_of: date, line_breaks: bool = True) -> DataFrame | None:
    """Load the newest CSV export of the rolling two months; returns the audit.

    Large files are read by many tasks. Where their values hold no line breaks,
    ``line_breaks=False`` saves the look for them.
    """
    read = partial(read_azure_month, line_breaks=line_breaks)
    return _load(spark, read, root, table_path, billing_periods(as_of), "costInBillingCurrency")
