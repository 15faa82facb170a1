"""Date expressions. All of them read a session pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone one provider's billing month runs on.
PACIFIC = "America/Los_Angeles"


def us_date(text: Column) -> Column:
    """``MM/dd/yyyy`` text as a date; both digits are required."""
    return F.to_date(text, "MM/dd/yyyy")


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def pacific_midnight(instant: Column) -> Column:
    """Midnight UTC on the calendar date an instant has in Pacific time."""
    return F.to_date(F.from_utc_timestamp(instant, PACIFIC)).cast("timestamp")


def invoice_month(text: Column) -> Column:
    """``yyyyMM`` text as the first day of that month."""
    return F.to_date(text, "yyyyMM")
