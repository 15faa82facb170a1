"""Money and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudtally.schemas import MONEY


def to_money(amount: Column) -> Column:
    """A float, or text holding one, as money. Unreadable text raises (ANSI mode)."""
    return amount.cast("double").cast(MONEY)


def float_total(amount: Column) -> Column:
    """Total of a float column, made money once at the end.

    Adding doubles gives last digits that depend on the order tasks finish in,
    so a retried task could change the total. Each value is added as an exact
    decimal instead; the rounding to money still happens once, on the total.
    """
    return F.sum(amount.cast("decimal(38,15)")).cast(MONEY)


def per_thousand(cost: Column, requests: Column) -> Column:
    """Cost of a thousand requests, NULL when there were none."""
    return F.round(F.try_divide(cost, requests) * 1000, 4)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
