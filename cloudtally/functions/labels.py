"""Label matching on metric series. A label a series does not have equals ''."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def matches(df: DataFrame, name: str, op: str, value: str) -> Column:
    """One matcher: ``=``, ``!=``, ``=~`` or ``!~``. Patterns match the whole label."""
    have = label(df, name)
    if op == "=":
        return have == value
    if op == "!=":
        return have != value
    if op in ("=~", "!~"):
        found = have.rlike(f"^(?:{value})$")
        return found if op == "=~" else ~found
    raise ValueError(f"unknown label operator {op!r}")


def select_series(df: DataFrame, *matchers: tuple[str, str, str]) -> DataFrame:
    """Rows all matchers accept. Plain comparisons reach the file scan as filters."""
    for name, op, value in matchers:
        df = df.filter(matches(df, name, op, value))
    return df


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", empty: bool = False) -> DataFrame:
    """Join on equal keys where a missing value equals a missing one; the keys come out once.

    With ``empty``, keys are text labels, and a missing one also equals ``''``.
    A full join gives each key from whichever side has the row.
    """
    there = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])

    def side(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if empty else F.col(name)

    same = reduce(Column.__and__, [side(k).eqNullSafe(side(f"_r_{k}")) for k in keys])
    joined = left.join(there, same, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def only_cloud(df: DataFrame, cloud: str | None = None) -> DataFrame:
    """The optional cloud filter every dashboard panel takes."""
    return df if not cloud else df.filter(F.col("cloud") == cloud)
