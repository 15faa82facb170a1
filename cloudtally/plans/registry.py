"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cloudtally.plans import check_queries, cost_queries, feed_queries, load_queries, telemetry_queries
from cloudtally.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (cost_queries, load_queries, telemetry_queries, check_queries, feed_queries)


def _in_utc(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(use_utc(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
