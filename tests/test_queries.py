"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry
from cloudtally.plans import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


# Queries whose rows come in an order: the columns, and which of them go down.
ORDERED = {
    "runs_per_day": ("day", "cloud"),
    "recent_unit_cost": ("day", "estate"),
    "view_recent_unit_cost": ("day", "estate"),
    "recent_spend": ("day", "-cost"),
    "daily_requests": ("day", "cloud"),
    "latest_errors": ("-ts", "cloud", "message"),
}


@pytest.mark.parametrize("name", list(ORDERED))
def test_order(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    for column in reversed(ORDERED[name]):
        rows = sorted(rows, key=lambda r: r[column.lstrip("-")], reverse=column.startswith("-"))
    assert len(rows) > 1 and rows == QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, detail, _, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLE.get(name))
    assert verdict in ("ok", "rows"), detail
