"""Queries that SQL can express, against their SQL on the smallest tables; and that all are registered."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry
from cloudtally.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    verdict, detail, _, _ = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.ORACLE[name])
    assert verdict == "ok", detail
