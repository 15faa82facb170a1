"""Exact top-k against every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudtally.llm import topk


def slow(rows, ask, k):
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if ask(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def got(spark, rows, k=10, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0, k=k, **how).collect()]


@pytest.mark.parametrize(("lists", "k"), [(1, 3), (2, 10), (3, 5)])
def test_against_every_pair(spark, monkeypatch, lists, k):
    monkeypatch.setattr(topk, "DATA_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(lists)
    vectors = rng.normal(size=(200, 8)).round(1).tolist()
    vectors[100:160] = [vectors[3]] * 60  # copies, some of them queries
    rows = [(i, v) for i, v in enumerate(vectors)]
    found = got(spark, [(*r, "x") for r in rows], k, lists=lists)
    assert len(found) == len(set(found)) and set(found) == slow(rows, lambda q: q % 7 == 0, k)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [-1.0, -2.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (14, [1.0]), (15, [2.0]), (21, []), (28, []), (35, [1.0, 2.0, 3.0])]
    found = got(spark, [(*r, None) for r in rows], 10)
    assert set(found) == slow(list(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows)), lambda q: q % 7 == 0, 10)
    assert got(spark, [], 10) == []


def test_large_components_stay_whole(spark):
    rows = [(i, [float(2**20 + i), -float(i)], "") for i in range(20)]
    assert set(got(spark, rows, 4)) == slow([r[:2] for r in rows], lambda q: q % 7 == 0, 4)


def test_components_beyond_exact_doubles(spark):
    rng = np.random.default_rng(6)
    for width, most in ((4, 2**29), (20_000, 2**21)):
        vectors = [rng.integers(-most, most, width).tolist() for _ in range(12)]
        rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = topk.top_k(rows, F.col("vec_id") % 4 == 0, k=3, scale=1).collect()
        want = []
        for q in (0, 4, 8):
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:3])]
        assert sorted(map(tuple, got)) == want


def test_components_too_large_for_a_score_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(rows, F.lit(True), k=1, scale=1024)
