"""Mixing against a slot-by-slot simulation, and its promise of less than one block off."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cloudtally.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def slow_slots(blocks, parts):
    """{(stream, block): slot}, earliest deadline first round by round."""
    out, slot, at = {}, 0, [0] * len(blocks)
    while any(a < n for a, n in zip(at, blocks)):
        c = [min(q, n - a) for q, n, a in zip(parts, blocks, at)]
        total, done = sum(c), [0] * len(c)
        for t in range(total):
            ready = [(-(-(d + 1) * total // x), i) for i, (d, x) in enumerate(zip(done, c)) if d < x and d * total // x <= t]
            due, i = min(ready)
            assert due > t
            out[i, at[i] + done[i]] = slot
            done[i] += 1
            slot += 1
        at = [a + x for a, x in zip(at, c)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slots_and_deviation(spark, seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 9) for i in range(4)}
    sources = [rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", "zz", None]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    got = mixing.mix_sources(docs, weights, rest=2).collect()
    names = [*sorted(weights), mixing.REST]
    parts = [weights[n] for n in names[:-1]] + [2]
    counts = [sum((s if s in weights else mixing.REST) == n for s in sources) for n in names]
    want = slow_slots(counts, parts)
    assert {(names.index(r["mix_source"]), r["mix_block"]): r["mix_slot"] for r in got} == want
    assert sorted(r["mix_slot"] for r in got) == list(range(400))
    # until the first stream ends, each is less than a block off its share after every slot
    whole = min(n // q for n, q in zip(counts, parts)) * sum(parts)
    done = [0] * len(names)
    for r in sorted(got, key=lambda r: r["mix_slot"])[:whole]:
        done[names.index(r["mix_source"])] += 1
        t = r["mix_slot"] + 1
        assert all(abs(d - t * q / sum(parts)) < 1 for d, q in zip(done, parts))


def test_blocks_by_size(spark):
    rng = random.Random(9)
    rows = [(i, "ab"[i % 3 == 0], rng.choice([0, 1, 5, 30, 250, None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int")
    got = mixing.mix_sources(docs, {"a": 3, "b": 1}, size="n", block=20).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    for name in "ab":
        mine = sorted((r for r in got if r["mix_source"] == name), key=lambda r: r["mix_rank"])
        assert [r["mix_rank"] for r in mine] == list(range(len(mine)))
        at, total = 0, sum(r["n"] or 0 for r in mine)
        for r in mine:
            assert r["mix_block"] == min(at // 20, max(1, math.ceil(total / 20)) - 1)
            at += r["n"] or 0
        slots = [r["mix_slot"] for r in mine]
        assert slots == sorted(slots)


def test_slices_do_not_change_the_order(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("source"))
    one = mixing.mix_sources(docs, {"hot": 2}).orderBy("doc_id").collect()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    assert mixing.mix_sources(docs, {"hot": 2}).orderBy("doc_id").collect() == one


def test_odd_rows(spark):
    rows = [(1, "a", "t", 5), (1, "a", "t", 5), (None, None, None, 5), (2, "b", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    got = mixing.mix_sources(docs, {"a": 1})
    assert got.columns[:3] == ["doc_id", "source", "text"]
    assert sorted(r["mix_slot"] for r in got.collect()) == [0, 1, 2, 3]
    assert mixing.mix_sources(docs.limit(0), {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0})


def test_query_holds_every_document(spark):
    got = queries.op2_mixing(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.count() == n == got.select("doc_id").distinct().count()
