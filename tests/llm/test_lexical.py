"""Ranked search against scores worked out for every document and item."""

import math
import random
import re

import numpy as np
import pytest

from cloudtally.llm import lexical, queries

SF = "/root/testdata/sf0.001"


def slow_terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def slow_search(docs, items, k=10):
    """docs: (doc_id, text); items: {item_id: text}. Rows (item_id, rank, doc_id, score)."""
    bags = [(d, slow_terms(t)) for d, t in docs]
    held = [(d, b) for d, b in bags if b]
    n_docs, words = len(held), sum(len(b) for _, b in held)
    df = {}
    for _, b in held:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items.items():
        found = []
        for d, b in held:
            m = 100 - 90 + (90 * len(b) * n_docs) // words
            score = 0
            for t in set(slow_terms(text)):
                tf = b.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def rows_of(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["É", "ß9", "naïve", "A", "a-b", "x_y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # copies tie
    items = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for i in range(20)}
    return docs, items


def ranked(spark, docs, items, k=10, parts=4):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return lexical.ranked_search(table, spark.createDataFrame(list(items.items()), "item_id long, text string"), k)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [1, 10])
def test_the_best_documents_of_any_corpus(spark, seed, k):
    docs, items = corpus(seed)
    assert rows_of(ranked(spark, docs, items, k)) == sorted(slow_search(docs, items, k), key=str)


def test_small_shards_and_blocks_of_items_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    docs, items = corpus(9)
    assert rows_of(ranked(spark, docs, items)) == sorted(slow_search(docs, items), key=str)


def test_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert rows_of(queries.op13_lexical(spark, SF)) == sorted(slow_search(docs, items), key=str)


def shard(lists):
    """lists: {term: {doc: impact}}."""
    rows = [(t, d, s) for t, docs in lists.items() for d, s in docs.items()]
    term, doc, impact = (np.array(c, np.int64) for c in zip(*rows))
    return lexical.Shard(term, doc, impact, max(lists) + 1)


def test_reading_stops_before_the_end_of_the_lists():
    rng = random.Random(2)
    lists = {t: {d: 10**6 // (1 + d) + rng.randrange(3) for d in rng.sample(range(40_000), 20_000)} for t in range(4)}
    made = shard(lists)
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                touched.append(key.stop - key.start)
            return super().__getitem__(key)

    made.sorted = made.sorted.view(Counted)
    docs, sums = made.best(np.arange(4), 10)
    want = sorted(((-sum(x.get(d, 0) for x in lists.values()), d) for d in range(40_000)))[:10]
    assert [(-s, d) for d, s in zip(docs.tolist(), sums.tolist())] == want
    assert sum(touched) < 4 * 20_000 / 10


def test_ties_at_the_edge_are_all_seen():
    """Many documents with the same sum: the smallest numbers win, so reading may not stop at an equal sum."""
    lists = {0: dict.fromkeys(range(5_000), 7), 1: {d: 7 for d in range(4_000, 9_000)}}
    docs, sums = shard(lists).best(np.array([0, 1]), 10)
    assert docs.tolist() == list(range(4_000, 4_010)) and set(sums.tolist()) == {14}
    docs, _ = shard({0: dict.fromkeys(reversed(range(5_000)), 7)}).best(np.array([0]), 3)
    assert docs.tolist() == [0, 1, 2]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?! \t"), (None, "only here"), (5, "only"), (5, "only"), (6, "Only ONLY"), (7, "word " * 100_000 + "here"), (8, "É é")]
    items = {1: "only", 2: None, 3: "...", 4: "here é", 5: "nowhere", 6: "É"}
    assert rows_of(ranked(spark, docs, items)) == sorted(slow_search(docs, items), key=str)
    assert ranked(spark, docs, items).limit(0).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(empty, some).collect() == []
    assert lexical.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), some.limit(0)).collect() == []


def test_columns_of_the_same_names_do_not_matter(spark):
    docs, items = corpus(4, n=40)
    table = spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in docs], "doc_id long, text string, n int, terms string, `a.b` double")
    asked = spark.createDataFrame([(i, t, "t") for i, t in items.items()], "item_id long, text string, term string")
    assert rows_of(lexical.ranked_search(table, asked)) == sorted(slow_search(docs, items), key=str)


def test_rows_of_one_item_are_one_item(spark):
    docs, _ = corpus(5, n=50)
    asked = spark.createDataFrame([(1, docs[0][1]), (1, docs[1][1]), (1, docs[0][1]), (None, docs[2][1])], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = slow_search(docs, {1: f"{docs[0][1]} {docs[1][1]}", None: docs[2][1]})
    assert rows_of(lexical.ranked_search(table, asked)) == sorted(want, key=str)
