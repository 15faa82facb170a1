"""Decontamination: recall of exact and reworded items against brute force, and clean documents left alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudtally.llm import decontam

SF = "/root/testdata/sf0.001"


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert decontam.common_length(a, b) == slow_common(a, b)


def test_space_is_that_of_a_dense_svd(spark):
    """The space gives the cosines of a whole singular value decomposition, up to rotation."""
    rng = np.random.default_rng(2)
    rows = [(i, i, rng.integers(-1, 20, 64).tolist()) for i in range(60)]
    coded = spark.createDataFrame(rows, "doc_id long, text_hash long, codes array<int>")
    idf = rng.random(20) + 0.5
    items = decontam.Items([0], [np.arange(5, dtype=np.int32)], [np.arange(2, dtype=np.int32)], {})
    s = decontam.Settings(rank=20, spare=20, oversample=4, fit_passages=10**6)
    space = decontam.latent_space(coded, items, idf, 120, s)
    size = decontam.SEGMENT * decontam.PASSAGE
    passages = [np.array(c[at : at + size]) for *_, c in rows for at in range(0, 64, size)]
    dense = np.array([np.bincount(p[p >= 0], minlength=20) * idf for p in passages])
    own = np.bincount(items.codes[0], minlength=20) * idf
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    whole = np.vstack([unit(dense), np.sqrt(len(passages)) * unit(own)[None]])
    values, vectors = np.linalg.eigh(whole.T @ whole)
    want = (idf[:, None] * vectors / values**0.25) @ (idf[:, None] * vectors / values**0.25).T
    assert np.allclose(space @ space.T, want, rtol=2e-2, atol=2e-3 * np.abs(want).max())


def test_every_passage_counts_in_the_space(spark):
    """Ten words of which each is in one passage only, among 300,000 others: none may be left out."""
    common = F.transform(F.sequence(F.lit(0), F.lit(31_999)), lambda i: (i % 10).cast("int"))
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"), common.alias("codes"))
    rare = spark.range(10).select(
        (1_000 + F.col("id")).alias("doc_id"), F.xxhash64(F.col("id") + 1_000).alias("text_hash"), F.array_repeat((10 + F.col("id")).cast("int"), 32).alias("codes")
    )
    items = decontam.Items([0], [np.arange(5, dtype=np.int32)], [np.arange(2, dtype=np.int32)], {})
    space = decontam.latent_space(many.unionByName(rare), items, np.ones(20), 300_010, decontam.Settings(spare=40))
    assert (np.abs(space[10:]).max(axis=1) > 0.5).all()


def test_products_are_those_of_dense_rows(monkeypatch):
    """Long and short rows, cut into pieces of any size."""
    rng = np.random.default_rng(5)
    lengths = [1, 700, 3, 3, 40, 2, 900, 1]
    own, codes = np.repeat(2 * np.arange(len(lengths)), lengths), rng.integers(0, 50, sum(lengths))
    idf, thin = rng.random(50) + 0.5, rng.normal(size=(50, 6)).astype(np.float32)
    rows = np.array([np.bincount(codes[own == o], minlength=50) * idf for o in np.unique(own)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for gathered, entries in ((1 << 19, 1 << 17), (1, 1), (30, 50), (60, 710)):
        monkeypatch.setattr(decontam, "GATHERED", gathered)
        total = np.zeros((50, 6))
        decontam._add_products(total, codes, own, idf, thin, entries)
        assert np.allclose(total, rows.T @ (rows @ thin), atol=1e-5)
    decontam._add_products(total, codes[:0], own[:0], idf, thin)


def planted(spark, reword):
    """The test documents, with items put into some of them; {(doc, item)} that must be found."""
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    where = {}
    for k, (doc, text) in enumerate(docs):
        if k % 4 == 0:
            item, said = rng.choice(items)
            words = said.split()
            for at in rng.sample(range(len(words)), int(reword * len(words))):
                words[at] = rng.choice(["quux", "zorp", "blivet"])
            own = text.split()
            cut = rng.randint(0, len(own))
            docs[k] = (doc, " ".join(own[:cut] + words + own[cut:]))
            where[doc] = item
    return docs, items, set(where.items())


@pytest.mark.parametrize(("reword", "least"), [(0.0, 1.0), (0.2, 0.9)])
def test_recall(spark, reword, least):
    docs, items, must = planted(spark, reword)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & must) >= least * len(must)
    words = {d: decontam.words_of(t) for d, t in docs}
    said = {i: decontam.words_of(t) for i, t in items}
    for r in got:
        share = slow_common(said[r["item_id"]], words[r["doc_id"]]) / len(said[r["item_id"]])
        assert share >= r["common_words"] / r["item_words"] >= 0.6
    # brute force over all pairs: nothing that reads like an item is left out
    if not reword:
        whole = {(d, i) for d, w in words.items() for i, s in said.items() if f" {' '.join(s)} " in f" {' '.join(w)} "}
        assert whole <= found


def test_recall_with_known_words_and_a_small_fit(spark):
    """Replaced words that add noise to a passage's vector, and a space fitted on few of the passages."""
    rng = random.Random(4)
    docs, items, must = planted(spark, 0.0)
    said, known = {i: " ".join(t.split()) for i, t in items}, sorted({w for _, t in items for w in decontam.words_of(t)})
    texts = dict(docs)
    for doc, item in must:
        words = said[item].split()
        for at in rng.sample(range(len(words)), int(0.2 * len(words))):
            words[at] = rng.choice(known)
        assert said[item] in texts[doc]
        texts[doc] = texts[doc].replace(said[item], " ".join(words))
    passages = sum(-(-len(decontam.words_of(t)) // decontam.SEGMENT) for t in texts.values())
    settings = decontam.Settings(fit_passages=passages // 20)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench, settings).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got} & must) >= 0.9 * len(must)


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. nu xi omicron pi rho"
    rows = [(1, None, 1), (2, "", 2), (None, "so " + item, 3), (4, "word " * 30_000 + item + " word" * 100, 4), (4, "unlike", 5), (5, item, 6), (5, item, 6), (6, "nu xi omicron pi rho", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "x y z"), (4, "...")], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (4, 1), (5, 1), (5, 1)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [1, 2, 5, 7]
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_an_answer_column_decides_on_paraphrases(spark):
    docs, items, _ = planted(spark, 0.0)
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words[:20] + ["other"] * 10)
    docs = [*docs, (-1, text + " forty two"), (-2, text + " no such thing"), (-3, " ".join(words))]
    bench = spark.createDataFrame([*((i, t, None) for i, t in items), (-1, " ".join(words), "forty two")], "item_id long, text string, answer string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, answer_col="answer").filter("item_id = -1")
    assert sorted((r["doc_id"], r["common_words"]) for r in got.collect()) == [(-3, 30), (-1, 20)]


def test_blocks_of_items(spark, monkeypatch):
    docs, items, must = planted(spark, 0.0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 15)
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert must <= {(r["doc_id"], r["item_id"]) for r in got}


def test_segment_vectors_by_rank():
    """Sums of whole rows, against one vector after another; unknown words and empty segments among them."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        segment = np.repeat(np.arange(n), rng.integers(0, decontam.SEGMENT + 1, n))
        codes = rng.integers(-1, 50, len(segment)).astype(np.int32)
        space = rng.normal(size=(50, 12)).astype(np.float32)
        want = np.zeros((n, 12))
        np.add.at(want, segment[codes >= 0], space[codes[codes >= 0]].astype(float))
        assert np.allclose(decontam._segment_vectors(codes, segment, n, space), want, atol=1e-4)


def test_search_gathers_rows_of_a_matrix_that_lies_by_row(monkeypatch):
    """The space comes from its decomposition by column; rows gathered from that would turn the whole matrix each time."""
    rng = np.random.default_rng(6)
    space = np.asfortranarray(rng.normal(size=(40, 8)).astype(np.float32))
    items = decontam.Items([7], [np.arange(20, dtype=np.int32)], [np.arange(15, 20, dtype=np.int32)], {})
    codes = [[-1] * 20 + list(range(20)) + [-1] * 9, rng.integers(20, 40, 100).tolist()]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([3, 4]), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "codes"]
    )
    by_row, sums = [], decontam._segment_vectors

    def watched(codes, segment, n, space):
        by_row.append(space.flags.c_contiguous)
        return sums(codes, segment, n, space)

    monkeypatch.setattr(decontam, "_segment_vectors", watched)
    (got,) = decontam._search(items, space, decontam.Settings())(iter([batch]))
    assert by_row == [True]
    assert [(r["doc_id"], r["item_id"], r["common_words"], r["answer_share"]) for r in got.to_pylist()] == [(1, 7, 20, 1.0)]
