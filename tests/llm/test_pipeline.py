"""The pipeline's stages, each against what it must do to its own input."""

import pytest

import corpus_pipeline as pipeline
from cloudtally.llm import decontam, mixing
from cloudtally.session import scratch_dir

from .test_simhash import slow_fingerprint, slow_groups
from .test_tokens import slow as slow_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage, and those of the table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = docs
        path = scratch_dir(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_schema_and_loss(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for before, after in steps[:-1]:
        assert after.columns == columns
        assert after.exceptAll(before).isEmpty()


def test_language_keeps_clean_documents(steps):
    before, after = steps[0]
    gone = before.exceptAll(after).collect()
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in gone)


@pytest.mark.parametrize("learned", [("en", "fr"), ("de", "en", "es"), ("de", "en", "es", "fr")])
def test_languages_not_learned_are_rejected(spark, learned):
    from pyspark.sql import functions as F

    known = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("lang").isin(*learned))
    foreign = ["Привет мир, это текст на другом языке и ничего больше", "これは日本語の文章です。それだけです。", "Αυτό είναι ένα κείμενο σε άλλη γλώσσα", "이것은 다른 언어로 된 글입니다"]
    odd = spark.createDataFrame([(-1 - i, t, None, "a", len(t)) for i, t in enumerate(foreign)], known.schema)
    kept = {r["doc_id"] for r in pipeline.known_language(spark, known.unionByName(odd), SF).collect()}
    assert min(kept) >= 0
    assert all(r["doc_id"] in kept for r in known.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_one_of_each_group(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1][0].collect()]
    groups = slow_groups([(d, slow_fingerprint(t)) for d, t in rows], 4)
    assert sorted(r["doc_id"] for r in steps[1][1].collect()) == sorted(set(groups))


def test_no_benchmark_is_left(spark, steps):
    items = [" ".join(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda r: any(f" {i} " in f" {' '.join(decontam.words_of(r['text']))} " for i in items)
    before, after = (df.collect() for df in steps[2])
    assert any(map(holds, before)) and not any(map(holds, after))
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] in kept or holds(r) for r in before)


def test_mix_order_reaches_the_ids(spark, steps):
    from pyspark.sql import functions as F

    before, after = steps[3]
    assert before.count() == after.count()
    sizes = before.withColumn("n", F.char_length("text"))
    placed = mixing.mix_sources(sizes, pipeline.queries.MIX_WEIGHTS, pipeline.queries.MIX_REST, pipeline.queries.MIX_BLOCK, "n")
    want = [(r["doc_id"], r["text"]) for r in placed.orderBy("mix_slot", "mix_rank").collect()]
    got = steps[4][1].orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == slow_ids(want)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "unlike all others here", "en", None, 1), (None, "unlike all others here", "en", None, 1), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = pipeline.one_of_each_group(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "unlike all others here"), (1, text), (2, "")]


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_columns_of_the_same_names_pass_through(spark):
    names = ["Score", "lang_pred", "row", "id", "hash", "gone_id", "mix_slot", "size", "text_hash", "file"]
    rows = [(i, f"the cat number {i} sat on mat {i * i}", "en", "a", *["mine"] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for stage in (pipeline.known_language, pipeline.one_of_each_group, pipeline.without_benchmark, pipeline.mixed):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert {r[n] for r in got.collect() for n in names} == {"mine"}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for stage in (pipeline.known_language, pipeline.one_of_each_group, pipeline.without_benchmark, pipeline.mixed):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.collect() == []
    path = scratch_dir(spark, "empty")
    docs.write.parquet(path)
    assert pipeline.token_files(spark, spark.read.parquet(path), SF).collect() == []
