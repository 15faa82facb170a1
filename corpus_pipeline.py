"""A training corpus from raw documents: the registered query ``pipeline``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.llm import decontam, language, mixing, queries, simhash, tokens
from cloudtally.llm.shared import table
from cloudtally.session import scratch_dir


def least_score(languages: int) -> float:
    """The calibrated probability that a document's best language needs: halfway from a guess among all learned ones to certainty.

    With one language every score is 1, so nothing with a letter is rejected.
    """
    return (1 + 1 / max(languages, 1)) / 2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with ``least_score``; the model learns from the labelled rows of three quarters of them."""
    model = language.train(docs.filter(~language.held_out()))
    aside = {c: f"own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}
    told = language.classify(docs.withColumnsRenamed(aside), model)
    kept = told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least_score(len(model.languages)))).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in aside.items()})


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; the rows of the written files go by it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.char_length("text").alias("size"))
    placed = mixing.mix_sources(rows, queries.MIX_WEIGHTS, queries.MIX_REST, queries.MIX_BLOCK, "size")
    return placed.orderBy("mix_slot", "mix_rank").select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order in which the documents stand in their files, written in coded blocks and read back."""
    path = scratch_dir(spark, "pipeline-ids")
    # By number: names of files have five digits, and there may be more files.
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", number.alias("number"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    tokens.write_ids(placed, path, queries.TOKENIZER, queries.VOCABULARY, queries.END, order=[F.col("number"), F.col("file"), F.col("row")])
    return tokens.read_ids(spark, path, with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mix", mixed),
    ("token_ids", token_files),
]

#: Hashes, classifiers and tokenizers are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
