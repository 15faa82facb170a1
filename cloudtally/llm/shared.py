"""Small helpers the operators share: saved tables, word splitting, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.session import scratch_dir

#: Text bytes a Python worker looks at together; bounds its memory, changes no result.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends there, and no executor is needed to keep it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python a few megabytes at a time, however long a row's text is."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * CHUNK_BYTES))
    return df


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Shuffle partitions of about ``rows_each`` rows, never fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_each))


def crc32_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``size`` bytes of text, and at least one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(first, stop - first)
            first = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on from task to task, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps it, and only glibc has this
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: their codes in text order, words per text, and what each code stands for."""
    lists = pc.ascii_split_whitespace(texts)
    counts = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), counts)
    full = np.asarray(pc.not_equal(flat, ""))
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return (
        coded.indices.to_numpy().astype(np.int64),
        np.bincount(row[full], minlength=len(lists)).astype(np.int64),
        coded.dictionary.to_pylist(),
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) with the smallest node reachable, for undirected ``edges`` (a, b) of longs.

    Alternates two passes over the edge table, each a group by node: neighbours
    above a node are tied to its smallest neighbour, then those below. Each
    pass is written to the shared folder. A node's neighbours are never
    gathered: the smallest is a plain minimum, joined back. Nodes without an
    edge are not in the result; edges with a null end are ignored.
    """
    tied = saved(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    while True:
        both = tied.unionByName(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (
            both.join(low, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        kept = large.join(low, "a")
        small = (
            kept.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        after = saved(small, name)
        # A star forest has one edge per node and no root that is also a leaf; then nothing moves any more.
        moved = after.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        before = tied.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        tied = after
        if moved == before:
            return tied.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                tied.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
