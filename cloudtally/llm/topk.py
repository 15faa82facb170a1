"""Exact top-k by inner product: three phases with one threshold for all component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloudtally.llm.shared import saved

#: Different vectors per data block and per query block: what one task holds at a time.
DATA_BLOCK = 8192
QUERY_BLOCK = 1024
#: Doubles hold whole numbers below this exactly, and are faster.
_EXACT_IN_DOUBLE = 1 << 53


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null, NaN or infinite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    # No partial sum is larger than this, whatever the signs and the order.
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < _EXACT_IN_DOUBLE:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), width)


def _scores(best: int | None, cutoffs: bool):
    """Scores of one list, for one block of queries against one block of data.

    With ``best``, the entries of each query from its ``best``-th score up; else
    those that reach the query's cutoff. Output: (qid, vid, score), flat.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, rows = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        width = len(pdf["part"].iat[0])
        data = _matrix(rows["part"], width)
        vids = rows["vid"].to_numpy(np.int64)
        out = []
        for first in range(0, len(asks) if len(rows) else 0, 128):
            some = asks.iloc[first : first + 128]
            scores = _products(_matrix(some["part"], width), data)
            if cutoffs:
                floor = some["cutoff"].to_numpy(np.int64)[:, None]
            else:
                k = min(best, len(vids))
                floor = np.partition(scores, len(vids) - k, axis=1)[:, len(vids) - k, None]
            q, v = np.nonzero(scores >= floor)
            if not cutoffs:  # ties at the floor are left out beyond the count: any entries make a safe cutoff
                place = np.arange(len(q)) - np.searchsorted(q, q)
                order = np.lexsort((-scores[q, v], q))
                q, v = q[order][place < best], v[order][place < best]
            out.append(pd.DataFrame({"qid": some["vid"].to_numpy(np.int64)[q], "vid": vids[v], "score": scores[q, v]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vid": [], "score": []}, dtype=np.int64)

    return run


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, lists: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row that ``queries`` selects.

    Components become ``floor(scale * x)``, scores are whole inner products,
    ties go to the smaller id; ranks start at 1. All results are exact.

    Equal vectors are one entry with the k+1 smallest of their ids: no more
    can be asked for, so any number of copies costs one comparison. Vectors
    are cut into ``lists`` runs of components, each scored on its own:

    1. every list gives its best entries of each block; the k+1-th best whole
       score among these candidates is a safe cutoff for the query;
    2. an entry with a whole score of at least the cutoff reaches cutoff/lists
       in one list or more, so every list gives all entries that do;
    3. what was given is scored over the remaining components, and ranked.

    Vectors that are null, or hold a null or non-finite component, take no part
    (nor do rows without an id), and only vectors of equal length are compared.
    A row whose vector repeats under the same id counts once. An empty table,
    or a query without another row, gives no rows. Components so large that a
    score could leave 64 bits raise an error. Further columns are ignored. Queries and data meet block by block; neither is broadcast.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).filter("id IS NOT NULL AND v IS NOT NULL").distinct()
    # The smallest ids of each vector: the limit on the rank is applied before the shuffle too.
    first = W.partitionBy("v").orderBy("id")
    members = rows.groupBy("v", "id").agg(F.max("asks").alias("asks")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    members = saved(members.select("v", "id", "n"), "topk-members")
    entries = saved(members.filter("n = 1").select(F.col("id").alias("vid"), "v", F.size("v").alias("width")), "topk-entries")
    asked = rows.filter("asks").select("id", "v").distinct()
    asked = saved(
        asked.join(entries.select("vid", "v"), "v").select(F.col("id").alias("query_id"), F.col("vid").alias("qid")), "topk-queries"
    )
    asks = asked.select("qid").distinct()
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n_data, most, width = entries.agg(F.count(F.lit(1)), F.max(largest), F.max("width")).first()
    if (most or 0.0) ** 2 * (width or 0) >= 2.0**63:
        raise ValueError("components are too large for scores of 64 bits; use a smaller scale")
    n_asks = asks.count()
    data_blocks, query_blocks = max(1, -(-n_data // DATA_BLOCK)), max(1, -(-n_asks // QUERY_BLOCK))

    def part(i: int) -> Column:
        cut = lambda j: F.floor(F.col("width") * j / lists).cast("int")
        return F.slice("v", cut(i) + 1, cut(i + 1) - cut(i))

    cut_up = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), part(i).alias("part")) for i in range(lists)])).alias("p")
    block = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = ["width", "list", "db", "qb"]
    data = entries.select("vid", "width", cut_up).select(
        "vid", "width", "p.list", "p.part", block("vid", data_blocks).alias("db"), every(query_blocks).alias("qb"),
        F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("cutoff"),
    )
    query_parts = (
        entries.join(asks, entries["vid"] == asks["qid"], "left_semi")
        .select("vid", "width", cut_up)
        .select("vid", "width", "p.list", "p.part", block("vid", query_blocks).alias("qb"))
    )
    to_all = query_parts.withColumn("db", every(data_blocks)).withColumn("is_query", F.lit(True))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lists * data_blocks * query_blocks // 4)
    score = "qid long, vid long, score long"

    # Phase 1: local lists, and from them a cutoff per query. With lists of no components there is nothing to score.
    gathered = (
        data.unionByName(to_all.withColumn("cutoff", F.lit(0).cast("long")))
        .repartition(tasks, *side).groupBy(*side).applyInPandas(_scores(k + 1, False), score)
    )
    vectors_of = entries.select("vid", "v")

    def whole(pairs: DataFrame) -> DataFrame:
        """Whole scores of (qid, vid) pairs."""
        q = vectors_of.select(F.col("vid").alias("qid"), F.col("v").alias("qv"))
        product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
        return pairs.join(vectors_of, "vid").join(q, "qid").select("qid", "vid", product.alias("score"))

    sizes = members.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    copies = entries.join(sizes, "v").select("vid", "copies")
    candidates = saved(whole(gathered.select("qid", "vid").distinct()).join(copies, "vid"), "topk-candidates")
    # The candidates' copies count: the cutoff is the score at which k+1 rows are reached, or, if there are fewer, any score.
    down = W.partitionBy("qid").orderBy(F.desc("score"), "vid")
    reached = candidates.withColumn("so_far", F.sum("copies").over(down)).filter(F.col("so_far") >= k + 1)
    cutoff = asks.join(reached.groupBy("qid").agg(F.max("score").alias("cutoff")), "qid", "left").select(
        "qid", F.coalesce(F.expr(f"cutoff div {lists}"), F.lit(-(2**62))).alias("cutoff")
    )
    # Phase 2: everything that reaches its share of the cutoff in one list.
    enough = (
        data.unionByName(to_all.join(cutoff, to_all["vid"] == cutoff["qid"]).drop("qid"))
        .repartition(tasks, *side).groupBy(*side).applyInPandas(_scores(None, True), score)
    )
    # Phase 3: the scores of the remaining components, from the vectors; then the rows behind each entry.
    resolved = whole(enough.select("qid", "vid").distinct())
    near = resolved.withColumn("r", F.row_number().over(down)).filter(F.col("r") <= k + 1)
    ids = members.join(entries.select("v", "vid"), "v").select("vid", F.col("id").alias("vec_id"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = near.join(ids, "vid").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("qid", "vec_id", "score")
    ranked = asked.join(best, "qid").filter("vec_id <> query_id").withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
