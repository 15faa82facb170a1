"""Ranked lexical search: impact lists, read by the best position algorithm, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.llm.shared import chunks, give_back, saved, small_batches, split_words

#: Query terms of the items that are searched together; more items take more passes over the documents.
BLOCK_TERMS = 200_000
#: Postings a task ranks at a time: it holds that many, or one document's, however many it is given.
SHARD_POSTINGS = 1_500_000
#: Positions read from each list in the first round; every further round reads twice as many.
FIRST_READ = 32

#: What each byte of a text becomes: A-Z lower-cased, every other ASCII byte that is no digit or letter a blank.
_FOLD = np.array(
    [b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8
)


def folded(texts: pa.Array) -> pa.Array:
    """Texts with their terms lower-cased (A-Z only) and blanks for all that separates them; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[0] == at[-1]:
        return texts
    new = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(new))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            codes, counts, names = split_words(folded(batch.column("text")))
            pairs = np.unique(np.stack([np.repeat(np.arange(len(counts)), counts), codes], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(pairs[:, 0])), pa.array(names, pa.string()).take(pa.array(pairs[:, 1]))],
                names=["item_id", "term"],
            )

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["item_id"]
    return small_batches(rows).mapInArrow(run, f"item_id {kind}, term string").distinct()


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: all its terms counted, and those of ``vocabulary`` listed by position in it."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known.value, pa.string())
        for batch in chunks(batches):
            codes, counts, names = split_words(folded(batch.column("text")))
            of_name = pc.fill_null(pc.index_in(pa.array(names, pa.string()), value_set=wanted), -1).to_numpy().astype(np.int64)
            row, code = np.repeat(np.arange(len(counts)), counts), of_name[codes] if len(codes) else codes
            key, tf = np.unique(row[code >= 0] * len(wanted) + code[code >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(counts) + 1) * len(wanted)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(len(wanted), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Impact lists over some documents: per term by impact for sorted reads, and by document for direct ones."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> None:
        by_doc = np.lexsort((doc, term))
        self.doc, self.impact = doc[by_doc], impact[by_doc]
        term = term[by_doc]
        self.ends = np.searchsorted(term, np.arange(terms + 1))
        self.sorted = np.lexsort((self.doc, -self.impact, term))  # places in the arrays above, best first within a term
        self.position = np.empty(len(doc), np.int64)
        self.position[self.sorted] = np.arange(len(doc)) - self.ends[term]  # of each entry, in its list

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the ``k`` highest sums over the lists of ``terms``, equal ones by their number, and the sums.

        Each round reads on in every list; a document that turns up is looked
        up directly in all of them, which marks its positions there as seen. A
        list's best position is the last before its first unseen one, so an
        unseen document has at most the impact there. Reading stops when the
        sum of those is strictly below the k-th sum: then no unseen document
        can even tie with it.
        """
        lists = [(a, b) for a, b in zip(self.ends[terms].tolist(), self.ends[terms + 1].tolist()) if b > a]
        seen = [np.zeros(b - a, bool) for a, b in lists]
        best = [0] * len(lists)
        docs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, read = 0, FIRST_READ
        while True:
            met = [self.doc[self.sorted[a + at : min(b, a + at + read)]] for a, b in lists]
            new = np.setdiff1d(np.concatenate(met) if met else docs, docs)
            found, limit = np.zeros(len(new), np.int64), 0
            for i, (a, b) in enumerate(lists):
                place = a + np.searchsorted(self.doc[a:b], new)
                place[place == b] = a
                has = self.doc[place] == new
                found[has] += self.impact[place[has]]
                seen[i][self.position[place[has]]] = True
                rest = seen[i][best[i] :]
                step = int(rest.argmin()) if len(rest) else 0
                best[i] += step if len(rest) and not rest[step] else len(rest)
                if best[i] < b - a:
                    limit += int(self.impact[self.sorted[a + best[i] - 1]])
            docs, sums = np.concatenate([docs, new]), np.concatenate([sums, found])
            kth = int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0
            if limit == 0 or limit < kth:
                first = np.lexsort((docs, -sums))[:k]
                return docs[first], sums[first]
            at, read = at + read, 2 * read


def _ranked(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, doc_id, score) of each shard's best documents; ``asked`` holds one block of (item_id, term)."""
    spark = docs.sparkSession
    vocabulary = sorted(r["term"] for r in asked.select("term").distinct().collect())
    code = {t: i for i, t in enumerate(vocabulary)}
    grouped = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    ids = [r["item_id"] for r in grouped]
    wanted = [np.array(sorted(code[t] for t in r["terms"]), np.int64) for r in grouped]
    counted = saved(postings(docs, id_col, text_col, vocabulary), "postings")
    n, words = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in holding.select("term", F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).alias("w")).collect():
        weight[r["term"]] = r["w"]
    known = spark.sparkContext.broadcast((weight, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = known.value

        def rank(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            # Documents are numbered by id, so that ties go by number.
            rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()
            terms, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
            row = np.repeat(np.arange(len(rows)), terms.value_lengths().to_numpy())
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            length = 100 - 90 + (90 * rows["n"].to_numpy() * n) // max(words, 1)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[row]))
            shard = Shard(term[impact > 0], row[impact > 0], impact[impact > 0], len(weight))
            out = [shard.best(terms, k) for terms in wanted]
            item = np.repeat(np.arange(len(out), dtype=np.int32), [len(d) for d, _ in out])
            found, sums = (np.concatenate([x[i] for x in out]) for i in (0, 1))
            ids = rows["doc_id"].combine_chunks().take(pa.array(found))
            return pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(sums)], names=["item", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield rank(held)
                held, size = [], 0
        if held:
            yield rank(held)
        give_back()

    found = counted.filter("size(terms) > 0").mapInArrow(run, "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {dict(asked.dtypes)['item_id']}")
    return found.join(names, "item").select("item_id", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every item, scores above zero.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all
    non-ASCII characters, taken from whole texts. Weights and lengths are those
    of all documents with a term. Each shard of documents is ranked by
    :meth:`Shard.best`; of its rows the best stay, so no list is ever held
    whole. Items come in blocks of about ``BLOCK_TERMS`` terms, which bounds
    what is broadcast.

    Null and empty texts have no term: such a document is never found, such an
    item has no row, and neither has one whose terms no document holds. Rows
    of one item id are one item with the terms of all of them. Repeated
    documents are ranked each; equal scores go by document id, nulls last. An
    empty table gives no rows; further columns are ignored.
    """
    terms = saved(item_terms(items, item_col, item_text), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for b in range(blocks):
        part = _ranked(docs, terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
