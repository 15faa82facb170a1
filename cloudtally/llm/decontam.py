"""Benchmark decontamination: latent semantic retrieval of passages, then common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm.shared import chunks, give_back, partitions_for, saved, small_batches

#: Words per segment; a passage is PASSAGE segments, and one starts at every segment.
SEGMENT = 16
PASSAGE = 2
#: Benchmark items, and words of them, handled together: their vocabulary, no larger than that, and its vectors are what every task holds.
ITEM_BLOCK, WORD_BLOCK = 20_000, 100_000
#: Numbers gathered together when sparse TF-IDF rows are multiplied, so that they stay in a processor's cache; one row at least.
GATHERED = 1 << 19
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.?!\n]+")


@dataclass(frozen=True)
class Settings:
    #: Dimensions of the latent space, at most; beyond the number of items, plus a few, they would hold no item.
    rank: int = 128
    spare: int = 8
    oversample: int = 16
    #: The latent space is fitted on all passages; a caller who sets this has it fitted on about so many, chosen by hash.
    fit_passages: int | None = None
    min_cosine: float = 0.5
    #: An item is found if so much of it is a common subsequence with the text around the passage ...
    min_common: float = 0.6
    #: ... and so much of its answer is, or if its common share reaches ``sure_common``.
    min_answer: float = 0.5
    sure_common: float = 0.8


@dataclass(frozen=True)
class Items:
    ids: list
    codes: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[str, int]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def prepare(rows: list[tuple]) -> Items:
    """Benchmark (id, text, answer) rows as word codes. Without an answer, the last sentence is the answer."""
    vocabulary: dict[str, int] = {}
    ids, codes, answers = [], [], []
    for item, text, answer in rows:
        words = words_of(text)
        if not words:
            continue
        sentences = [s for s in map(words_of, _SENTENCE.split(text)) if s]
        spelled = words_of(answer) or sentences[-1]
        for w in [*words, *spelled]:
            vocabulary.setdefault(w, len(vocabulary))
        ids.append(item)
        codes.append(np.array([vocabulary[w] for w in words], np.int32))
        answers.append(np.array([vocabulary[w] for w in spelled], np.int32))
    return Items(ids, codes, answers, vocabulary)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by one machine-word-parallel row update per element of ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := places.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _encode(vocabulary: dict[str, int]):
    """Each text as the codes of its words, -1 for a word that no item has."""
    get = vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            coded, lengths = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                coded.extend(map(get, words, repeat(-1)))
                lengths.append(len(words))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(coded, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), codes], names=["doc_id", "text_hash", "codes"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch], words: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches of about so many words, one document at least."""
    for batch in batches:
        bounds = batch.column("codes").offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + words, side="right")) - 1)
            yield batch.slice(first, stop - first)
            first = stop
    give_back()


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their segment numbers, and per document the first code, the first segment and the segment count."""
    lists = batch.column("codes")
    bounds = lists.offsets.to_numpy()
    codes = lists.values.to_numpy()[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    lengths = np.diff(bounds)
    counts = -(-lengths // SEGMENT)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    inside = np.arange(len(codes)) - np.repeat(bounds[:-1], lengths)
    return codes, np.repeat(first, lengths) + inside // SEGMENT, bounds, first, counts


def _frequency(size: int):
    """Segments in which each code occurs, and the number of segments at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, segments = np.zeros(size, np.int64), 0
        for batch in _pieces(batches):
            codes, segment, _, _, counts = _segments(batch)
            segments += int(counts.sum())
            known = codes >= 0
            pairs = np.unique(segment[known] * size + codes[known])
            total += np.bincount(pairs % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1)), pa.array(np.append(total, segments))], names=["code", "n"])

    return run


def _passages(batch: pa.RecordBatch, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Known codes and the passages they are in, in order: all passages that do not overlap, or below a rate of 1 a share of them, by text and place."""
    codes, segment, _, first, counts = _segments(batch)
    place = np.arange(int(counts.sum())) - np.repeat(first, counts)
    lead = np.arange(len(place)) - place % PASSAGE  # a passage is named by its first segment
    keep = codes >= 0
    if rate < 1:
        hashes = batch.column("text_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        mixed = (np.repeat(hashes, counts) ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        chosen = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 < rate
        keep &= chosen[lead[segment]]
    return codes[keep], lead[segment[keep]]


def _add_products(total: np.ndarray, codes: np.ndarray, own: np.ndarray, idf: np.ndarray, thin: np.ndarray, entries: int = 1 << 17) -> None:
    """Adds A'A times ``thin`` to ``total``; A has a unit row of TF-IDF weights for each run of ``own``, which ascends.

    Only the entries that are not zero are visited, a bounded number at a time.
    """
    row = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row)) if len(row) else row
    some = max(1, GATHERED // thin.shape[1])
    begin = 0
    while begin < len(row):
        stop = int(ends[max(int(np.searchsorted(ends, begin + entries, side="right")) - 1, row[begin])])
        pairs, times = np.unique((row[begin:stop] - row[begin]) * len(idf) + codes[begin:stop], return_counts=True)
        begin = stop
        mine, code = pairs // len(idf), pairs % len(idf)
        weight = times * idf[code]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        norm = np.sqrt(np.add.reduceat(weight * weight, starts))
        weight = (weight / np.where(norm > 0, norm, 1)[mine]).astype(np.float32)
        # A times thin: entries lie by row. A row that the pieces cut is added up from its parts.
        rows = np.zeros((len(starts), thin.shape[1]), np.float32)
        for at in range(0, len(mine), some):
            part = mine[at : at + some]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            products = thin.take(code[at : at + some], axis=0)
            products *= weight[at : at + some, None]
            rows[part[first]] += np.add.reduceat(products, first, axis=0)
        # A' times that: entries lie by code.
        order = np.argsort(code, kind="stable")
        for at in range(0, len(mine), some):
            piece = order[at : at + some]
            part = code[piece]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            products = rows.take(mine[piece], axis=0)
            products *= weight[piece, None]
            total[part[first]] += np.add.reduceat(products, first, axis=0)


def _multiply(idf: np.ndarray, basis: np.ndarray, rate: float):
    """A'A times ``basis`` over this task's passages, one row per code that is in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, thin = basis.shape[1], basis.astype(np.float32)
        total = np.zeros((len(idf), width))
        seen = np.zeros(len(idf), bool)
        for batch in _pieces(batches):
            codes, own = _passages(batch, rate)
            seen[codes] = True
            _add_products(total, codes, own, idf, thin)
        held = np.flatnonzero(seen)
        for at in range(0, len(held), 4096):
            code = held[at : at + 4096]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * width), pa.array(total[code].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(code), rows], names=["code", "row"])
        give_back()

    return run


def _gather(coded: DataFrame, run, size: int, width: int) -> np.ndarray:
    """Per-task matrices added up by code; the sum has vocabulary x rank numbers, whatever the corpus."""
    parts = coded.mapInArrow(run, "code long, row array<double>")
    added = parts.groupBy("code").agg(F.array(*[F.sum(F.element_at("row", j + 1)) for j in range(width)]).alias("row")).toArrow()
    out = np.zeros((size, width))
    out[added["code"].to_numpy()] = added["row"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def latent_space(coded: DataFrame, items: Items, idf: np.ndarray, passages: int, s: Settings) -> np.ndarray:
    """Code vectors (vocabulary x rank), weighted by idf and evened out by the root of the singular values, by randomised SVD of the passages.

    A has a row for every passage of the corpus, those that do not overlap. One
    read of all of them gives the product of A'A with a random orthonormal basis,
    and that product both the range and, by Nystrom's formula, the eigenvalues
    inside it. The benchmark's own passages are rows of A as well, so that its
    terms are spanned.
    """
    size = len(idf)
    rank = min(s.rank, len(items.ids) + s.spare)
    width = min(size, rank + s.oversample)
    fitted = passages if s.fit_passages is None else min(passages, s.fit_passages)
    rate = fitted / max(1, passages)
    # A task gives a row of each code it meets, so it takes passages enough to keep that below its input.
    few = coded.coalesce(partitions_for(coded, passages, 8 * size))
    own, codes = np.repeat(np.arange(len(items.codes)), [*map(len, items.codes)]), np.concatenate(items.codes)
    # As many rows again as were fitted of the corpus, so that neither side decides alone.
    weight = max(1.0, fitted / max(1, len(items.codes)))

    def gram(basis: np.ndarray) -> np.ndarray:
        of_items = np.zeros((size, basis.shape[1]))
        _add_products(of_items, codes, own, idf, basis.astype(np.float32))
        return _gather(few, _multiply(idf, basis, rate), size, basis.shape[1]) + weight * of_items

    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(size, width)))[0]
    product = gram(basis)
    # A small shift, taken off again, keeps the core's least eigenvalues above the products' rounding.
    shift = np.sqrt(size) * np.finfo(np.float32).eps * np.linalg.norm(product, 2)
    product += shift * basis
    core = basis.T @ product
    inner, turned = np.linalg.eigh((core + core.T) / 2)
    held = inner > max(1e-9 * inner.max(initial=0), 1e-12)
    vectors, roots, _ = np.linalg.svd(product @ (turned[:, held] / np.sqrt(inner[held])), full_matrices=False)
    values = np.maximum(roots**2 - shift, 0)[:rank]
    keep = np.flatnonzero(values > max(1e-9 * values.max(initial=0), 1e-12))
    return (idf[:, None] * (vectors[:, keep] / values[keep] ** 0.25)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _segment_vectors(codes: np.ndarray, segment: np.ndarray, n: int, space: np.ndarray, some: int = 1024) -> np.ndarray:
    """Sums of the known codes' vectors, per segment; ``segment`` ascends and has at most SEGMENT codes of each.

    Segments go by how many known codes they have, the most first, so that whole
    rows are added: the second codes of all segments that have two, then the
    third ones. What follows the first code is added up before it joins, eight
    or more as a tree of eight and the rest; that is how ``np.add.reduceat``
    rounds, which takes far longer on such short runs.
    """
    known = codes >= 0
    codes, lengths = codes[known], np.bincount(segment[known], minlength=n)
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    total = np.zeros((n, space.shape[1]), np.float32)
    for at in range(0, n, some):
        rows, begin = order[at : at + some], begins[at : at + some]
        more = np.searchsorted(-lengths[rows], -np.arange(SEGMENT + 2), side="right")  # segments with so many codes at least

        def nth(k: int, first: int = 0) -> np.ndarray:
            return space.take(codes[begin[first : more[k + 1]] + k], axis=0)

        rest = np.zeros((int(more[1]), space.shape[1]), np.float32)
        long = int(more[9])
        a, b, c, d, e, f, g, h = (space.take(codes[begin[:long] + k], axis=0) for k in range(1, 9))
        rest[:long] = ((a + b) + (c + d)) + ((e + f) + (g + h))
        for k in range(1, SEGMENT):
            short = long if k < 9 else 0
            rest[short : int(more[k + 1])] += nth(k, short)
        total[rows[: int(more[1])]] = nth(0) + rest
    return total


def _search(items: Items, space: np.ndarray, s: Settings):
    """Passages near an item in the latent space, checked word by word."""
    # An item of more than two passages is looked for by parts of it.
    size = SEGMENT * PASSAGE
    parts = [
        (i, c[at : at + size] if len(c) > 2 * size else c)
        for i, c in enumerate(items.codes)
        for at in (range(0, len(c) - size // 2, size // 2) if len(c) > 2 * size else [0])
    ]
    item_of = np.array([i for i, _ in parts])
    targets = _unit(np.array([space[c].sum(axis=0) for _, c in parts])).astype(np.float32)
    wanted = [c.tolist() for c in items.codes]
    answers = [a.tolist() for a in items.answers]
    terms = [set(c) | set(a) for c, a in zip(wanted, answers)]
    space = np.ascontiguousarray(space)  # else each gathering of rows would turn the whole matrix first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            codes, segment, bounds, first, counts = _segments(batch)
            found: dict[tuple[int, int], tuple[float, int, float]] = {}
            if len(codes):
                total = _segment_vectors(codes, segment, int(counts.sum()), space)
                doc = np.repeat(np.arange(len(counts)), counts)
                window = total.copy()
                for k in range(1, PASSAGE):
                    same = doc[k:] == doc[:-k]
                    window[:-k][same] += total[k:][same]
                window = _unit(window)
                for at in range(0, len(window), 4096):
                    near, target = np.nonzero(window[at : at + 4096] @ targets.T >= s.min_cosine)
                    for w, part in zip((near + at).tolist(), target.tolist()):
                        i = int(item_of[part])
                        d = int(doc[w])
                        key = (d, i)
                        if key in found and found[key][1] == len(wanted[i]):
                            continue
                        n = len(wanted[i])
                        begin = bounds[d] + (w - first[d]) * SEGMENT
                        around = codes[max(bounds[d], begin - n) : min(bounds[d + 1], begin + PASSAGE * SEGMENT + n)]
                        text = [c for c in around.tolist() if c in terms[i]]
                        if len(text) < s.min_common * n:
                            continue
                        common = common_length(wanted[i], text)
                        if common < s.min_common * n:
                            continue
                        answer = common_length(answers[i], text) / len(answers[i])
                        if answer < s.min_answer and common < s.sure_common * n:
                            continue
                        cosine = float(window[w] @ targets[part])
                        if key not in found or (common, answer, cosine) > (found[key][1], found[key][2], found[key][0]):
                            found[key] = (cosine, common, answer)
            keys = sorted(found)
            at_doc = pa.array([d for d, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at_doc),
                    batch.column("text_hash").take(at_doc),
                    pa.array([items.ids[i] for _, i in keys], pa.int64()),
                    pa.array([len(wanted[i]) for _, i in keys], pa.int32()),
                    pa.array([found[k][1] for k in keys], pa.int32()),
                    pa.array([found[k][2] for k in keys], pa.float64()),
                    pa.array([found[k][0] for k in keys], pa.float64()),
                ],
                names=["doc_id", "text_hash", "item_id", "item_words", "common_words", "answer_share", "cosine"],
            )

    return run


FOUND = "doc_id long, text_hash long, item_id long, item_words int, common_words int, answer_share double, cosine double"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, common_words, answer_share, cosine): benchmark items found in documents.

    Every passage of every document (32 words, one starting each 16) is placed
    in a latent space and compared with every item; near ones are checked
    against the words around them, by the longest common subsequence with the
    item and with its answer (its last sentence, where the benchmark has no
    answer column). Words are runs of word characters, lower case.

    Idf counts cover all segments of all documents, and the space is fitted on
    all passages and all items, unless ``fit_passages`` says on how many. One
    row per document and item, of the best passage; repeated rows of a document
    give repeated rows. Null and empty texts contain nothing, items without words
    or id are left out, and an empty table or benchmark gives no rows.
    ``text_hash`` (xxhash64 of the text) tells documents without id apart.
    A benchmark beyond ``ITEM_BLOCK`` items or ``WORD_BLOCK`` words is searched
    block by block. Very long texts are searched whole; further columns are
    ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text")
    )
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer"))
    asked = asked.filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    asked_for = asked.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size(F.split("text", r"\W+"))).alias("words")).first()
    blocks = max(1, -(-asked_for["items"] // ITEM_BLOCK), -(-(asked_for["words"] or 0) // WORD_BLOCK))
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "text", "answer").collect()
        one = _one_block(rows, prepare([tuple(r) for r in part]), settings)
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows in which :func:`contaminated` finds an item; all columns pass through."""
    found = saved(contaminated(docs, benchmark, settings, id_col, text_col, **how).select("doc_id", "text_hash").distinct(), "decontam-found")
    # Rows travel as one value, so that no column of theirs can be taken for one of these.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return whole.join(found, same, "left_anti").select("row.*")


def _one_block(rows: DataFrame, items: Items, s: Settings) -> DataFrame:
    size = len(items.vocabulary)
    if not size:
        return rows.sparkSession.createDataFrame([], FOUND)
    coded = saved(small_batches(rows).mapInArrow(_encode(items.vocabulary), "doc_id long, text_hash long, codes array<int>"), "decontam-codes")
    counted = {r["code"]: r["n"] for r in coded.mapInArrow(_frequency(size), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    segments = counted.pop(-1, 0)
    idf = np.array([np.log(1 + segments / (1 + counted.get(c, 0))) for c in range(size)])
    space = latent_space(coded, items, idf, -(-segments // PASSAGE), s)
    return coded.mapInArrow(_search(items, space, s), FOUND)
