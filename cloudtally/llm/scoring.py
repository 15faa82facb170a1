"""Language-model scoring by context-tree weighting over byte contexts, and a word-count baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.llm.shared import chunks, lower_ascii, partitions_for, saved, small_batches, split_words

#: Bytes of context. A context and the byte after it are packed into one long.
DEPTH = 5
#: Text bytes of a batch: its texts share one look-up of every different context and word they hold. It is one task's share.
BATCH_BYTES = 48 << 20
#: Stands for the end of a text, and fills the context before its start; it does not occur in UTF-8.
EDGE = 0xFF
_LOG_HALF = np.log(0.5)
_GRAM, _WORD, _TEXT = 0, 1, 2


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(packed contexts with their next bytes, how many each text has): one per byte, and one for the end."""
    spelled = [t.encode() for t in texts.to_pylist()]
    edge = bytes([EDGE])
    points = np.frombuffer(edge * DEPTH + (edge * DEPTH).join(spelled) + edge * DEPTH, np.uint8).astype(np.uint64)
    packed = points[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        packed |= points[DEPTH - k : len(points) - k] << np.uint64(8 * k)
    counts = np.array([len(s) + 1 for s in spelled], np.int64)
    # Behind each end come DEPTH - 1 positions that only fill the next text's context.
    starts = np.concatenate([[0], np.cumsum(counts + DEPTH - 1)])[:-1]
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
    return packed[at].view(np.int64), counts


def word_keys(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after eight steps up; x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - np.log(np.pi) - _log_gamma(n0 + n1 + 1)


def _weighted(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of a node, and the share of it that is the node's own estimate."""
    both = np.logaddexp(_LOG_HALF + kt, _LOG_HALF + children)
    return both, np.exp(_LOG_HALF + kt - both)


def lower_tree(keys: np.ndarray, n: np.ndarray, top: int = 2):
    """Contexts of ``top`` to DEPTH bytes, one bit of the next byte after another.

    For each of the 8 bits yields the nodes of ``top`` bytes (key, zeros, ones,
    weighted log probability), and for every gram the predicted probability of
    its bit at depth ``top`` and the count of its node there. A node's key is
    its context and the bits already known behind a leading one.
    """
    symbol, context = keys & 255, keys >> 8
    for k in range(8):
        bit = (symbol >> (7 - k)) & 1
        node = (1 << k) | (symbol >> (8 - k))
        p = count = below = below_keys = None
        for d in range(DEPTH, top - 1, -1):
            names, place = np.unique(((context & ((1 << 8 * d) - 1)) << 8) | node, return_inverse=True)
            n1 = np.bincount(place, n * bit)
            n0 = np.bincount(place, n) - n1
            kt = log_kt(n0, n1)
            total = n0 + n1
            own = (np.where(bit == 1, n1[place], n0[place]) + 0.5) / (total[place] + 1)
            if below is None:
                weighted, p = kt, own
            else:
                parent = ((below_keys >> 8) & ((1 << 8 * d) - 1)) << 8 | (below_keys & 255)
                weighted, share = _weighted(kt, np.bincount(np.searchsorted(names, parent), below, minlength=len(names)))
                # Below a context never seen there is nothing to mix with.
                p = np.where(count > 0, share[place] * own + (1 - share[place]) * p, own)
            count, below, below_keys = total[place], weighted, names
        yield k, (below_keys, n0, n1, below), p, count


def _read_all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _top_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and weighted log probabilities of two-byte nodes, added up over their second byte."""
    table = _read_all(batches)
    if table is None:
        return
    keys, n = table["key"].to_numpy(), table["n"].to_numpy().astype(np.float64)
    for _, (names, n0, n1, weighted), _, _ in lower_tree(keys, n):
        parent = names & 0xFFFF  # last context byte, and the bits known
        nodes, place = np.unique(parent, return_inverse=True)
        sums = [np.bincount(place, x) for x in (n0, n1, weighted)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), *map(pa.array, sums)], names=["node", "n0", "n1", "below"])


def upper_tree(rows: list[tuple[int, float, float, float]]) -> dict[str, np.ndarray]:
    """Shares and predictions of the one-byte nodes and the root, by (byte, bits known); 256 x 256 numbers each."""
    n0, n1, below = np.zeros((3, 256, 256))
    for node, a, b, w in rows:
        n0[node >> 8, node & 255], n1[node >> 8, node & 255], below[node >> 8, node & 255] = a, b, w
    kt = log_kt(n0, n1)
    weighted, share = _weighted(kt, below)
    r0, r1 = n0.sum(axis=0), n1.sum(axis=0)
    _, root = _weighted(log_kt(r0, r1), weighted.sum(axis=0))
    return {"n0": n0, "n1": n1, "share": share, "r0": r0, "r1": r1, "root": root}


def _gram_values(top: dict[str, np.ndarray]):
    """log10 probability of each gram's byte in its context; one row per batch that holds the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read_all(batches)
        if table is None:
            return
        keys, n = table["key"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        value = np.zeros(len(keys))
        symbol, last = keys & 255, (keys >> 8) & 255
        for k, _, p, count in lower_tree(keys, n):
            bit, node = (symbol >> (7 - k)) & 1, (1 << k) | (symbol >> (8 - k))
            a, b = top["n0"][last, node], top["n1"][last, node]
            own, share = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1), top["share"][last, node]
            p = np.where(count > 0, share * own + (1 - share) * p, own)
            r0, r1, root = top["r0"][node], top["r1"][node], top["root"][node]
            own = (np.where(bit == 1, r1, r0) + 0.5) / (r0 + r1 + 1)
            value += np.log10(np.where(a + b > 0, root * own + (1 - root) * p, own))
        lists = table["batches"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        counts = np.diff(lists.offsets.to_numpy())
        inside = lists.flatten()
        for first in range(0, len(keys), 50_000):  # bounded Arrow batches
            some = slice(first, first + 50_000)
            start = int(counts[: some.start].sum())
            stop = start + int(counts[some].sum())
            yield pa.RecordBatch.from_arrays(
                [inside.slice(start, stop - start), pa.array(np.repeat(keys[some], counts[some])),
                 pa.array(np.repeat(value[some].astype(np.float32), counts[some])), pa.array(np.ones(stop - start, bool))],
                names=["batch", "key", "value", "known"],
            )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different grams and words of each batch, with their training counts; rows come sorted by batch."""
    now, held = None, {_GRAM: [], _WORD: []}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([c for _, c in parts]))

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if not parts:
                continue
            keys, n = merged(parts)
            n = n.astype(np.int64)
            for first in range(0, len(keys), 50_000):
                some = slice(first, first + 50_000)
                size = len(keys[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, now, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(keys[some]), pa.array(n[some])],
                    names=["batch", "kind", "key", "n"],
                )
            parts.clear()

    def add(kind: int, codes: np.ndarray, keys: np.ndarray, learn: np.ndarray, counts: np.ndarray) -> None:
        held[kind].append((keys, np.bincount(codes, np.repeat(learn, counts), minlength=len(keys))))
        if len(held[kind]) == 16:  # one sorted part from sixteen
            held[kind] = [merged(held[kind])]

    for whole in batches:
        ids = whole.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), whole.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s and ids[s] != now:
                yield from flush()
                now = ids[s]
            for batch in chunks(iter([whole.slice(s, e - s)])):
                low = lower_ascii(batch.column("text"))
                learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.float64)
                packed, counts = grams(low)
                coded = pa.array(packed).dictionary_encode()
                add(_GRAM, coded.indices.to_numpy(), coded.dictionary.to_numpy(), learn, counts)
                codes, counts, words = split_words(low)
                if words:
                    add(_WORD, codes, word_keys(words), learn, counts)
    yield from flush()


SCORED = "doc_id long, learn boolean, bytes long, n_tokens long, n_known long, base double, score double"


def _score(end_base: float, end_known: bool):
    """Texts against the values of their batch, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tables = None, {_GRAM: [], _WORD: []}, {}

        def look_up(kind: int, keys: np.ndarray) -> np.ndarray:
            names, *_ = tables[kind]
            return np.searchsorted(names, keys)

        def tabled(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = held.pop(kind)
            if not parts:
                return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
            keys, values, known = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            return keys[order], values[order], known[order]

        for whole in batches:
            ids, parts = whole.column("batch").to_numpy(), whole.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids) | np.diff(parts)) + 1).tolist(), whole.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if ids[s] != now:
                    now, held, tables = ids[s], {_GRAM: [], _WORD: []}, {}
                piece = whole.slice(s, e - s)
                if parts[s] != _TEXT:
                    held[int(parts[s])].append(
                        tuple(piece.column(c).to_numpy(zero_copy_only=False) for c in ("key", "value", "known"))
                    )
                    continue
                if not tables:
                    tables = {_GRAM: tabled(_GRAM), _WORD: tabled(_WORD)}
                for batch in chunks(iter([piece])):
                    low = lower_ascii(batch.column("text"))
                    packed, counts = grams(low)
                    coded = pa.array(packed).dictionary_encode()
                    each = tables[_GRAM][1][look_up(_GRAM, coded.dictionary.to_numpy())].astype(np.float64)
                    n_bytes = counts
                    score = np.add.reduceat(each[coded.indices.to_numpy()], np.cumsum(n_bytes) - n_bytes)
                    codes, counts, words = split_words(low)
                    base = np.full(len(counts), end_base)
                    known = np.full(len(counts), int(end_known))
                    if words:
                        at = look_up(_WORD, word_keys(words))
                        text = np.repeat(np.arange(len(counts)), counts)
                        base += np.bincount(text, tables[_WORD][1][at][codes], minlength=len(counts))
                        known += np.bincount(text, tables[_WORD][2][at][codes], minlength=len(counts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id"), batch.column("learn"), pa.array(n_bytes), pa.array(counts + 1), pa.array(known),
                            pa.array(base), pa.array(score),
                        ],
                        names=["doc_id", "learn", "bytes", "n_tokens", "n_known", "base", "score"],
                    )

    return run


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's log10 probability under a model of the rows that ``learn`` selects.

    Columns: doc_id, learn, bytes, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte. The model is a context-tree weighting over contexts
    of up to ``DEPTH`` bytes: the next byte is told bit by bit, each bit has a
    Krichevsky-Trofimov estimate in the contexts of every length, and a context
    weighs its own estimate against those of its longer contexts by how well
    either explains the training texts. Texts are taken with A-Z in lower case
    and end in a byte of their own, which is scored too (``bytes`` counts it),
    so probabilities over all texts add up to one. Where a longer context was
    never seen, the longest one seen decides.

    ``base_score`` is the add-one word count model: words between ASCII white
    space, and one end. Word counts are kept by 64-bit hash.

    Null texts count as empty. ``learn`` null counts as false. Repeated rows
    are scored, and counted, each time. Without training rows the estimates are
    even. An empty table gives no rows; further columns are ignored.

    Nothing is broadcast but the one-byte contexts (256 x 256 numbers). Texts are
    dealt into batches of a fixed size by hash; each batch names the grams and
    words it holds, gets their values, and is read again beside them.
    """
    rows = small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learn").cast("long")).alias("learned")).first()
    n_batches, learned = max(1, -(-(size["bytes"] or 0) // BATCH_BYTES)), size["learned"] or 0
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int"))

    # A batch is a partition, by its number, so no task has two of them.
    counted = (
        rows.select("batch", "text", "learn").repartitionById(n_batches, "batch").sortWithinPartitions("batch")
        .mapInArrow(_count, "batch int, kind int, key long, n long")
    )
    keyed = saved(
        counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("batch").alias("batches")), "scoring-keys"
    )
    words = keyed.filter(F.col("kind") == _WORD)
    seen = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    train_tokens = (seen["n"] or 0) + learned
    room = train_tokens + (seen["v"] or 0) + (learned > 0) + 1

    contexts = keyed.filter(F.col("kind") == _GRAM).withColumn("last_two", F.shiftright("key", 8).bitwiseAND(0xFFFF))
    spread = partitions_for(keyed, contexts.count(), 400_000)
    dealt = lambda *columns: contexts.select("last_two", *columns).repartition(spread, "last_two").select(*columns)
    sums = dealt("key", "n").mapInArrow(_top_sums, "node long, n0 double, n1 double, below double")
    top = upper_tree([tuple(r) for r in sums.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()])

    gram_values = dealt("key", "n", "batches").mapInArrow(_gram_values(top), "batch int, key long, value float, known boolean")
    word_values = words.select(
        F.explode("batches").alias("batch"), "key", F.log10((F.col("n") + 1) / F.lit(float(room))).alias("value"), (F.col("n") > 0).alias("known")
    )
    none = lambda kind: F.lit(None).cast(kind)
    value_row = lambda df, part: df.select(
        "batch", F.lit(part).alias("part"), "key", F.col("value").cast("double").alias("value"), "known",
        none("long").alias("doc_id"), none("string").alias("text"), none("boolean").alias("learn"),
    )
    text_rows = rows.select(
        "batch", F.lit(_TEXT).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), F.lit(False).alias("known"), "doc_id", "text", "learn"
    )
    beside = value_row(gram_values, _GRAM).unionByName(value_row(word_values, _WORD)).unionByName(text_rows)
    scored = (
        beside.repartitionById(n_batches, "batch").sortWithinPartitions("batch", "part")
        .mapInArrow(_score(float(np.log10((learned + 1) / room)), learned > 0), SCORED)
    )
    return scored.select(
        "doc_id", "learn", "bytes", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", (F.col("score") * -float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
