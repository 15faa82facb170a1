"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside shared bands, groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm.shared import chunks, components, give_back, partitions_for, saved, small_batches

BITS = 64
#: Fingerprints of a band that are compared in one piece; a larger band is cut into several.
BLOCK = 2048
#: Bands grow more selective until a band holds about this many fingerprints on average: a longer key takes three
#: times the copies of every fingerprint, which cost as much as comparing it with some thousands.
BAND_ROWS = 4096
#: Blocks of a fingerprint and 64 others that are compared together; only bounds memory.
TOGETHER = 1 << 13
#: Bytes of words in which runs are hashed together, and the longest run for which that pays; the first bounds memory.
STRETCH, LONG_RUN = 1 << 18, 255


# Of each byte: a small letter for a capital one, and a space for any ASCII white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[9:14] = 32
_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << _U(n) | x >> _U(64 - n)


def _round(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(total + word * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every data[start : start + size], by array operations; best for many short runs that lie close together."""
    with np.errstate(over="ignore"):
        # The eight bytes from each place on as a number; behind the data there are zeros.
        words = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)).astype(np.uint64)
        hashes, at, seeds = np.full(len(starts), _U(seed) + _P5), starts.copy(), _U(seed) + np.array([_P1 + _P2, _P2, 0, _U(0) - _P1], np.uint64)
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            totals, from_, stripes = [np.full(len(long), s) for s in seeds], at[long], sizes[long] // 32
            for k in range(int(stripes.max())):
                some = np.flatnonzero(stripes > k)
                for i, total in enumerate(totals):
                    total[some] = _round(total[some], words.take(from_[some] + (32 * k + 8 * i)))
            mixed = _rotated(totals[0], 1) + _rotated(totals[1], 7) + _rotated(totals[2], 12) + _rotated(totals[3], 18)
            for total in totals:
                mixed = (mixed ^ _round(_U(0), total)) * _P1 + _P4
            hashes[long] = mixed
            at[long] += 32 * stripes
        hashes += sizes.astype(np.uint64)
        for k in range(3):
            some = np.flatnonzero(sizes & 31 >= 8 * (k + 1))
            hashes[some] = _rotated(hashes[some] ^ _round(_U(0), words.take(at[some] + 8 * k)), 27) * _P1 + _P4
        at += sizes & 24
        some = np.flatnonzero(sizes & 4)
        hashes[some] = _rotated(hashes[some] ^ (words.take(at[some]) & _U(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at += sizes & 4
        for k in range(3):
            some = np.flatnonzero(sizes & 3 > k)
            hashes[some] = _rotated(hashes[some] ^ (words.take(at[some] + k) & _U(0xFF)) * _P5, 11) * _P1
        hashes = (hashes ^ hashes >> _U(33)) * _P2
        hashes = (hashes ^ hashes >> _U(29)) * _P3
        return hashes ^ hashes >> _U(32)


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every data[start : start + size], by rising start; a stretch of the data at a time, which bounds memory."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        base = int(starts[first])
        stop = int(np.searchsorted(starts, base + STRETCH, side="right"))
        short = sizes[first:stop] <= LONG_RUN
        some = first + np.flatnonzero(short)
        out[some] = xxh64(data[base : base + STRETCH + LONG_RUN], starts[some] - base, sizes[some], seed)
        for i in (first + np.flatnonzero(~short)).tolist():
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed)
        first = stop
    return out


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that are set in over half of them; an empty run gives zero.

    Eight bits of a hash are added up at a time, each in a byte of its own, in parts of 255 hashes.
    """
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    parts = -(-counts // 255)
    heads = np.cumsum(parts) - parts
    begins = np.repeat(np.cumsum(counts) - counts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(heads, parts))
    bits = np.empty((len(full), 8, 8), np.uint8)
    for b in range(8):
        sums = np.add.reduceat(hashes >> _U(b) & _U(0x0101010101010101), begins).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits[:, :, b] = 2 * np.add.reduceat(sums, heads, axis=0, dtype=np.int64) > counts[:, None]
    out[full] = np.packbits(bits.reshape(-1, BITS), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; no hash gives zero."""
    return int(majorities(hashes, np.array([len(hashes)]))[0])


def text_prints(texts: pa.Array, size: int) -> np.ndarray:
    """The fingerprint of each text: the majority of the XXH64 (seed 42) of every run of ``size`` words joined by spaces; fewer words are one run."""
    # A space behind each text ends its last word.
    large = pa.large_string()
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(large), ""), pa.scalar("", large), pa.scalar(" ", large))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    plain = _PLAIN.take(np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    space = plain == 32
    behind = np.zeros(len(plain), bool)
    behind[1:] = space[1:] & ~space[:-1]
    per_text = np.diff(np.searchsorted(np.flatnonzero(behind), offsets - offsets[0]))
    data = plain[~space | behind]  # every word and one space
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends + 1)
    runs = np.where(per_text, np.maximum(per_text - size + 1, 1), 0)
    first = np.arange(runs.sum()) + np.repeat(np.cumsum(per_text) - per_text - (np.cumsum(runs) - runs), runs)
    begins = starts.take(first)
    sizes = ends.take(first + np.repeat(np.minimum(per_text, size) - 1, runs)) - begins
    return majorities(run_hashes(data, begins, sizes, 42), runs)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the 64-bit fingerprint as a signed long, and xxhash64 of the text as it is.

    A null or empty text, and one without words, has fingerprint zero. Whole
    texts are read, repeats of a shingle count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = text_prints(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")
    )
    return small_batches(rows).mapInArrow(run, "doc_id long, text_hash long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes stored vertically: plane b, word w holds bit b of fingerprints 64w to 64w+63."""
    words = -(-len(values) // BITS)
    padded = np.zeros(words * BITS, np.uint64)
    padded[: len(values)] = values
    planes = np.empty((BITS, words), np.uint64)
    for b in range(BITS):
        bits = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(bits, bitorder="little").view(np.uint64)
    return planes


def within(
    queries: np.ndarray, values: np.ndarray, radius: int, first: np.ndarray | None = None, stop: np.ndarray | None = None, bits: Sequence[int] = range(BITS)
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query index, value index) that differ in at most ``radius`` of ``bits``, see :func:`near`."""
    first = np.zeros(len(queries), np.int64) if first is None else first
    stop = np.full(len(queries), len(values)) if stop is None else stop
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near(queries, values, radius, first, stop, bits)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def near(
    queries: np.ndarray, values: np.ndarray, radius: int, first: np.ndarray, stop: np.ndarray, bits: Sequence[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query index, value index) that differ in at most ``radius`` of ``bits``, some at a time.

    Query i meets values first[i] to stop[i] - 1. Every (query, word of 64
    values) is a block; values of a word that the query does not meet count as
    too far. A block's distances grow together: three difference planes at a
    time go through a carry-save adder into vertical counters, whose top plane
    is sticky above the radius. A block in which every distance has passed the
    radius is dropped.
    """
    planes = planes_of(values)
    words = np.where(stop > first, (stop - 1) // BITS + 1 - first // BITS, 0)
    ends = np.cumsum(words)
    at = 0
    while at < len(queries):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        q_of = np.repeat(np.arange(at, to), words[at:to])
        w_of = np.arange(before, ends[to - 1]) - np.repeat(ends[at:to] - words[at:to] - first[at:to] // BITS, words[at:to])
        if len(q_of):
            yield _near(queries, planes, radius, q_of, w_of, first[q_of] - w_of * BITS, stop[q_of] - w_of * BITS, bits)
        at = to


def _near(
    queries: np.ndarray, planes: np.ndarray, radius: int, q_of: np.ndarray, w_of: np.ndarray, first: np.ndarray, stop: np.ndarray, bits: Sequence[int]
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of some blocks; ``first`` and ``stop`` count from the word's first value."""
    width = max(1, radius.bit_length())
    ones = ~np.uint64(0)
    counters = [np.zeros(len(q_of), np.uint64) for _ in range(width)]
    over = (np.uint64(1) << np.maximum(first, 0).astype(np.uint64)) - np.uint64(1)
    over |= np.where(stop < BITS, ones << np.minimum(stop, BITS - 1).astype(np.uint64), np.uint64(0))
    query = queries[q_of]

    def add(plane: np.ndarray, at: int) -> None:
        for k in range(at, width):
            counters[k], plane = counters[k] ^ plane, counters[k] & plane
        over[:] |= plane

    def difference(b: int) -> np.ndarray:
        set_bits = (query >> np.uint64(b)) & np.uint64(1)
        return planes[b].take(w_of) ^ (np.uint64(0) - set_bits)

    def too_far() -> np.ndarray:
        # counter > radius, from the top bit down
        above, equal = np.zeros(len(q_of), np.uint64), np.full(len(q_of), ones)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return over | above

    for n in range(0, len(bits), 3):
        some = bits[n : n + 3]
        if len(some) == 3:
            x, y, z = (difference(b) for b in some)
            half = x ^ y
            add(half ^ z, 0)
            carry = (x & y) | (half & z)
            if width > 1:
                add(carry, 1)
            else:
                over |= carry
        else:
            for last in some:
                add(difference(last), 0)
        if n >= 9 and n % 6 == 3:
            alive = np.flatnonzero(too_far() != ones)
            if len(alive) < len(q_of):
                q_of, w_of, over, query = q_of[alive], w_of[alive], over[alive], query[alive]
                counters = [c[alive] for c in counters]
                if not len(q_of):
                    break
    close = ~too_far()
    hit = np.flatnonzero(close)
    lanes = np.unpackbits(close[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return q_of[hit[row]], w_of[hit[row]] * BITS + lane


def _tie(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the groups of each left and right place; ``root`` has the first place of each one's group."""
    while True:
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            return
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where the first four numbers of a row differ from the ones of the row before."""
    changed = np.ones(rows.shape[1], bool)
    changed[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
    return np.flatnonzero(changed)


def link_pieces(rows: np.ndarray, radius: int, bits: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of whole pieces of one band: a spanning forest of each, output stays linear.

    ``rows`` are (band, key, lower slice, upper slice, own slice, fingerprint)
    in the order of the first five. All pieces go through the planes together,
    so that many small ones cost no more than a large one.
    """
    _, _, lower, upper, own, values = rows
    starts = _starts(rows)
    ends = np.append(starts[1:], len(values))
    sizes = ends - starts
    # In a slice, a fingerprint meets those behind it; of two slices, those of the lower one meet all of the upper.
    place, alone = np.arange(len(values)), lower == upper
    first = np.where(alone, place + 1, np.repeat(starts + np.add.reduceat(own == lower, starts, dtype=np.int64), sizes))
    stop = np.where(alone | (own == lower), np.repeat(ends, sizes), 0)
    unsigned, root = np.ascontiguousarray(values).view(np.uint64), place.copy()
    for left, right in near(unsigned, unsigned, radius, first, stop, bits):
        _tie(root, left, right)
    tied = np.flatnonzero(root != place)
    return values[tied], values[root[tied]]


def band_plan(n: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """How many pieces to cut the bits into, and which sets of pieces to compare on.

    Two fingerprints within ``radius`` bits agree on all but ``radius`` pieces at
    least, so on one of the sets. More pieces make longer keys and smaller
    bands: the first plan whose average band is at most ``BAND_ROWS``.
    """
    for pieces in range(radius + 1, min(BITS, radius + 4) + 1):
        key_bits = BITS * (pieces - radius) // pieces
        if n >> key_bits <= BAND_ROWS:
            break
    return pieces, list(combinations(range(pieces), pieces - radius))


def link_edges(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b) links between different fingerprints: a spanning forest of every compared piece.

    ``distinct`` has one row (fp) per fingerprint. No link is lost: each pair
    within the radius shares a band, and a band too large for one task is cut
    into slices of which every two meet in one task.
    """
    pieces, sets = band_plan(n, radius)
    cuts = [BITS * k // pieces for k in range(pieces + 1)]

    def key(chosen: tuple[int, ...]):
        mask = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(sets.index(chosen)).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))

    keyed = distinct.select("fp", F.explode(F.array(*[key(s) for s in sets])).alias("k")).select("fp", "k.band", "k.key")
    # Only bands that are cut are joined, and the others are not shuffled for it.
    large = saved(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK), "simhash-large-bands")
    slices = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    sized = keyed.join(large, ["band", "key"], "left").withColumn("slices", slices)
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    # Slice i meets every slice j: the pair (lower, upper) names the piece.
    met = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("lower"), F.greatest(F.col("own"), j).alias("upper")),
    )
    pieces_of = (
        sized.withColumn("own", own)
        .withColumn("met", F.explode(met))
        .select("band", "key", "met.lower", "met.upper", "own", "fp")
    )
    # The bits in which the fingerprints of a band may differ.
    free = [[b for p in range(pieces) if p not in s for b in range(cuts[p], cuts[p + 1])] for s in sets]

    def links(rows: np.ndarray) -> pa.RecordBatch:
        a, b = link_pieces(rows, radius, free[rows[0, 0]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a partition as they come; rows come sorted, so only the last piece waits for its end."""
        held = np.zeros((6, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, [c.to_numpy().astype(np.int64) for c in batch.columns]], axis=1)
            whole = [*_starts(held[:1]).tolist(), *_starts(held)[-1:].tolist()]
            for begin, end in pairwise(whole):
                if begin < end:
                    yield links(held[:, begin:end])
            held = held[:, whole[-1] if whole else 0 :]
        if held.shape[1]:
            yield links(held)
        give_back()

    at = partitions_for(distinct, n * len(sets), 200_000)
    names = ["band", "key", "lower", "upper"]
    dealt = pieces_of.repartition(at, *names).sortWithinPartitions(*names, "own")
    return dealt.mapInArrow(compared, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root, component_id) of every different fingerprint."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    roots = components(link_edges(nodes.select("fp"), nodes.count(), radius), "simhash-links")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group_id = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, placed.join(group_id, "root").select("fp", "root", "component_id")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups by fingerprint distance.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``radius`` differing bits, the document's own included. Equal
    fingerprints are one node, however many documents share it. Repeated rows
    and null ids keep their rows; a null id has the component of its
    fingerprint's group, null only where no document of the group has an id.
    Texts without words have fingerprint zero and are linked like any other.
    An empty table gives no rows; further columns are ignored.
    """
    prints, by_print = _grouped(docs, id_col, text_col, shingle, radius)
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of :func:`simhash_groups`: that of the smallest id.

    Null ids come last, rows of one id go by the hash of their texts, and of
    rows that repeat id and text one stays. All columns pass through.
    """
    prints, by_print = _grouped(docs, id_col, text_col, shingle, radius)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = saved(prints.join(by_print, "fp").select("root", first.alias("first")), "simhash-rows")
    best = rows.groupBy("root").agg(F.min("first").alias("best"))
    # What goes is listed, not what stays: it is the smaller part, and its rows alone are joined.
    gone = rows.join(best, "root").filter("first <> best").select("first.doc_id", "first.text_hash").distinct()
    # Rows travel as one value, so that no column of theirs can be taken for one of these.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    left = whole.join(
        gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")),
        F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")),
        "left_anti",
    )
    repeated = rows.join(best, "root").filter("first = best").groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (left if repeated.isEmpty() else left.dropDuplicates(["id", "hash"])).select("row.*")
