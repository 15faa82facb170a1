"""N-gram Jaccard join: skipped index lists between classes of similar sets, answers derived from a similar set's.

The work goes through five tables, none of which holds a pair of documents:

1. every document's shingle set, as a hash of the set and its size;
2. for every set the shingles that some other set has too, rarest first; a set
   that cannot have enough of them is done;
3. classes: sets that are close to a centre, kept as their differences from it;
4. pairs of classes that may hold a link, from prefix lists of the centres;
5. links and groups, each member's overlaps derived from its centre's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm.shared import chunks, components, give_back, lower_ascii, partitions_for, saved, small_batches, split_words

#: Shingles a task sorts at a time.
SORT_ROWS = 4_000_000
#: Sets, and shingles of sets, out of which classes are made together.
CLASS_SETS, CLASS_TOKENS = 2048, 2_000_000
#: A set joins a centre at this similarity in percent; so many centres are tried on the sets that are made classes of together.
CLOSE, CENTRES = 80, 64
#: Sets are dealt by so many different smallest shingles, one after the other, those that are not in a class of ``FIRM`` sets each time.
ROUNDS, FIRM = 3, 8
#: Entries of a list that are skipped or looked at together, and the longest piece of a list.
SKIP, LIST_PIECE = 64, 4096
#: A shingle is frequent where it is in this many of the sets of a megabyte of text, one in so many of them at least,
#: and if so for one in ``FREQUENT_CHUNKS`` megabytes. As a megabyte has some 200,000 shingles, there are 1.3 million at most.
FREQUENT_SETS, FREQUENT_SHARE, FREQUENT_CHUNKS = 8, 32, 50
LAST = np.iinfo(np.int32).max

SET = np.dtype([("sid", "<i8"), ("n", "<i4"), ("count", "<i4")])
SHARED = np.dtype([("token", "<u8"), ("df", "<i4")])
DELTA = np.dtype([("member", "<i4"), ("token", "<u8")])

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    codes, counts, names = split_words(lower_ascii(texts))
    of_word = np.array([xxhash.xxh64_intdigest(n.encode()) for n in names], np.uint64)
    words = of_word[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * _STEP + words[k : len(words) - size + 1 + k] if len(runs) else runs
    runs = mixed(runs)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= size:
            out.append(np.unique(runs[end - n : end - size + 1]))
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for k in range(end - n, end):
                short = short * _STEP + words[k : k + 1]
            out.append(mixed(short))
    return out


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    total = mixed(tokens ^ _M2).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + np.full(1, len(tokens), np.uint64) * _STEP).view(np.int64)[0])


def documents_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, sid, n, frequent): set and size of every document, sid null without words; what is frequent stands at the first of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), size)
            sids = [set_id(s) if len(s) else None for s in sets]
            different = list({i: s for i, s in zip(sids, sets) if i is not None}.values())
            token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *different]), return_counts=True)
            frequent = token[count >= max(FREQUENT_SETS, len(different) / FREQUENT_SHARE)].view(np.int64)
            lists = [frequent.tolist(), *[[]] * (len(sets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x or None for x in lists], pa.list_(pa.int64())), pa.array([True, *[False] * (len(sets) - 1)]),
                ],
                names=["doc_id", "sid", "n", "frequent", "head"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, sid long, n long, frequent array<long>, head boolean")


def _packed(part: np.ndarray, owner: np.ndarray, tokens: np.ndarray, sids: np.ndarray, ns: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows (part, sets, tokens): the tokens of each part with the sets that own them, runs of one set together."""
    order = np.lexsort((owner, part))
    part, owner, tokens = part[order], owner[order], tokens[order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])) if len(part) else np.zeros(0, np.int64)
    sets = np.empty(len(new), SET)
    sets["sid"], sets["n"], sets["count"] = sids[owner[new]], ns[owner[new]], np.diff([*new, len(part)])
    heads = np.flatnonzero(np.concatenate([[True], np.diff(part[new]) != 0])) if len(new) else new
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(new)]):
        first, last = new[a], new[b] if b < len(new) else len(part)
        yield int(part[first]), sets[a:b].tobytes(), tokens[first:last].tobytes()


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All sets and tokens of a partition, a set once however often it was sent."""
    sets, tokens = [np.zeros(0, SET)], [np.zeros(0, kind)]
    for batch in batches:
        sets += [np.frombuffer(x.as_buffer(), SET) for x in batch.column("sets")]
        tokens += [np.frombuffer(x.as_buffer(), kind) for x in batch.column("tokens")]
    return np.concatenate(sets), np.concatenate(tokens)


_PACKED = "part int, frequent boolean, sets binary, tokens binary"


def _rows(packed: list[tuple[int, bytes, bytes]], frequent: bool) -> pa.RecordBatch:
    parts, sets, tokens = zip(*packed) if packed else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array([frequent] * len(parts), pa.bool_()), pa.array(sets, pa.binary()), pa.array(tokens, pa.binary())],
        names=["part", "frequent", "sets", "tokens"],
    )


_SALTS = [mixed(np.arange(1, 2, dtype=np.uint64) * _STEP * np.uint64(r + 1))[0] for r in range(ROUNDS)]


def keys_of(shared: np.ndarray) -> list[int]:
    """For each round the least of the set's shingles, mixed anew."""
    return [int(mixed(shared["token"] ^ salt).min().view(np.int64)) for salt in _SALTS]


#: Bytes of a shingle's hash that travel; with the number of the part they are counted in they make a hash again.
SENT = 6


def _thin(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT])


def _whole(thin: np.ndarray, part: int) -> np.ndarray:
    out = np.zeros((len(thin), 8), np.uint8)
    out[:, :SENT] = thin
    return out.reshape(-1).view("<u8") | np.uint64(part) << np.uint64(8 * SENT)


def shared_tokens(docs: DataFrame, known: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """(sid, n, tokens, keys): sets with enough shingles that are in other sets too, those shingles rarest first.

    Shingles travel packed, by their hash, to where they are counted, and those
    with a count over one back, by their set. Frequent ones, which no task
    should have to gather, are told from a broadcast list and come last in the
    order; they count as shared wherever they are.
    """
    spark = docs.sparkSession
    chunks_n = known.filter("head").count()
    often = known.select(F.explode("frequent").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    frequent = spark.sparkContext.broadcast(
        np.sort(np.array([r["t"] for r in often.filter(F.col("c") * FREQUENT_CHUNKS >= chunks_n).select("t").toLocalIterator()], np.int64).view(np.uint64))
    )
    parts = partitions_for(docs, known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], SORT_ROWS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in chunks(batches):
            own = {}
            for tokens in shingle_sets(batch.column("text"), size):
                if len(tokens) and (sid := set_id(tokens)) not in sent:
                    own[sid] = tokens
                    sent.add(sid)
            if len(sent) > 1_000_000:  # only spares work; a set that is sent twice counts once
                sent.clear()
            if not own:
                continue
            sids, ns = np.array(list(own), np.int64), np.array([len(t) for t in own.values()])
            owner, tokens = np.repeat(np.arange(len(ns)), ns), np.concatenate(list(own.values()))
            rare = ~np.isin(tokens, frequent.value)
            part = (tokens[rare] >> np.uint64(33)).astype(np.int64) % parts
            yield _rows(list(_packed(part, owner[rare], _thin(tokens[rare]), sids, ns)), False)
            common = np.empty(int((~rare).sum()), SHARED)
            common["token"], common["df"] = tokens[~rare], LAST
            yield _rows(list(_packed(sids[owner[~rare]] % parts, owner[~rare], common, sids, ns)), True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            passed = batch.filter(batch.column("frequent"))
            if passed.num_rows:
                yield passed
            if batch.num_rows > passed.num_rows:
                held.append(batch.filter(pc.invert(batch.column("frequent"))))
        part = held[0].column("part")[0].as_py() if held else 0  # a partition is one part
        sets, thin = _unpacked(iter(held), np.dtype(("u1", SENT)))
        tokens = _whole(thin.reshape(-1, SENT), part)
        del held, thin
        first = np.zeros(len(sets), bool)
        first[np.unique(sets["sid"], return_index=True)[1]] = True
        keep = np.repeat(first, sets["count"])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sets["count"])[keep]
        tokens = tokens[keep]
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        df = np.diff([*heads, len(tokens)])
        many = np.repeat(df > 1, df)
        out = np.empty(int(many.sum()), SHARED)
        out["token"], out["df"] = tokens[many], np.repeat(df, df)[many]
        owner = owner[many]
        for row in _packed(sets["sid"][owner] % parts, owner, out, sets["sid"], sets["n"]):
            yield _rows([row], False)
        give_back()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, tokens = _unpacked(batches, SHARED)
        runs = np.cumsum(sets["count"]) - sets["count"]
        by_sid = np.argsort(sets["sid"], kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(sets["sid"][by_sid]) != 0])) if len(sets) else np.zeros(0, np.int64)
        rows = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(sets)]):
            own = by_sid[a:b]
            n = int(sets["n"][own[0]])
            # Exact copies send their frequent shingles more than once.
            mine = np.unique(np.concatenate([tokens[runs[i] : runs[i] + sets["count"][i]] for i in own]))
            if 100 * len(mine) >= percent * n:
                mine = mine[np.lexsort((mine["token"], mine["df"]))]
                rows.append((int(sets["sid"][own[0]]), n, mine.tobytes(), keys_of(mine)))
            if len(rows) == 1000 or (b == len(sets) and rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["sid", "n", "tokens", "keys"]
                )
                rows = []
        give_back()

    texts = small_batches(docs.select(F.col(text_col).cast("string").alias("text")))
    counted = texts.mapInArrow(send, _PACKED).repartitionById(parts, "part").mapInArrow(count, _PACKED)
    return counted.repartitionById(parts, "part").mapInArrow(order, "sid long, n long, tokens binary, keys array<long>")


class Class(NamedTuple):
    """A centre's size and shingles by value, its members' sizes, and what each lacks and has besides, by shingle."""

    n: int
    tokens: np.ndarray
    ns: np.ndarray
    gone: np.ndarray
    come: np.ndarray


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of different values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def closeness(percent: int) -> int:
    """Similarity to its centre that a member needs: so near that centres of linked members share something."""
    return max(CLOSE, 101 - percent // 2)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles that more than half of the sets have, by value."""
    token, first, count = np.unique(np.concatenate([s["token"] for s in sets]), return_index=True, return_counts=True)
    return np.concatenate(sets)[first[2 * count > len(sets)]]


def _near(rest: list[tuple[int, int, np.ndarray]], centre: np.ndarray, close: int) -> list[bool]:
    both = [overlap(centre["token"], s["token"]) for *_, s in rest]
    return [b > 0 and 100 * b >= close * (n + len(centre) - b) for b, (_, n, _) in zip(both, rest)]


def _made(sets: list[tuple[int, int, np.ndarray]], centre: np.ndarray, of: int | None) -> dict:
    made = {"of": of, "n": len(centre), "shared": centre, "radius": 0.0, "sids": [], "ns": [], "gone": [], "come": []}
    for place, (sid, n, own) in enumerate(sets):
        for name, x, y in (("gone", centre, own), ("come", own, centre)):
            delta = np.empty(len(d := np.setdiff1d(x["token"], y["token"], assume_unique=True)), DELTA)
            delta["member"], delta["token"] = place, d
            made[name].append(delta)
        both = len(own) - len(made["come"][-1])
        made["sids"].append(sid)
        made["ns"].append(n)
        made["radius"] = max(made["radius"], 1 - both / (n + len(centre) - both))
    return made


def make_classes(
    sets: list[tuple[int, int, np.ndarray]], close: int = CLOSE, centres: Sequence[tuple[int, np.ndarray]] = ()
) -> list[dict]:
    """Classes of (sid, n, shared shingles): each set goes to a centre that is close, or else is one of its own.

    ``centres`` (class, shingles) are tried first, and what goes to one says so
    in ``of``. A new centre is what most of the sets left have in common,
    which in a group of near copies is the text they come from, or else what
    others have of the first one of them.
    """
    classes: list[dict] = []
    rest = [(sid, n, np.sort(shared, order="token")) for sid, n, shared in sorted(sets, key=lambda s: s[0])]

    def take(near: list[bool], centre: np.ndarray, of: int | None) -> list[tuple[int, int, np.ndarray]]:
        classes.append(_made([s for s, x in zip(rest, near) if x], centre, of))
        return [s for s, x in zip(rest, near) if not x]

    for of, centre in centres:
        centre = np.sort(centre, order="token")
        if any(near := _near(rest, centre, close)):
            rest = take(near, centre, of)
    tried = 0
    while rest:
        if len(rest) > 1 and tried < CENTRES:
            tried += 1
            for centre in (_common([s for *_, s in rest]), rest[0][2]):
                if sum(near := _near(rest, centre, close)) > 1:
                    break
            if sum(near) > 1:
                rest = take(near, centre, None)
                continue
        # A set alone is its own centre, with all its shingles.
        classes.append(_made(rest[:1], rest[0][2], None) | {"n": rest[0][1], "radius": 0.0})
        rest = rest[1:]
    return classes


_CLASSES = "class long, of long, n long, radius double, tokens binary, dfs binary, keys array<long>, sids array<long>, ns array<long>, gone binary, come binary"


def _class_rows(made: list[dict]) -> pa.RecordBatch:
    delta = lambda parts: np.sort(np.concatenate([np.zeros(0, DELTA), *parts]), order=("token", "member")).tobytes()
    shared = [c["shared"][np.lexsort((c["shared"]["token"], c["shared"]["df"]))] for c in made]
    columns = {
        "class": pa.array([c["sids"][0] for c in made], pa.int64()), "of": pa.array([c["of"] for c in made], pa.int64()), "n": pa.array([c["n"] for c in made], pa.int64()),
        "radius": pa.array([c["radius"] for c in made], pa.float64()),
        "tokens": pa.array([x["token"].tobytes() for x in shared], pa.binary()), "dfs": pa.array([x["df"].tobytes() for x in shared], pa.binary()),
        "keys": pa.array([keys_of(x) for x in shared], pa.list_(pa.int64())),
        "sids": pa.array([c["sids"] for c in made], pa.list_(pa.int64())), "ns": pa.array([c["ns"] for c in made], pa.list_(pa.int64())),
        "gone": pa.array([delta(c["gone"]) for c in made], pa.binary()), "come": pa.array([delta(c["come"]) for c in made], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _one_round(loose: DataFrame, centres: DataFrame | None, nth: int, close: int) -> DataFrame:
    """Classes of the sets with the same key of this round, in pieces of bounded size, each of which gets the centres of that key."""
    own = loose.select(F.col("keys")[nth].alias("key"), "sid", "n", "tokens", F.lit(None).cast("binary").alias("dfs"))
    large = own.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CLASS_SETS)
    slices = F.coalesce(F.ceil(F.col("size") / CLASS_SETS), F.lit(1))
    cut = own.join(large, "key", "left").withColumn("slice", F.pmod(F.xxhash64("sid"), slices)).drop("size")
    if centres is not None:
        known = centres.select(F.col("keys")[nth].alias("key"), F.col("class").alias("sid"), F.lit(None).cast("long").alias("n"), "tokens", "dfs")
        every = F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))
        cut = cut.unionByName(known.join(large, "key", "left").withColumn("slice", every).drop("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, size, group = [], [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                new = group != (r["key"], r["slice"])
                if held and (new or size > CLASS_TOKENS):
                    yield _class_rows(make_classes(held, close, known))
                    held, size = [], 0
                if new:
                    group, known = (r["key"], r["slice"]), []
                if r["n"] is None:
                    centre = np.empty(len(r["dfs"]) // 4, SHARED)
                    centre["token"], centre["df"] = np.frombuffer(r["tokens"], "<u8"), np.frombuffer(r["dfs"], "<i4")
                    if len(known) < CENTRES:
                        known.append((r["sid"], centre))
                else:
                    held.append((r["sid"], r["n"], np.frombuffer(r["tokens"], SHARED)))
                    size += len(held[-1][2])
        if held:
            yield _class_rows(make_classes(held, close, known))

    # Centres, which have no size here, come before the sets of their piece.
    dealt = cut.repartition("key", "slice").sortWithinPartitions("key", "slice", F.asc_nulls_first("n"), "sid")
    return small_batches(dealt).mapInArrow(run, _CLASSES)


def _merged(classes: DataFrame) -> DataFrame:
    """Classes with the same centre ``of`` another as few as there is room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if held and (held["of"] != r["of"] or len(held["sids"]) >= CLASS_SETS):
                    yield _class_rows([held])
                    held = None
                if not held:
                    shared = np.empty(len(r["dfs"]) // 4, SHARED)
                    shared["token"], shared["df"] = np.frombuffer(r["tokens"], "<u8"), np.frombuffer(r["dfs"], "<i4")
                    held = {"of": r["of"], "n": r["n"], "radius": 0.0, "shared": shared, "sids": [], "ns": [], "gone": [], "come": []}
                for name in ("gone", "come"):
                    delta = np.frombuffer(r[name], DELTA).copy()
                    delta["member"] += len(held["sids"])
                    held[name].append(delta)
                held["sids"] += r["sids"]
                held["ns"] += r["ns"]
                held["radius"] = max(held["radius"], r["radius"])
        if held:
            yield _class_rows([held])

    return small_batches(classes.repartition("of").sortWithinPartitions("of", "class")).mapInArrow(run, _CLASSES)


def classes_of(live: DataFrame, percent: int) -> DataFrame:
    """All sets as classes. Those in small ones under one key are dealt again by the next, with the centres of large ones."""
    close, loose, made, joined = closeness(percent), live, None, None
    for nth in range(ROUNDS):
        found = saved(_one_round(loose, made, nth, close), "set-classes")
        last = nth == ROUNDS - 1
        done = found.filter("of IS NULL") if last else found.filter((F.size("sids") >= FIRM) & F.col("of").isNull())
        made = done if made is None else made.unionByName(done)
        more = found.filter("of IS NOT NULL")
        joined = more if joined is None else joined.unionByName(more)
        if not last:
            again = found.filter((F.size("sids") < FIRM) & F.col("of").isNull()).select(F.explode("sids").alias("sid"))
            loose = loose.join(again, "sid", "left_semi")
    return made.unionByName(saved(_merged(joined), "joined-classes"))


def _may_link(n1, rest1, r1, n2, rest2, r2, percent: int):
    """Whether two centres, of whose common shingles the first is found with so many left, may have a link between their classes."""
    least = np.maximum(percent / 100 - r1 - r2 - 1e-9, 0.01)
    return (np.minimum(n1, n2) >= least * np.maximum(n1, n2)) & (np.minimum(rest1, rest2) * (1 + least) >= least * (n1 + n2) - 1e-6)


def list_pairs(n: np.ndarray, rest: np.ndarray, radius: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``left``, of ``right``) in a list that may link, blocks of ``right`` skipped by the positions and sizes they span."""
    right = right[np.lexsort((rest[right], n[right]))]
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.arange(0, len(right), SKIP)
    low, high = np.minimum.reduceat(n[right], starts), np.maximum.reduceat(n[right], starts)
    most, wide = np.maximum.reduceat(rest[right], starts), np.maximum.reduceat(radius[right], starts)
    for b, start in enumerate(starts.tolist()):
        least = np.maximum(percent / 100 - radius[left] - wide[b] - 1e-9, 0.01)
        fits = (high[b] >= least * n[left]) & (n[left] >= least * low[b])
        fits &= np.minimum(rest[left], most[b]) * (1 + least) >= least * (n[left] + low[b]) - 1e-6
        probes, block = left[fits], right[start : start + SKIP]
        x, y = np.nonzero(_may_link(n[probes, None], rest[probes, None], radius[probes, None], n[block], rest[block], radius[block], percent))
        out[0].append(probes[x])
        out[1].append(block[y])
    return np.concatenate(out[0]), np.concatenate(out[1])


def class_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that may hold a link between them, each pair once, a < b.

    Two centres whose members link are no further apart than a link and both
    radii, so they share one of the first shingles that this leaves to each.
    Long lists are cut into pieces of which every two meet.
    """
    widest = classes.agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tokens, n = np.frombuffer(r["tokens"], "<u8"), r["n"]
                least = max(percent / 100 - r["radius"] - widest - 1e-9, 0.01)
                length = n - int(np.ceil(least * n - 1e-6)) + 1
                alone = n - len(tokens)  # the rarest of all, which nobody else has
                taken = tokens[: max(0, length - alone)]
                out.append((taken.view(np.int64), np.full(len(taken), r["class"]), np.full(len(taken), n), n - alone - np.arange(len(taken)), np.full(len(taken), r["radius"])))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "f8")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "n", "rest", "radius"])

    entries = small_batches(classes.select("class", "n", "radius", "tokens")).mapInArrow(prefixes, "token long, class long, n long, rest long, radius double")
    sizes = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = entries.join(sizes, "token").withColumn("slices", F.ceil(F.col("size") / LIST_PIECE))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.struct(F.least("own", j).alias("lower"), F.greatest("own", j).alias("upper")))
    pieces = (
        sized.withColumn("own", F.pmod(F.xxhash64("class"), F.col("slices")))
        .withColumn("met", F.explode(met))
        .select("token", "met.lower", "met.upper", "own", "class", "n", "rest", "radius")
        .repartition("token", "lower", "upper")
        .sortWithinPartitions("token", "lower", "upper")
    )

    def meet(table: dict[str, np.ndarray]) -> np.ndarray:
        """Pairs of classes in whole lists, as rows."""
        n, rest, radius = table["n"], table["rest"], table["radius"]
        new = np.concatenate([[True], (table["token"][1:] != table["token"][:-1]) | (table["lower"][1:] != table["lower"][:-1]) | (table["upper"][1:] != table["upper"][:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(new)])
        group = np.cumsum(new) - 1
        short = np.flatnonzero((sizes <= SKIP)[group] & (table["lower"] == table["upper"]))
        pairs = []
        for d in range(1, int(sizes.max()) if len(short) else 0):
            if d >= SKIP:
                break
            i, j = short[:-d], short[d:]
            same = group[i] == group[j]
            i, j = i[same], j[same]
            fits = _may_link(n[i], rest[i], radius[i], n[j], rest[j], radius[j], percent)
            pairs.append((i[fits], j[fits]))
        for g in np.flatnonzero((sizes > SKIP) | (table["lower"] != table["upper"])[starts]):
            span = np.arange(starts[g], starts[g] + sizes[g])
            own = table["own"][span]
            left, right = span[own == table["lower"][span[0]]], span[own == table["upper"][span[0]]]
            if len(left) and len(right):
                for first in range(0, len(left), 512):
                    pairs.append(list_pairs(n, rest, radius, left[first : first + 512], right, percent))
        i, j = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]).astype(np.int64) for k in (0, 1))
        x, y = table["class"][i], table["class"][j]
        return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "lower", "upper", "own", "class", "n", "rest", "radius"]
        held = {c: np.zeros(0, np.float64 if c == "radius" else np.int64) for c in names}

        def out(table: dict[str, np.ndarray]) -> pa.RecordBatch:
            pairs = meet(table)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held = {c: np.concatenate([held[c], batch.column(c).to_numpy()]) for c in names}
            key = np.stack([held[c] for c in names[:3]])
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0)) if key.shape[1] else np.zeros(0, np.int64)
            if len(last) and last[-1] >= 100_000:  # the last list may go on in the next batch
                yield out({c: v[: last[-1] + 1] for c, v in held.items()})
                held = {c: v[last[-1] + 1 :] for c, v in held.items()}
        if len(held["token"]):
            yield out(held)

    return pieces.mapInArrow(run, "a long, b long").distinct()


def derived_links(x: Class, z: Class, percent: int, itself: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each member of ``x`` into ``z``, and the other way, and pairs that tie together what links tie together;
    ``itself`` if both are one class. In the pairs, members of ``z`` are numbered behind those of ``x``.

    The centre's overlaps with all of ``z`` come from its overlap with the
    other centre and the differences; every member's come from the centre's,
    changed by the few shingles in which it differs.
    """
    size, nx = len(z.ns), len(x.ns)

    def inside(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, tokens), len(of) - 1)] == tokens if len(of) else np.zeros(len(tokens), bool)

    def hits(delta: np.ndarray) -> np.ndarray:
        return np.bincount(delta["member"][inside(delta["token"], x.tokens)], minlength=size)

    base = overlap(x.tokens, z.tokens) - hits(z.gone) + hits(z.come)
    into, back = np.zeros(nx, np.int64), np.zeros(size, np.int64)

    def holders(tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each member of ``z`` has."""
        have = np.full(size, int(inside(tokens, z.tokens).sum()))
        for delta, sign in ((z.gone, -1), (z.come, 1)):
            lo, hi = np.searchsorted(delta["token"], tokens), np.searchsorted(delta["token"], tokens, side="right")
            n = hi - lo
            if n.any():
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                have += sign * np.bincount(delta["member"][at], minlength=size)
        return have

    own = [np.sort(d, order=("member", "token")) for d in (x.gone, x.come)]
    ends = [np.searchsorted(d["member"], np.arange(nx + 1)) for d in own]
    group, ties = np.arange(nx if itself else nx + size), []
    for y in range(nx):
        both = base
        for d, end, sign in zip(own, ends, (-1, 1)):
            if end[y + 1] > end[y]:
                both = both + sign * holders(d["token"][end[y] : end[y + 1]])
        linked = (100 * both >= percent * (x.ns[y] + z.ns - both)) & (both > 0)
        if itself:
            linked[y] = False
        into[y] = linked.sum()
        back += linked
        if into[y]:
            there = group[(0 if itself else nx) + np.flatnonzero(linked)]
            other = np.unique(there[there != group[y]])
            if len(other):
                ties += [(int(group[y]), int(o)) for o in other]
                group[np.isin(group, other)] = group[y]
    return into, back, ties


def _class(row: dict, suffix: str = "") -> Class:
    return Class(
        row["n" + suffix], np.sort(np.frombuffer(row["tokens" + suffix], "<u8")), np.array(row["ns" + suffix], np.int64),
        np.frombuffer(row["gone" + suffix], DELTA), np.frombuffer(row["come" + suffix], DELTA),
    )


_LINKS = "sid long, links long, a long, b long"


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["sid", "links", "a", "b"])


def links_of(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(sid, links, null, null) for parts of a set's number of links, and (null, null, a, b) for sets that links tie together."""

    def told(sids: list[int], counts: np.ndarray, ties: list[tuple[int, int]]) -> list[tuple]:
        return [(s, n, None, None) for s, n in zip(sids, counts.tolist()) if n] + [(None, None, sids[i], sids[j]) for i, j in ties]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = _class(r)
                into, _, ties = derived_links(own, own, percent, itself=True)
                rows += told(r["sids"], into, ties)
            yield _link_rows(rows)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, z = _class(r), _class(r, "_b")
                both = overlap(x.tokens, z.tokens)
                if both >= (percent / 100 - r["radius"] - r["radius_b"] - 1e-9) * (x.n + z.n - both):
                    into, back, ties = derived_links(x, z, percent)
                    rows += told(r["sids"] + r["sids_b"], np.concatenate([into, back]), ties)
            yield _link_rows(rows)

    columns = ["class", "n", "radius", "tokens", "sids", "ns", "gone", "come"]
    left, right = classes.select(columns), classes.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    met = pairs.join(left, F.col("a") == F.col("class")).join(right, F.col("b") == F.col("class_b")).drop("a", "b")
    alone = classes.filter("size(sids) > 1").select(columns)
    return small_batches(alone).mapInArrow(within, _LINKS).unionByName(met.mapInArrow(between, _LINKS))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    A document's set are its different runs of ``shingle`` words, A-Z
    lower-cased; with fewer words the whole sequence is one. Sets link when
    100 times their intersection is at least ``percent`` times their union.
    ``component_id`` is the smallest id that can be reached, the document's own
    included, and ``n_links`` counts the different other sets it links with.
    Shingles and sets go by 64-bit hashes.

    Texts without words (null, empty, blank) have an empty set, which links
    with nothing: their component is their own id. Equal sets are one,
    however many documents have them. Repeated rows and null ids keep their
    rows; a null id has the component of its group, null only where no document
    of it has an id. Whole texts are read, very long ones too. An empty table
    gives no rows; further columns are ignored.
    """
    known = saved(documents_sets(docs, id_col, text_col, shingle), "shingle-sets")
    live = saved(shared_tokens(docs, known, text_col, shingle, percent), "shared-shingles")
    classes = classes_of(live, percent)
    found = saved(links_of(classes, saved(class_pairs(classes, percent), "class-pairs"), percent), "set-links")
    rooted = components(found.filter("a IS NOT NULL").select("a", "b"), "set-groups").withColumnRenamed("node", "sid")
    links = found.filter("sid IS NOT NULL").groupBy("sid").agg(F.sum("links").alias("n_links"))
    sets = known.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"))
    placed = sets.join(rooted, "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component"))
    by_set = placed.join(lowest, "root").join(links, "sid", "left").select("sid", "component", "n_links")
    return known.join(by_set, "sid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
