"""SimHash groups against a bit-by-bit brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cloudtally.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius):
    """prints: list of (id, fingerprint); the smallest id reachable, by row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return [smallest.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 9])
def test_within_is_exact(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 2**64, 700, dtype=np.uint64)
    for i in range(350):
        values[350 + i] = values[i]
        for b in rng.choice(64, rng.integers(0, radius + 4), replace=False):
            values[350 + i] ^= np.uint64(1 << int(b))
    left, right = simhash.within(values[:90], values, radius)
    far = np.bitwise_count(values[:90, None] ^ values[None, :])
    assert set(zip(left.tolist(), right.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


def test_majority_of_many_hashes():
    hashes = np.random.default_rng(3).integers(0, 2**64, 2001, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > 2001)
    assert simhash.majority(hashes) == want
    assert simhash.majority(hashes[:0]) == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_bands_hold_every_close_pair(n):
    pieces, sets = simhash.band_plan(n, 4)
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    rng = np.random.default_rng(5)
    for _ in range(300):
        spoilt = {sum(b >= c for c in cuts[1:]) for b in rng.choice(64, 4, replace=False)}
        assert any(not spoilt & set(s) for s in sets)


def test_groups_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
    got = simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(prints, slow_groups(prints, 4))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(4, None, 1), (3, "", 2), (None, "a b c d e", 3), (7, "A B C D E", 4), (7, "A B C D E", 4), (8, long, 5), (None, " \t ", 6), (9, "one", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str)
    prints = [(d, slow_fingerprint(t)) for d, t, _ in rows]
    assert got == sorted([(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, slow_groups(prints, 4))], key=str)
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_a_large_band_is_cut_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 2**63))
    prints = {base}
    while len(prints) < 300:
        at = list(prints)[int(rng.integers(0, len(prints)))]
        prints.add(at ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    values = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.link_edges(frame, len(values), 4)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len(set(roots.values())) == 1 and len(roots) == len(values)
    assert edges.count() < 300 * 20 * 19


def test_a_longer_key_waits_until_bands_are_large():
    # a sixth piece makes fifteen copies of every fingerprint in place of five
    assert simhash.band_plan(3_000_000, 4)[0] == 5
    assert simhash.band_plan(30_000_000, 4)[0] == 6


def test_many_small_pieces_are_compared_together(monkeypatch):
    rng = np.random.default_rng(7)
    calls = []
    planes_of = simhash.planes_of
    monkeypatch.setattr(simhash, "planes_of", lambda values: calls.append(len(values)) or planes_of(values))
    values = np.repeat(rng.integers(0, 2**64, 5000, dtype=np.uint64), 2)
    for b in range(4):
        values[1::2] ^= np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)
    values[1::4] = rng.integers(0, 2**64, 2500, dtype=np.uint64)
    rows = np.zeros((6, 10_000), np.int64)
    rows[1], rows[5] = np.arange(10_000) // 2, values.view(np.int64)
    a, b = simhash.link_pieces(rows, 4, range(64))
    near = np.bitwise_count(values[::2] ^ values[1::2]) <= 4
    assert dict(zip(a.tolist(), b.tolist())) == dict(zip(rows[5, 1::2][near].tolist(), rows[5, ::2][near].tolist()))
    assert len(calls) == 1


def test_two_slices_meet_across_only():
    rows = np.zeros((6, 8), np.int64)
    rows[3, :5] = 1  # a piece of the slices 0 and 1, then one of slice 1 alone
    rows[2, 5:] = rows[3, 5:] = rows[4, 3:] = 1
    rows[5] = [0, 1, 1 << 40, 3, 1 << 50, 0, 1, (1 << 20) - 1]
    a, b = simhash.link_pieces(rows, 2, range(64))
    assert set(zip(a.tolist(), b.tolist())) == {(1, 0), (1 << 40, 0), (3, 0), (1 << 50, 0)}
    a, b = simhash.link_pieces(rows[:, 5:], 2, range(64))
    assert (a.tolist(), b.tolist()) == ([1], [0])
    apart = np.array([[0] * 3, [0] * 3, [0] * 3, [1] * 3, [0, 0, 1], [0, 1, (1 << 20) - 1]], np.int64)
    assert simhash.link_pieces(apart, 2, range(64))[0].tolist() == []


def test_hashes_of_runs_of_any_length(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 6000, dtype=np.uint8)
    sizes = np.concatenate([np.arange(400), rng.integers(0, 100, 400)])
    starts = np.sort(rng.integers(0, 5600, 800))
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts.tolist(), sizes.tolist())]
    for stretch in (1, 300, 1 << 18):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        assert simhash.run_hashes(data, starts, sizes, 42).tolist() == want


def test_prints_of_a_batch_take_no_call_for_each_shingle(monkeypatch):
    def alone(*args):
        raise AssertionError("a short shingle was hashed alone")

    texts = [None, "", " \t ", "one", "A b", "É a\x0bB\x85c d", "a b c d e f", " x\ny  z w ", "word " * 2000, "\x1c a \x1f b"]
    want = [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", alone)
    assert simhash.text_prints(pa.array([*texts, "x"]).slice(0, len(texts)), 4).tolist() == want
    monkeypatch.undo()
    long = ["w" * 300 + " a b c d e", "a b " + "é" * 200 + " c"]
    assert simhash.text_prints(pa.array(long), 4).tolist() == [slow_fingerprint(t) for t in long]


def test_close_pairs_of_a_large_group_come_in_small_parts():
    rng = np.random.default_rng(9)
    values = np.zeros(2048, np.uint64)
    for _ in range(2):
        values ^= np.uint64(1) << rng.integers(0, 64, 2048, dtype=np.uint64)
    parts = [len(i) for i, _ in simhash.near(values, values, 4, np.zeros(2048, np.int64), np.full(2048, 2048), range(64))]
    assert sum(parts) == 2048 * 2048 and max(parts) <= 64 * simhash.TOGETHER <= 1 << 19
