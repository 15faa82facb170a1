"""Line dedup against a comparison of every pair of lines."""

import random

import numpy as np
import pytest

from cloudtally.llm import lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def slow(rows):
    """rows: (id, text) with ids unique; {id: text without repetitions}."""
    seen, out = [], {}
    for doc, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if line.strip() and any(near(line, other) for other in seen):
                seen.append(line)
                continue
            if line.strip():
                seen.append(line)
            kept.append(line)
        out[doc] = "\n".join(kept)
    return out


@pytest.mark.parametrize("few", [True, False])
def test_against_every_pair(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    rng = random.Random(4)
    base = ["".join(rng.choice("abü ") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["The quick brown fox jumps"] * 5
    rows = []
    for doc in range(120):
        out = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randint(0, len(line))
                line = rng.choice([line[:k] + rng.choice("abö") + line[k:], line[:k] + line[k + 1 :], line[:k] + "x" + line[k + 1 :]])
            out.append(line)
        rows.append((doc, "\n".join(out)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    want = slow(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    for doc, text in rows:
        assert got[doc]["n_lines"] == len(text.split("\n"))
        whole = want[doc].split("\n") if want[doc] or got[doc]["n_dropped"] < got[doc]["n_lines"] else []
        assert got[doc]["n_dropped"] == got[doc]["n_lines"] - len(whole)


def test_variant_hashes():
    rng = np.random.default_rng(0)
    hasher = lines._Hasher()
    for line in ["", "a", "aab", "".join(chr(c) for c in rng.integers(32, 70000, 300) if not 0xD800 <= c < 0xE000)]:
        hashes = hasher(line)
        assert len(hashes) == len(line) + 1 and hashes[0] == hasher(line)[0]
        for k in range(len(line)):
            assert hashes[k + 1] == hasher(line[:k] + line[k + 1 :])[0]


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(70_000))
    rows = [
        (2, "same\nsame\n\n \n", 1), (1, None, 2), (3, "", 3), (None, "same", 4), (None, "own line", 4), (5, "sane\nx", 5), (5, "sane\nx", 5),
        (6, long, 6), (7, long[:40_000] + long[40_001:], 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    found = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    assert found == [
        (1, None, 0), (2, "same\n\n \n", 1), (3, "", 0), (5, "x", 1), (5, "x", 1), (6, long, 0), (7, "", 1), (None, "", 1), (None, "own line", 0)
    ]
    assert lines.dedup_lines(docs.limit(0)).collect() == []
