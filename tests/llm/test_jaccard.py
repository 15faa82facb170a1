"""Jaccard groups against every pair of shingle sets."""

import random
import re

import numpy as np
import pytest

from cloudtally.llm import jaccard, queries

SF = "/root/testdata/sf0.001"


def slow_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def slow_groups(docs, percent=80):
    """docs: list of (id, text). Rows (id, set size, smallest id reachable, different sets linked with)."""
    sets = [slow_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    others = [set() for _ in docs]
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
                if sets[i] != sets[j]:
                    others[i].add(sets[j])
                    others[j].add(sets[i])
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted([(d, len(sets[i]), smallest.get(find(i)) if sets[i] else d, len(others[i])) for i, (d, _) in enumerate(docs)], key=str)


def rows_of(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()], key=str)


def groups(spark, docs, parts=4, **options):
    return jaccard.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), **options)


def near_copies(seed, families=6, members=40, words=120, passage=True):
    """Families of texts that share most words, close to the bound on both sides, with copies and a passage that all share."""
    rng = random.Random(seed)
    common = " ".join(f"p{i}" for i in range(60))
    docs = []
    for f in range(families):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(rng.randrange(words // 3, words))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[at] = f"n{rng.randrange(10**6)}"
                else:
                    del text[at]
            docs.append(" ".join(text) + (f" {common}" if passage and rng.random() < 0.5 else ""))
    docs += docs[::9] + [d.upper() for d in docs[::17]]
    docs += [" ".join(f"s{rng.randrange(4)}" for _ in range(rng.randrange(8))) for _ in range(60)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_groups_and_links_of_near_copies(spark, seed):
    docs = near_copies(seed)
    assert rows_of(groups(spark, docs)) == slow_groups(docs)


@pytest.mark.parametrize("percent", [30, 50, 95, 100])
def test_other_bounds(spark, percent):
    docs = near_copies(11, families=3, members=25)
    assert rows_of(groups(spark, docs, percent=percent)) == slow_groups(docs, percent)


def test_small_pieces_change_nothing(spark, monkeypatch):
    for name, value in (("CLASS_SETS", 4), ("CLASS_TOKENS", 900), ("CENTRES", 2), ("FIRM", 2), ("SKIP", 3), ("LIST_PIECE", 7), ("SORT_ROWS", 500)):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(21)
    assert rows_of(groups(spark, docs)) == slow_groups(docs)


@pytest.mark.parametrize("close", [50, 80, 101])
def test_classes_are_for_speed_only(spark, monkeypatch, close):
    """However far members may be from their centres, no link is lost and none is made up."""
    monkeypatch.setattr(jaccard, "CLOSE", close)
    docs = near_copies(31, families=4, members=30)
    assert rows_of(groups(spark, docs)) == slow_groups(docs)


def test_frequent_shingles_are_last_in_the_order_and_still_count(spark, monkeypatch):
    for name, value in (("FREQUENT_SETS", 2), ("FREQUENT_SHARE", 1000), ("FREQUENT_CHUNKS", 10**6)):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(41, families=4)
    found = jaccard.documents_sets(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5)
    assert found.filter("size(frequent) > 10").count() > 0
    assert rows_of(groups(spark, docs)) == slow_groups(docs)


def test_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_jaccard(spark, SF)) == slow_groups(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [
        (4, None), (3, ""), (None, "a b c d e"), (7, "A B\tC D E"), (7, "a b c d e"), (8, long), (9, long + " end"), (None, " \n "), (1, "one"), (2, "ONE"),
        (5, "one two"), (6, None), (10, "a b c d e a b c d e"), (None, "alone x y z w v"), (11, "É a b c d"), (12, "é a b c d"),
    ]
    assert rows_of(groups(spark, docs)) == slow_groups(docs)
    table = spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in docs], "doc_id long, text string, sid int, n string, `a.b` double")
    assert rows_of(jaccard.jaccard_groups(table)) == slow_groups(docs)
    assert jaccard.jaccard_groups(table.limit(0)).collect() == []


def joined(pairs):
    """The groups that pairs tie together."""
    groups = []
    for a, b in pairs:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [{a, b}.union(*hit)]
    return sorted(map(sorted, groups))


def shared(tokens):
    out = np.zeros(len(tokens), jaccard.SHARED)
    out["token"], out["df"] = tokens, 2
    return out


def test_near_copies_have_the_text_they_come_from_as_centre():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(2**62, 300, replace=False).astype(np.uint64))
    copies = [np.unique(np.concatenate([np.delete(base, rng.choice(300, 15)), rng.choice(2**62, 15).astype(np.uint64)])) for _ in range(40)]
    classes = jaccard.make_classes([(i, len(c), shared(c)) for i, c in enumerate(copies)])
    assert [len(c["sids"]) for c in classes] == [40] and (classes[0]["shared"]["token"] == base).all()
    assert 0.05 < classes[0]["radius"] < 0.15


def test_links_derived_from_a_centre_are_those_of_the_sets():
    rng = np.random.default_rng(1)
    base = [rng.choice(2**62, 200, replace=False).astype(np.uint64) for _ in range(2)]
    base[1][:150] = base[0][:150]

    def member(tokens):
        return np.unique(np.concatenate([tokens[rng.random(200) > 0.06], rng.choice(2**62, rng.integers(0, 12)).astype(np.uint64)]))

    sets = [[(10 * k + i, 0, member(base[k])) for i in range(9)] for k in (0, 1)]
    sets = [[(s, len(t), shared(t)) for s, _, t in own] for own in sets]
    for x in jaccard.make_classes(sets[0]):
        for z in jaccard.make_classes(sets[1]) + jaccard.make_classes(sets[0]):
            classes = [jaccard._class({"tokens": c["shared"]["token"].tobytes(), "n": c["n"], "ns": c["ns"], **{
                n: np.sort(np.concatenate([np.zeros(0, jaccard.DELTA), *c[n]]), order=("token", "member")).tobytes() for n in ("gone", "come")
            }}) for c in (x, z)]
            by_id = {s: set(t["token"].tolist()) for own in sets for s, _, t in own}
            itself = x["sids"] == z["sids"]
            into, back, ties = jaccard.derived_links(*classes, 60, itself=itself)
            linked = [[a != b and 100 * len(by_id[a] & by_id[b]) >= 60 * len(by_id[a] | by_id[b]) for b in z["sids"]] for a in x["sids"]]
            assert into.tolist() == [sum(r) for r in linked] and back.tolist() == [sum(c) for c in zip(*linked)]
            names = x["sids"] if itself else x["sids"] + z["sids"]
            want = joined([(a, b) for a, r in zip(x["sids"], linked) for b, yes in zip(z["sids"], r) if yes])
            assert joined([(names[i], names[j]) for i, j in ties]) == want


def test_skipped_blocks_hold_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(20):
        k = int(rng.integers(2, 400))
        n = rng.integers(1, 60, k)
        rest, radius = np.ceil(n * rng.random(k)).astype(np.int64), rng.random(k) * 0.13
        left, right = np.arange(0, k // 2), np.arange(k // 2, k)
        x, y = jaccard.list_pairs(n, rest, radius, left, right, 80)
        want = {(a, b) for a in left for b in right if jaccard._may_link(n[a], rest[a], radius[a], n[b], rest[b], radius[b], 80)}
        assert set(zip(x.tolist(), y.tolist())) == want
