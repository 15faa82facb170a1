"""Context-tree weighting against a tree of dictionaries, and the word model against counters."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudtally.llm import scoring

ROWS = [
    (1, "The cat sat on the mat. The cat sat."), (2, "THE DOG sat on the Log\tand the cat"), (3, "über die Brücke und über den Fluß"),
    (4, ""), (5, None), (6, "the cat sat on the mat"), (7, "zzz qqq the"), (8, "word " * 4000), (6, "the cat sat on the mat"), (None, "no id the cat"),
]


class SlowTree:
    """Every context of every length as a dictionary entry; weights worked out by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.longer = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, bits, bit in self.steps(text):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], bits][bit] += 1
                    if d < depth:
                        self.longer[context[depth - d :], bits].add(context[depth - d - 1 :])
        self.memo = {}

    def steps(self, text):
        data = bytes([255]) * self.depth + text + bytes([255])
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield data[i - self.depth : i], (k, data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    def own(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weight(self, node):
        """Log weighted probability, and the log of the children's product."""
        if node not in self.memo:
            context, bits = node
            if len(context) == self.depth:
                self.memo[node] = (self.own(node), None)
            else:
                below = sum(self.weight((c, bits))[0] for c in self.longer[node])
                self.memo[node] = (np.logaddexp(self.own(node), below) - math.log(2), below)
        return self.memo[node]

    def score(self, text):
        total = 0.0
        for context, bits, bit in self.steps(text):
            p = None
            for d in range(self.depth, -1, -1):
                node = (context[self.depth - d :], bits)
                seen = sum(self.counts[node]) if node in self.counts else 0
                mine = (self.counts[node][bit] + 0.5) / (seen + 1) if seen else 0.5
                if p is None or not deeper:
                    p = mine
                elif seen:
                    share = math.exp(self.own(node) - math.log(2) - self.weight(node)[0])
                    p = share * mine + (1 - share) * p
                deeper = seen
            total += math.log10(p)
        return total


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("depth", [2, 5])
def test_against_a_tree_of_dictionaries(spark, monkeypatch, depth):
    monkeypatch.setattr(scoring, "DEPTH", depth)
    monkeypatch.setattr(scoring, "BATCH_BYTES", 8_000)
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, score int")
    got = scoring.score_texts(docs, F.col("doc_id") % 3 != 0).collect()
    train = [low(t) for d, t in ROWS if d is not None and d % 3]
    tree = SlowTree([t.encode() for t in train], depth)
    counts = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc, text in ROWS:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want.append((doc or 0, len(words), sum(counts[w] > 0 for w in words), n, round(base, 4), round(tree.score(low(text).encode()), 1)))
    found = [(r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 1)) for r in got]
    assert sorted(found) == sorted(want)
    assert {r["bytes"] for r in got if r["doc_id"] in (4, 5)} == {1}


def test_probabilities_of_the_next_byte_add_up_to_one(monkeypatch):
    monkeypatch.setattr(scoring, "DEPTH", 3)
    rng = np.random.default_rng(1)
    seen = rng.integers(97, 100, (200, 4))
    context = np.concatenate([np.repeat([[97, 98, 99]], 256, 0), np.repeat([[1, 2, 98]], 256, 0)])
    keys = np.concatenate([seen, np.column_stack([context, np.tile(np.arange(256), 2)])])
    packed = sum(keys[:, k].astype(np.int64) << 8 * (3 - k) for k in range(4))
    names, place = np.unique(packed, return_inverse=True)
    n = np.bincount(place, np.arange(len(packed)) < 200).astype(float)
    total = np.ones(len(names))
    for _, _, p, _ in scoring.lower_tree(names, n):
        total *= p
    for some in (slice(200, 456), slice(456, None)):
        assert abs(total[place[some]].sum() - 1) < 1e-9


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score_texts(docs, F.lit(False)).collect()}
    assert abs(got[1]["score"] - 3 * 8 * math.log10(0.5)) < 1e-6 and got[1]["n_known"] == 0 and got[1]["base_score"] == 0.0
    assert scoring.score_texts(docs.limit(0), F.lit(True)).collect() == []
