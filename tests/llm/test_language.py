"""Language identification: held-out accuracy, and the parts it is made of."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudtally.llm import language, queries

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op7_language(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(got) == len(rows) and len(held) > 20
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_grams_in_pieces(monkeypatch):
    texts = ["Ünë  two 3!", "", "a", "xyz " * 50]
    whole = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*language._grams(texts)))))
    monkeypatch.setattr(language, "PIECE", 7)
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*language._grams(texts))))) == whole
    assert {own for own, _ in whole} == {0, 2, 3}


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    examples = []
    for i in range(600):
        label = i % 3
        noise = rng.choice(np.arange(100, 2000), 10, replace=False)
        examples.append((np.concatenate([[label], noise]).astype(np.int64), np.ones(11), label))
    weights, bias = language.fit_ftrl(examples, 3, l1=1.0)
    assert (weights[:3].argmax(axis=1) == np.arange(3)).all()
    assert (weights != 0).any(axis=1).sum() < 300


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language.fit_temperature(logits * 5, labels) - 5) < 0.5
    assert language.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_few_right_examples_do_not_make_scores_certain():
    assert 0.5 < language.fit_temperature(np.eye(3)[[0, 1, 2] * 3] * 12, np.array([0, 1, 2] * 3)) < 1.0


def test_every_language_calibrates_at_every_size(spark, monkeypatch):
    held = []
    monkeypatch.setattr(language, "fit_temperature", lambda logits, labels: held.append(np.bincount(labels, minlength=4).tolist()) or 2.0)
    for sizes, want in (((40, 14, 2, 1), [6, 2, 1, 0]), ((3500, 300, 7, 2), [500, 43, 1, 1])):
        rows = [
            {"lang": lang, "rank": k + 1, "feature": np.array([i], np.int32).tobytes(), "value": np.ones(1, np.float32).tobytes()}
            for i, (lang, n) in enumerate(zip(("de", "en", "es", "fr"), sizes)) for k in range(n)
        ]
        end = [b for b in language._train(3000, 500)(iter([pa.RecordBatch.from_pylist(rows)]))][0].to_pylist()[-1]
        assert held.pop() == want and end["weights"] == [2.0] and end["languages"] == ["de", "en", "es", "fr"]
    monkeypatch.undo()
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.train(rows).temperature != 1.0


def test_odd_rows(spark):
    en, de = "the cat and the dog with their thing ", "der Hund und die Katze über das Ding "
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(40, None, "en", 1), (41, "", None, 1), (None, en, "en", 1), (3, en, "en", 1), (42, "12 !? 34", "de", 1), (43, en * 4000, None, 1), (44, en, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.train(docs, fit_rows=10, calibrate_rows=5)
    assert model.languages == ("de", "en")
    got = language.classify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == len(rows)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by_id[40] == by_id[41] == by_id[42] == ("und", 0.0)
    assert by_id[43][0] == by_id[44][0] == "en" and by_id[2][0] == "de"
    assert language.classify(docs.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert language.classify(docs, model).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_held_out_is_by_crc(spark):
    import zlib

    got = spark.range(50).select("id", language.held_out("id").alias("h"), F.lit(1)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# --- the whole of it once more, with dictionaries, one text and one number at a time ---


def plain_grams(text):
    """Counts of hashed 1- to 3-grams: letters, and one blank for each run of anything else."""
    out, marks = Counter(), []
    for c in f" {(text or '').lower()} ":
        c = c if c.isalpha() else " "
        if c != " " or not marks or marks[-1] != " ":
            marks.append(c)
    for n in (1, 2, 3):
        for i in range(len(marks) - n + 1):
            key = 0
            for c in marks[i : i + n]:
                key = (key << 21 | ord(c)) % 2**64
            if n > 1 or marks[i] != " ":
                out[(key * language._MIX[n] % 2**64) >> 47] += 1
    return out


def plain_softmax(x):
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def plain_ftrl(examples, classes, epochs=3, alpha=0.3, beta=1.0, l1=0.02, l2=0.1):
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[key]) - z[key]) / ((beta + math.sqrt(n[key])) / alpha + l2)

    for _ in range(epochs):
        for vector, label in examples:
            vector = {**vector, "bias": 1.0}
            w = {(f, c): weight((f, c)) for f in vector for c in range(classes)}
            p = plain_softmax([sum(x * w[f, c] for f, x in vector.items()) for c in range(classes)])
            for f, x in vector.items():
                for c in range(classes):
                    g, key = x * (p[c] - (c == label)), (f, c)
                    old = n.get(key, 0.0)
                    n[key] = old + g * g
                    z[key] = z.get(key, 0.0) + g - (math.sqrt(n[key]) - math.sqrt(old)) / alpha * w[key]
    return weight


def plain_classifier(rows, order, fit_rows, calibrate_rows):
    """rows: (id, text, lang) to learn from; ``order`` gives a row's place in the sample. A function from text to (language, score)."""
    counts = [plain_grams(t) for _, t, _ in rows]
    seen = Counter(f for c in counts for f in c)
    idf = {f: math.log((1 + len(rows)) / (1 + d)) + 1 for f, d in seen.items()}
    names = sorted({lang for *_, lang in rows})
    ranked = []
    for name in names:
        own = sorted((i for i, r in enumerate(rows) if r[2] == name), key=lambda i: order(rows[i][0]))[: fit_rows + calibrate_rows]
        hold = language.calibrating(len(own), fit_rows, calibrate_rows)
        ranked += [(rank, name, i, rank < len(own) - hold) for rank, i in enumerate(own)]
    ranked.sort(key=lambda r: r[:2])
    vector = lambda c: {f: 100.0 * k / max(1, sum(c.values())) * idf.get(f, 0.0) for f, k in c.items()}
    weight = plain_ftrl([(vector(counts[i]), names.index(lang)) for _, lang, i, fits in ranked if fits], len(names))
    logits = lambda c: [sum(x * weight((f, k)) for f, x in vector(c).items()) + weight(("bias", k)) for k in range(len(names))]
    rest = [(logits(counts[i]), names.index(lang)) for _, lang, i, fits in ranked if not fits]

    def loss(log_t):
        return sum(-math.log(plain_softmax([x / math.exp(log_t) for x in at])[label]) for at, label in rest) + log_t**2 / 2

    low, high = math.log(0.05), math.log(20.0)
    for _ in range(100):  # thirds instead of golden sections
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    heat = math.exp((low + high) / 2) if rest else 1.0

    def tell(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        p = plain_softmax([x / heat for x in logits(plain_grams(text))])
        return names[p.index(max(p))], max(p)

    return tell


@pytest.mark.parametrize("fit_rows", [6, 40])
def test_as_told_with_dictionaries(spark, fit_rows):
    rng = random.Random(fit_rows)
    sounds = {"en": "th e an ing wh sh ed of", "de": "sch ei der ung ü ch en st", "fr": "eau qu é oi les ai ou x"}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 12)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(list(sounds), [6, 3, 2], k=70))]
    asked = [(100 + i, rng.choice([text(rng.choice(list(sounds))), "Où? ÜBER the 12", "x", "!!", "", None, "日本 der"])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    place = {r["doc_id"]: r["h"] for r in table.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    model = language.train(table, fit_rows=fit_rows, calibrate_rows=5)
    tell = plain_classifier(rows, lambda i: (place[i], i), fit_rows, 5)
    got = language.classify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert len({r["lang_pred"] for r in got}) == 4
    for r in got:
        want = tell(r["text"])
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=2e-4), r["text"]


def test_columns_with_dots_and_of_the_same_names(spark):
    docs = spark.createDataFrame([(i, "the cat " * 3 if i % 2 else "der Hund " * 3, "en" if i % 2 else "de", i, "y") for i in range(20)],
                                 "doc_id long, text string, lang string, `a.b` int, told string")
    got = language.classify(docs, language.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "a.b", "told", "lang_pred", "score"]
    assert all(r["lang_pred"] == r["lang"] and r["a.b"] == r["doc_id"] and r["told"] == "y" for r in got.collect())


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10] * 3} word", f"l{i % 10}") for i in range(400)], "doc_id long, text string, lang string")
    whole = language.train(docs, fit_rows=30, calibrate_rows=5, sample_rows=10**6)
    small = language.train(docs, fit_rows=30, calibrate_rows=5, sample_rows=70)
    assert len(whole.languages) == len(small.languages) == 10
    assert not np.allclose(small.weights, whole.weights)
