"""License scans against shingle sets of every text and template."""

import random
import re

import pytest

from cloudtally.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def slow(rows, templates=licenses.TEMPLATES):
    sets = [shingles(t) for _, t in templates]
    return {
        (doc, i, len(s & have), len(s)) for doc, text in rows for have in [shingles(text)] for i, s in enumerate(sets) if s and len(s & have) >= 0.8 * len(s)
    }


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    return [(r["doc_id"], r["template"], r["matched"], r["shingles"]) for r in licenses.scan_licenses(docs, **how).collect()]


def test_bands():
    for s in (0.3, 0.5, 0.8):
        assert 1 - (1 - s**2) ** licenses.bands_for(s, 0.999) >= 0.999


def test_edited_licenses_in_long_texts(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        name, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(k % 3 * len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        filler = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 400))]
        cut = rng.randint(0, len(filler))
        rows.append((k, " ".join(filler[:cut]) + "\n * " + " ".join(words) + ".\n" + " ".join(filler[cut:])))
    got, want = found(spark, rows), slow(rows)
    assert {g[:2] for g in got} <= {w[:2] for w in want} and len(got) == len(set(got))
    assert len({g[:2] for g in got}) >= 0.98 * len(want)


def test_odd_rows(spark):
    notice = licenses.TEMPLATES[0][1]
    rows = [(1, None), (2, ""), (3, "two words"), (None, notice), (4, notice), (4, notice), (5, "word " * 20_000 + notice), (6, notice.upper())]
    got = found(spark, rows)
    assert sorted((d or 0, t) for d, t, *_ in got) == [(0, 0), (4, 0), (4, 0), (5, 0), (6, 0)]
    assert found(spark, []) == [] and found(spark, rows, templates=[]) == [] and found(spark, rows, templates=[("x", "too short")]) == []


def test_too_many_templates_are_refused(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_SHINGLES", 3)
    with pytest.raises(ValueError):
        found(spark, [(1, "x")])


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r["doc_id"], r["template"], r["matched"], r["shingles"]) for r in queries.op8_licenses(spark, SF).collect()}
    assert got == slow(rows)


def test_template_shingles_of_a_text_are_sought_once(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(h" in plan and "array_contains(array_intersect" not in plan
