"""Language identification: TF-IDF character n-grams, multinomial logistic regression by FTRL, calibrated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloudtally.llm.shared import chunks, crc32_bucket, saved, small_batches

UNKNOWN = "und"
#: Hashed features: 1- to 3-grams of letters, all other characters counting as one blank.
FEATURES = 1 << 17
ORDERS = (1, 2, 3)
#: Code points looked at together; a longer text goes through in several pieces.
PIECE = 1 << 19
_BLANK = 32
# Multiplicative hashing: an odd 64-bit constant per n-gram length.
_MIX = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0xD6E8FEB86659FD93}
#: Frequencies are shares of a text; this puts them on the scale the learning rate is made for.
_SCALE = 100.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # features x languages, times idf
    bias: np.ndarray
    temperature: float


# Filled at first use in each process: whether a code point is a letter.
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) of every n-gram, piece by piece."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    points = np.where(_letters()[points], points, np.uint32(_BLANK))
    run = np.ones(len(points), bool)
    run[1:] = (points[1:] != _BLANK) | (points[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    points, owner = points[run].astype(np.uint64), owner[run]
    reach = max(ORDERS) - 1
    for first in range(0, len(points), PIECE):
        part, own = points[first : first + PIECE + reach], owner[first : first + PIECE + reach]
        packed = np.zeros(len(part), np.uint64)
        for n in ORDERS:
            stop = len(part) - n + 1
            if stop <= 0:
                break
            packed = (packed[:stop] << np.uint64(21)) | part[n - 1 :]
            use = min(stop, PIECE)
            key = packed[:use]
            inside = own[:use] == own[n - 1 : n - 1 + use]
            feature = ((key * np.uint64(_MIX[n])) >> np.uint64(47)).astype(np.int64)
            if n > 1:
                yield own[:use][inside], feature[inside]
            else:
                full = key != _BLANK
                yield own[:use][full], feature[full]


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total, docs = np.zeros(FEATURES, bool), np.zeros(FEATURES, np.int64), 0
    for batch in chunks(batches):
        texts = _texts(batch, "text")
        docs += len(texts)
        found = [[] for _ in texts]
        for own, feature in _grams(texts):
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
                found[own[s]].append(feature[s:e])
        for features in found:
            for f in features:
                seen[f] = True
            total += seen
            for f in features:
                seen[f] = False
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], names=["feature", "docs"]
    )


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = _texts(batch, "text")
            pairs = [np.zeros(0, np.int64)]
            for own, feature in _grams(texts):
                pairs.append(own * FEATURES + feature)
            key, count = np.unique(np.concatenate(pairs), return_counts=True)
            own, feature = np.divmod(key, FEATURES)
            cuts = np.searchsorted(own, np.arange(len(texts) + 1))
            rows = []
            for i in range(len(texts)):
                f, c = feature[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
                value = _SCALE * c / max(1, c.sum()) * idf[f]
                rows.append((f.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rank"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["lang", "rank", "feature", "value"],
            )

    return run


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-proximally-regularised-leader, one example at a time.

    Each coordinate has its own learning rate; ``l1`` keeps a weight at zero
    until its gradients add up to more than that, ``l2`` shrinks it.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    bias = np.array([FEATURES])

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for feature, value, label in examples:
            at = np.concatenate([feature, bias])
            x = np.append(value, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which the held-back examples are most likely, by golden-section search on its logarithm.

    The logarithm has a standard normal prior: a few examples that are all
    told right would else drive the temperature to the end of the search.
    """
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).sum() + log_t**2 / 2)

    low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    for _ in range(40):
        if loss(a) <= loss(b):
            high, a, b = b, b - golden * (b - low), a
        else:
            low, a, b = a, b, a + golden * (high - a)
    return float(np.exp((low + high) / 2))


def calibrating(rows: int, fit_rows: int, calibrate_rows: int) -> int:
    """How many of a language's sampled rows calibrate: the same share at every size, and one at least where there are two."""
    return max(round(rows * calibrate_rows / (fit_rows + calibrate_rows)), int(rows > 1 and calibrate_rows > 0))


def _train(fit_rows: int, calibrate_rows: int):
    """All sampled examples in, non-zero weights out; the last feature is the bias, and -1 the temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        # The same order everywhere, languages in turn.
        rows.sort(key=lambda r: (r["rank"], r["lang"]))
        names = sorted({r["lang"] for r in rows})
        examples = [
            (np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), names.index(r["lang"])) for r in rows
        ]
        sampled = Counter(r["lang"] for r in rows)
        fitting = {name: n - calibrating(n, fit_rows, calibrate_rows) for name, n in sampled.items()}
        first = [e for e, r in zip(examples, rows) if r["rank"] <= fitting[r["lang"]]]
        rest = [e for e, r in zip(examples, rows) if r["rank"] > fitting[r["lang"]]]
        w, bias = fit_ftrl(first, len(names))
        logits = np.array([v @ w[f] + bias for f, v, _ in rest]).reshape(len(rest), len(names))
        temperature = fit_temperature(logits, np.array([y for *_, y in rest], np.int64))
        used = np.flatnonzero(w.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*used.tolist(), FEATURES, -1], pa.int64()),
                pa.array([*w[used].tolist(), bias.tolist(), [temperature]], pa.list_(pa.float64())),
                pa.array([None] * (len(used) + 1) + [names], pa.list_(pa.string())),
            ],
            names=["feature", "weights", "languages"],
        )

    return run


def train(
    docs: DataFrame, fit_rows: int = 3000, calibrate_rows: int = 500, sample_rows: int = 70_000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """A model from the labelled rows of ``docs``.

    Document frequencies count every row given. The regression learns from a
    bounded sample, of each language the ``fit_rows + calibrate_rows`` rows
    whose ids hash lowest, and its temperature from the last of them: from
    ``calibrate_rows`` of a whole sample and the same share of a smaller one,
    at least one row where there are two. Whole texts in both. All languages
    together have about ``sample_rows`` rows, as one task holds their vectors:
    with more than twenty languages each has fewer, in the same shares. Rows without id, text or language are left out, an id that repeats
    counts once. Without any labelled row the model knows no language.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counted = small_batches(rows.select("text")).mapInArrow(_document_frequency, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
    idf, n = np.zeros(FEATURES), 0
    found = {r["feature"]: r["docs"] for r in counted.collect()}  # as many rows as there are features, at most
    n = found.pop(-1, 0)
    if not n:
        return Model((), np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    idf[list(found)] = [np.log((1 + n) / (1 + d)) + 1 for d in found.values()]

    # Twenty languages have room for whole samples.
    languages = rows.select("lang").distinct().count()
    room = min(1.0, sample_rows / (languages * (fit_rows + calibrate_rows)))
    fit_rows, calibrate_rows = max(1, int(fit_rows * room)), int(calibrate_rows * room)
    chosen = (
        rows.select("id", "lang").distinct()
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
        .filter(F.col("rank") <= fit_rows + calibrate_rows)
    )
    # At most fit_rows + calibrate_rows ids per language.
    sample = rows.join(F.broadcast(saved(chosen, "language-sample")), ["id", "lang"]).dropDuplicates(["id", "lang"])
    vectors = sample.select("lang", "rank", "text").mapInArrow(_vectors(idf), "lang string, rank int, feature binary, value binary")
    fitted = vectors.repartition(1).mapInArrow(_train(fit_rows, calibrate_rows), "feature long, weights array<double>, languages array<string>").collect()
    by_feature = {r["feature"]: r for r in fitted}
    end = by_feature.pop(-1)
    bias = np.array(by_feature.pop(FEATURES)["weights"])
    weights = np.zeros((FEATURES, len(end["languages"])), np.float32)
    for f, r in by_feature.items():
        weights[f] = np.array(r["weights"]) * idf[f] * _SCALE
    return Model(tuple(end["languages"]), weights, bias, float(end["weights"][0]))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    full = [t or "" for t in texts]
    sums, counts = np.zeros((len(full), len(model.languages))), np.zeros(len(full))
    for own, feature in _grams(full):
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        if len(starts):
            whose = own[starts]
            sums[whose] += np.add.reduceat(model.weights[feature], starts, axis=0, dtype=np.float64)
            counts[whose] += np.diff(starts, append=len(own))
    letters = [any(c.isalpha() for c in t) for t in full]
    if not model.languages:
        return [UNKNOWN] * len(full), [0.0] * len(full)
    share = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
    best = share.argmax(axis=1)
    score = share[np.arange(len(full)), best]
    return (
        [model.languages[b] if l else UNKNOWN for b, l in zip(best, letters)],
        [float(s) if l else 0.0 for s, l in zip(score, letters)],
    )


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, read off the whole text and nothing else.

    ``lang_pred`` is a learned language; ``und`` with score 0 where the text is
    null, empty or without a letter, or no language was learned. ``score`` is
    the calibrated probability. Every row stays, repeats included; columns of
    the two names are replaced.
    """

    # Only texts go to Python and only verdicts come back, so the other columns stay where they are.
    @F.arrow_udf("lang_pred string, score double")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for piece in chunks(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
                langs, scores = predict(piece.column("text").to_pylist(), model)
                parts.append(pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    rows = small_batches(docs.drop("lang_pred", "score"))
    verdict = told(rows[_quoted(text_col)].cast("string"))
    kept = [rows[_quoted(c)] for c in rows.columns]
    both = rows.select(F.struct(*kept).alias("row"), verdict.alias("told"))
    return both.select("row.*", "told.lang_pred", "told.score")


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def held_out(id_col: str = "doc_id", modulus: int = 4, value: int = 2):
    return crc32_bucket(id_col, modulus) == value
