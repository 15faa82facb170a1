"""Line deduplication: lines equal or one edit apart, by their deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloudtally.llm.shared import saved, small_batches

#: Variants a Python worker gives out together, about.
ROWS = 50_000
#: Up to so many candidate lines, their hashes (16 bytes each) are broadcast to find their texts; beyond, Spark joins by shuffle.
BROADCAST_LINES = 1_000_000
WHOLE = -1
# A variant's hash is the pair of its polynomial hashes to these moduli, both below 2**31.
_PRIMES = (2147483647, 2147483629)
_BASES = (911382323, 972663749)


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    filled = 1
    while filled < n:  # double what is there
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * pow(base, filled, prime) % prime
        filled += take
    return out


class _Hasher:
    def __init__(self) -> None:
        self.powers = [np.ones(1, np.int64) for _ in _BASES]

    def __call__(self, line: str) -> np.ndarray:
        """Hash of the line, then of the line without its first, second ... last character."""
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        n, out = len(points), np.zeros(len(points) + 1, np.int64)
        for i, (base, prime) in enumerate(zip(_BASES, _PRIMES)):
            if len(self.powers[i]) < n:
                self.powers[i] = _powers(2 * n, base, prime)
            sums = np.concatenate([[0], np.cumsum(points * self.powers[i][:n] % prime)])
            # What stands behind the deletion moves one place down.
            without = (sums[:-1] + (sums[-1] - sums[1:]) % prime * pow(base, -1, prime)) % prime
            out = (out << 31) | np.concatenate([[sums[-1] % prime], without])
        return out


VARIANT = "variant long, length int, place int, line struct<h1:bigint,h2:bigint>, first struct<no_id:boolean,id:bigint,text:bigint,nr:int>"


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's own hash, and the hashes of all lines with one character less, by the place of the deletion."""
    hasher = _Hasher()
    for batch in batches:
        hashes: list[np.ndarray] = []
        first = size = 0
        lines = batch.column("text").to_pylist()
        for i, line in enumerate(lines):
            hashes.append(hasher(line))
            size += len(hashes[-1])
            if size < ROWS and i + 1 < len(lines):
                continue
            counts = np.array([len(h) for h in hashes])
            every, ends = np.concatenate(hashes), np.cumsum(counts)
            # A single line may have any number of variants, so they are given out in slices.
            for at in range(0, size, ROWS):
                nth = np.arange(at, min(at + ROWS, size))
                own = np.searchsorted(ends, nth, side="right")
                place = nth - (ends - counts)[own] + WHOLE
                row = pa.array(first + own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every[at : at + ROWS]),
                        pa.array((counts[own] - 1 - (place > WHOLE)).astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                        batch.column("line").take(row),
                        batch.column("first").take(row),
                    ],
                    names=["variant", "length", "place", "line", "first"],
                )
            hashes, first, size = [], i + 1, 0


def _half_keys(line: Column) -> Column:
    """Hashes of the halves that a line shares with any line one edit away.

    Of two such lines, the shorter of n characters (or either), the edit leaves
    the first n/2 characters or the last n - n/2 alone. The length of the other
    is not known, so a line gives the halves for its own length and for one less.
    """
    n = F.char_length(line)

    def halves(m: Column) -> list[Column]:
        front = F.floor(m / 2).cast("int")
        return [
            F.xxhash64(F.lit("front"), front, F.substring(line, F.lit(1), front)),
            F.xxhash64(F.lit("back"), m - front, F.substring(line, n - (m - front) + 1, m - front)),
        ]

    return F.array_distinct(F.array(*halves(n), *halves(F.greatest(n - 1, F.lit(0)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each line kept only where it comes first, and n_lines and n_dropped.

    A line (between ``\\n``) is dropped if an equal line, or one within one
    edit (a character inserted, deleted or replaced), occurs earlier: in a
    document of smaller id, or before it in its own. Lines of white space are
    left alone. The first line of a kind stays, so a text loses repetitions
    only; no document is dropped, and one of repetitions only becomes empty.

    Null texts stay null, with no lines. Null ids come last; documents of one
    id go by the hash of their texts, and rows that repeat id and text are the
    same document and come back alike. Columns n_lines and n_dropped are
    replaced, all others pass through. An empty table gives no rows.

    Lines that share a half of theirs with a different line are the candidates;
    no line without one can have a neighbour. Each gives its own hash and those
    of all lines with one character less. Equal hashes at the same place are
    one replacement apart, all of them from each other; a line's own hash among
    another's variants is one insertion apart. So everything is compared with
    the earliest of its kind, never pair by pair, and then checked by edit
    distance. Lines are told apart by 128-bit hashes; texts move once, to be
    put together again.
    """
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("string").alias("all"))
    lines = rows.select("id", "hash", F.posexplode(F.split("all", "\n")).alias("nr", "text")).filter(F.col("text").rlike(r"\S"))
    occurrences = lines.select(
        F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("hash").alias("text"), "nr").alias("at"),
        F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).alias("line"),
        "text",
    )
    firsts = saved(
        occurrences.select("line", "at", _half_keys(F.col("text")).alias("halves"))
        .groupBy("line").agg(F.min("at").alias("first"), F.first("halves").alias("halves")),
        "line-firsts",
    )
    halves = firsts.select(F.col("line.h1").alias("h1"), "line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("half")
    near = halves.join(shared, "half", "left_semi").select("line").distinct()
    candidates = saved(firsts.join(near, "line", "left_semi").select("line", "first"), "line-candidates")
    few = candidates.count() <= BROADCAST_LINES
    # Only the first occurrence of a candidate is looked for.
    texts = saved(
        occurrences.join(F.broadcast(candidates) if few else candidates, "line").filter(F.col("at") == F.col("first"))
        .select("line", "first", "text").dropDuplicates(["line"]),
        "line-texts",
    )
    variants = small_batches(texts).mapInArrow(_variants, VARIANT)

    # One replacement apart: all lines of a hash and place. A group has one line per character at most.
    place = W.partitionBy("variant", "length", "place")
    cuts = variants.filter(F.col("place") > WHOLE)
    replaced = cuts.withColumn("best", F.min(F.struct("first", "line")).over(place)).filter("line <> best.line").select("line", F.col("best.line").alias("other"))
    # One insertion apart: a whole line among another's variants; the later of the two goes.
    whole = variants.filter(F.col("place") == WHOLE).select("variant", "length", F.col("line").alias("short"), F.col("first").alias("short_first"))
    inserted = cuts.join(whole, ["variant", "length"]).select(
        F.when(F.col("short_first") < F.col("first"), F.col("line")).otherwise(F.col("short")).alias("line"),
        F.when(F.col("short_first") < F.col("first"), F.col("short")).otherwise(F.col("line")).alias("other"),
    )
    # The shortest of many longer lines is compared with each; the earliest of them decides whether it goes.
    pairs = replaced.unionByName(inserted).distinct()
    text_of = texts.select("line", F.col("text").alias("a"))
    other_of = texts.select(F.col("line").alias("other"), F.col("text").alias("b"))
    checked = pairs.join(text_of, "line").join(other_of, "other").filter(F.levenshtein("a", "b", 1).isin(0, 1))
    gone = saved(checked.select("line").distinct(), "line-gone").withColumn("near", F.lit(True))

    verdict = firsts.select("line", "first").join(gone, "line", "left")
    dropped = (
        occurrences.select("line", "at").join(verdict, "line").filter(F.col("near").isNotNull() | (F.col("at") != F.col("first")))
        .groupBy(F.col("at.id").alias("drop_id"), F.col("at.text").alias("drop_hash")).agg(F.collect_set("at.nr").alias("drop"))
    )
    whole_rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    split = F.split(F.col(f"row.{text_col}").cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop"))
    told = whole_rows.join(dropped, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("hash") == F.col("drop_hash")), "left")
    cleaned = F.when(F.col("drop").isNull(), F.col(f"row.{text_col}").cast("string")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    )
    return told.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns],
        F.when(F.col(f"row.{text_col}").isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"),
    )
