"""Token ids of whole texts, written in coded blocks in id order, and read back."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloudtally.llm.idcoder import decode, encode
from cloudtally.llm.shared import CHUNK_BYTES, chunks, give_back, small_batches

#: Ids of a shard: one row of the table, one container of blocks. A document is not split, so a shard may be longer.
SHARD_IDS = 1 << 21
#: Text bytes a partition of the output is meant to hold.
PARTITION_BYTES = 48 << 20
#: Pieces of words whose ids a Python worker remembers; only saves time.
REMEMBERED = 1 << 19


# Kept by the process: tokenizers by file, and the ids of the words met.
_TOKENIZERS: dict = {}
_KNOWN: dict[str, _Words] = {}


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _byte_letters() -> list[str]:
    """How byte-level vocabularies spell each byte: itself if printable in Latin-1, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_SPELLED = _byte_letters()
# Punctuation between a small letter and white space; a boundary for the vocabulary, so it can stand alone. Not so
# behind letters whose normal form ends in a mark, so only letters that are their own normal form are listed.
_TAIL = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([!-/:-@\[-`{-~]+)(\s|$)"
# Texts that are taken as they are: with what may be a special token, or with a character from the first combining mark
# on, since a letter and its marks may become one character in one case only.
_AS_IT_IS = r"<\||[^\x00-\x{2FF}]"
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class _Words:
    """The ids of the words met: a number for each, and in one list after another the ids by number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ends, self.ids = array("q", [0]), array("I")


def _learn(words: np.ndarray, path: str) -> tuple[_Words, np.ndarray]:
    """Numbers of each word (all different), whose ids come from the tokenizer or from memory.

    A word here is a run between ASCII white space, which this vocabulary
    drops: a text's ids are those of its words, one after another. A word of
    plain small letters passes the tokenizer's normal form and splitting
    unchanged, and goes straight to its merges.
    """
    known = _KNOWN.setdefault(path, _Words())
    if len(known.numbers) > REMEMBERED:
        known = _KNOWN[path] = _Words()
    numbers, tokenizer = known.numbers, _tokenizer(path)
    merge, number_of, ids, ends, others = tokenizer.model.tokenize, attrgetter("id"), known.ids, known.ends, []
    found = list(map(numbers.get, words))
    for place in [i for i, number in enumerate(found) if number is None]:
        word = words[place]
        if word.isascii() and word.isalpha() and word.islower():
            ids.extend(map(number_of, merge(word)))
        elif _LATIN.fullmatch(word):
            ids.extend(map(number_of, merge("".join([_SPELLED[b] for b in word.encode()]))))
        else:
            others.append(place)
            continue
        found[place] = numbers[word] = len(numbers)
        ends.append(len(ids))
    for first in range(0, len(others), 4096):
        some = others[first : first + 4096]
        for place, coded in zip(some, tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
            ids.extend(coded.ids)
            found[place] = numbers[words[place]] = len(numbers)
            ends.append(len(ids))
    return known, np.array(found, np.int32)


def tokenize(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by ``end``; ids of each text)."""
    texts = pc.fill_null(texts, "")
    # The vocabulary lowers case itself and knows the boundary; doing both first leaves fewer words. Each text is
    # decided on alone, so its ids are the same in any company.
    fewer = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3")
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _AS_IT_IS), texts, fewer))
    per_text = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    known, numbers = _learn(coded.dictionary.to_numpy(zero_copy_only=False), path)
    pool, bounds = np.array(known.ids, np.uint32), np.array(known.ends)
    pool = np.append(pool, np.uint32(end))  # the end is one more word behind each text
    starts = np.append(bounds.take(numbers), len(pool) - 1).astype(np.int32)
    sizes = np.append(bounds.take(numbers + 1), len(pool)).astype(np.int32) - starts
    places = np.insert(coded.indices.to_numpy(), np.cumsum(per_text), len(numbers))
    each = sizes.take(places)
    after = np.cumsum(each, dtype=np.int32)
    at = np.arange(after[-1] if len(each) else 0, dtype=np.int32)
    at += np.repeat(starts.take(places) - (after - each), each)
    ends = np.cumsum(per_text + 1) - 1
    return pool.take(at), np.diff(np.concatenate([[0], after.take(ends)]).astype(np.int64))


SHARD = "partition int, shard int, doc_ids array<long>, lengths array<long>, data binary"


def _write(path: str, end: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, shard = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = [], [], []
        size = 0

        def row() -> pa.RecordBatch:
            docs, lengths, ids = held
            joined = np.concatenate(ids)
            ids.clear()
            give_back()  # what the texts took, before the coder takes as much
            data = encode(joined, vocabulary)
            made = {"partition": [partition], "shard": [shard], "doc_ids": [docs], "lengths": [lengths], "data": [data]}
            kinds = {"partition": pa.int32(), "shard": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "data": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in made.items()], names=list(made))

        for batch in chunks(batches, size=4 * CHUNK_BYTES):
            ids, lengths = tokenize(batch.column("text"), path, end)
            docs, bounds = batch.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < len(docs):
                # as many documents as the shard has room for, one at least
                stop = int(np.searchsorted(bounds, bounds[first] + SHARD_IDS - size, side="right")) - 1
                stop = max(stop, first + (size == 0))
                held[0].extend(docs[first:stop])
                held[1].extend(lengths[first:stop].tolist())
                held[2].append(ids[bounds[first] : bounds[stop]])
                size += int(bounds[stop] - bounds[first])
                if stop < len(docs) or size >= SHARD_IDS:
                    yield row()
                    held, size, shard = ([], [], []), 0, shard + 1
                first = stop
        if held[0]:
            yield row()
        give_back()

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int = 1,
    id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None,
) -> None:
    """Writes the token ids of every whole text to a new table of shards at ``path``.

    ``tokenizer`` is the file of a vocabulary that drops white space and whose
    ids are below ``vocabulary``; executors read it. Special tokens are not
    added, ``end`` is put behind each text. Documents go by ``order``, by id
    unless given (null ids first, equal ones by their texts' hashes), across
    partitions, shards and rows. A shard is one row: its place (partition,
    shard), the documents' ids and lengths, and one container of coded blocks
    (see ``idcoder``), each of which is reset and checked on its own. Null texts
    count as empty; an empty table gives an empty one. Spark's own commit
    protocol writes, so a lost or repeated task leaves nothing behind.
    """
    order = order or [F.col(id_col), F.xxhash64(text_col)]
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(f"order{i}") for i, c in enumerate(order)])
    names = [f"order{i}" for i in range(len(order))]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // PARTITION_BYTES))
    sorted_rows = rows.repartitionByRange(tasks, *names).sortWithinPartitions(*names)
    sorted_rows.select("doc_id", "text").mapInArrow(_write(tokenizer, end, vocabulary), SHARD).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in a table of shards, read from its blocks.

    ``start`` counts the ids of all documents before. ``ids`` is null unless
    asked for. A damaged block is an error.
    """
    shards = spark.read.schema(SHARD).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = decode(row["data"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a shard's blocks do not hold its documents")
                raw, bounds = ids.astype("<u4").tobytes(), [0, *ends.tolist()]
                for first in range(0, len(lengths), 1000):
                    some = range(first, min(first + 1000, len(lengths)))
                    size = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["partition"]] * size, pa.int32()),
                            pa.array([row["shard"]] * size, pa.int32()),
                            pa.array([row["doc_ids"][j] for j in some], pa.int64()),
                            pa.array([bounds[j] for j in some], pa.int64()),
                            pa.array(lengths[first : first + size]),
                            pa.array([zlib.crc32(raw[4 * bounds[j] : 4 * bounds[j + 1]]) for j in some], pa.int64()),
                            pa.array([ids[bounds[j] : bounds[j + 1]] if with_ids else None for j in some], pa.list_(pa.int64())),
                        ],
                        names=["partition", "shard", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                    )
        give_back()

    read = shards.mapInArrow(
        run, "partition int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<long>"
    )
    # One row per shard: ids before it in its partition, and in the partitions before.
    sizes = shards.select("partition", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("partition").agg(F.sum("n").alias("n")).select("partition", earlier(W.orderBy("partition")).alias("part_start"))
    places = sizes.select("partition", "shard", earlier(W.partitionBy("partition").orderBy("shard")).alias("shard_start")).join(parts, "partition")
    return read.join(places, ["partition", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
