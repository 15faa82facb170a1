"""Records of CSV splits: where quotes are open, and lines put together.

These run on workers, over the lines of whole splits in order.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The helpers travel with the query, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
#: Records handed on together.
ROWS = 4096


def is_open(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line, given whether one is at its beginning."""
    at, length = 0, len(line)
    while at <= length:
        if inside:
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True
            at, inside = closed.end(), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        comma = line.find(",", at)
        # Between here and the next opening quote there are only plain values.
        quote = line.find(',"', at)
        if comma < 0 or quote < 0:
            return False
        at = quote + 1
    return False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], list[bool], pa.RecordBatch, int]]:
    """Runs of lines of one split: its key, the lines, which of them hold a quote, and where they stand."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.utf8_rtrim(batch.column("value"), characters="\r")
        quoted = pc.match_substring(text, '"').to_pylist()
        files, splits, lines = batch.column("file").to_pylist(), batch.column("split").to_pylist(), text.to_pylist()
        if splits[0] == 0:
            lines[0] = lines[0].removeprefix("\ufeff")
        first = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or splits[i] != splits[first] or files[i] != files[first]:
                yield (files[first], splits[first]), lines[first:i], quoted[first:i], batch, first
                first = i


def split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, outside, inside, closes): whether quotes are open at the end of a split that begins outside and inside
    of them, and whether one that begins inside comes to the end of that record."""
    ends: dict[tuple[str, int], list[bool]] = {}
    for key, lines, quoted, _, _ in _lines(batches):
        state = ends.setdefault(key, [False, True, False])
        for line, has in zip(lines, quoted):
            if has:
                state[0], state[1] = is_open(line, state[0]), is_open(line, state[1])
            state[2] |= not state[1]
    rows = [(f, s, *e) for (f, s), e in ends.items()]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "split", "outside", "inside", "closes"]
    )


def split_begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, open, start): whether a split begins inside quotes, and the split in which the record open there begins."""
    for batch in batches:
        rows = []
        for file, splits in zip(batch.column("file").to_pylist(), batch.column("splits").to_pylist()):
            inside, start = False, None
            for s in splits:
                rows.append((file, s["split"], inside, start))
                after = s["inside"] if inside else s["outside"]
                if not inside or s["closes"]:
                    start = s["split"]
                inside, start = after, start if after else None
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64()))],
            names=["file", "split", "open", "start"],
        )


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, split, whole, header, record): records that lie in one split, and pieces of those that do not.

    A file's first record is its header: it is left out, and its pieces are marked.
    """
    rows: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = ["file", "start", "split", "whole", "header", "record"]

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        rows.clear()
        return made

    key, held, inside, start, header = None, [], False, None, False

    def piece(file: str, split: int) -> tuple:
        return (file, split if start is None else start, split, False, header, "\n".join(held))

    for now, lines, quoted, batch, first in _lines(batches):
        if now != key:
            if held:
                rows.append(piece(*key))
            key, held, header = now, [], now[1] == 0
            inside, start = batch.column("open")[first].as_py(), batch.column("start")[first].as_py()
        for line, has in zip(lines, quoted):
            held.append(line)
            if has:
                inside = is_open(line, inside)
            if not inside:
                if start is not None:
                    rows.append(piece(*key))
                elif not header:
                    rows.append((key[0], key[1], key[1], True, False, "\n".join(held)))
                held, start, header = [], None, False
                if len(rows) >= ROWS:
                    yield out()
    if held:
        rows.append(piece(*key))
    yield out()
