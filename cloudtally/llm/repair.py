"""Conversation structure repair: the cheapest edits that make turns alternate, by scalar big-integer weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.llm.shared import saved, small_batches

#: Rows of a conversation whose edits are weighed in one piece, as a power of two.
BLOCK_BITS = 8

#: White space that does not count as text.
_BLANKS = " \t\n\x0b\x0c\r"
#: What an audit letter is in a weight; zero is "no letter", so the order of weights is ASCII order, shorter first.
_DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTERS = {v: k for k, v in _DIGITS.items()}
_DIGIT_BITS = 3

# States while reading final roles: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or re-roled turn leads: a user everywhere but after a user.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3

#: A state's weight: the scalar, and how many of its digits are taken.
Weights = dict[int, tuple[int, int]]


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row leads, None where its role cannot stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _less(into: Weights, state: int, weight: int, used: int) -> None:
    if state not in into or weight < into[state][0]:
        into[state] = (weight, used)


def _with_inserts(at: Weights, width: int) -> Weights:
    """Up to two inserted turns from each state; a third would only come back to where one has been."""
    out = dict(at)
    for state, (weight, used) in at.items():
        for _ in range(2):
            state = _NEXT[state]
            weight += (INSERT << _DIGIT_BITS * width) + (_DIGITS["I"] << _DIGIT_BITS * (width - 1 - used))
            used += 1
            _less(out, state, weight, used)
    return out


def over_row(at: Weights, width: int, initial: str, fault: str, copies: int = 1) -> Weights:
    """Weights after one row: inserts before it, then the row kept, re-roled or deleted; further copies of it are deleted.

    A weight is one integer: the cost above ``width`` digits, and the letters so
    far in the top ones of them. Adding an edge adds its cost and puts its
    letter behind; the smaller integer is the cheaper path, or of equally
    cheap ones the one with the smaller letters. That may be decided at once:
    paths over the same rows that are equally cheap have their row letters and
    their inserts in different places, so neither can be the other's beginning,
    and whatever follows cannot turn their order.
    """
    out: Weights = {}
    for state, (weight, used) in _with_inserts(at, width).items():
        moves = [("D", state, DELETE)]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            moves.append(("R", _NEXT[state], REROLE + extra))
            if (to := kept_state(state, initial)) is not None:
                moves.append(("K", to, KEEP + extra))
        for letter, to, cost in moves:
            _less(out, to, weight + (cost << _DIGIT_BITS * width) + (_DIGITS[letter] << _DIGIT_BITS * (width - 1 - used)), used + 1)
    if copies > 1:
        run = sum(_DIGITS["D"] << _DIGIT_BITS * k for k in range(copies - 1))
        out = {
            s: (w + (DELETE * (copies - 1) << _DIGIT_BITS * width) + (run << _DIGIT_BITS * (width - used - copies + 1)), used + copies - 1)
            for s, (w, used) in out.items()
        }
    return out


def block_weights(rows: list[tuple[str, str, int]]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Digits of a block of (initial, fault, copies), and (from, to, used, weight) for all pairs of states around it."""
    width = sum(2 + copies for _, _, copies in rows)
    ends = []
    for start in range(4):
        at: Weights = {start: (0, 0)}
        for initial, fault, copies in rows:
            at = over_row(at, width, initial, fault, copies)
        ends += [(start, to, used, weight) for to, (weight, used) in at.items()]
    return width, ends


def fold(blocks: list[tuple[int, list[tuple[int, int, int, int]]]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits over the blocks of a conversation, in order."""
    width = sum(w for w, _ in blocks) + 2
    at: Weights = {START: (0, 0)}
    for own, ends in blocks:
        after: Weights = {}
        low = (1 << _DIGIT_BITS * own) - 1
        for start, to, used, weight in ends:
            if start in at:
                before, taken = at[start]
                cost, letters = weight >> _DIGIT_BITS * own, weight & low
                moved = letters << _DIGIT_BITS * (width - taken - own)
                _less(after, to, before + (cost << _DIGIT_BITS * width) + moved, taken + used)
        at = after
    at = _with_inserts(at, width)
    weight, used = min(at[s] for s in (START, ASSISTANT) if s in at)
    digits = (weight & ((1 << _DIGIT_BITS * width) - 1)) >> _DIGIT_BITS * (width - used)
    # Octal digits are three bits wide, as the letters are.
    return weight >> _DIGIT_BITS * width, "".join(_LETTERS[int(d)] for d in f"{digits:0{used}o}") if used else ""


class Reader:
    """Follows the letters of a conversation over its rows, which come one by one, and hashes what is left."""

    def __init__(self, conv_id: object, cost: int, audit: str) -> None:
        self.conv_id, self.cost, self.audit = conv_id, cost, audit
        self.at, self.state, self.hash, self.empty = 0, START, hashlib.sha256(), True
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last = 0, None
        self.low = self.high = None
        self.turns = 0

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _NEXT[self.state]
            self._write(_ROLE[self.state], "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, fault: str, copies: int) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        legal = ("su", "ua", "au")
        self.illegal += (self.last is not None and self.last + initial not in legal) + (copies - 1) * (initial * 2 not in legal)
        self.last = initial
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        self._inserts()
        letter = self.audit[self.at]
        if letter == "K":
            self.state = kept_state(self.state, initial)
            self._write(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self._write(_ROLE[self.state], text)
        self.at += copies

    def done(self) -> tuple:
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, self.audit, self.hash.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20; nulls are one space each.

    0 drops the row, 1 empties its text, 2 takes the closing punctuation out of
    it, 3 repeats the row, 4 makes the role user; all others stay as they are.
    """
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def _last_character(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(_BLANKS)), -1, 1)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of all conversations in order, saved: equal ones once with their ``copies``, each with its ``fault`` and a rising ``id``."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    once = once.withColumn("digest", F.sha2("text", 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("first"))
    met = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~_last_character(F.col("text")).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    told = met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    # Cut by the beginning of a text, not the whole of it, as what is sampled goes through the driver.
    dealt = told.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return saved(dealt.withColumn("id", F.monotonically_increasing_id()), "conversation-rows")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """What is wrong with every conversation in ``rows`` (conv_id, turn, role, text), and its cheapest repair.

    One row per conversation: gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256. A row's first fault counts: no text, role and
    text seen earlier, last character none of ``.!?``. Rows may be kept (0),
    re-roled to user or assistant (3), deleted (4, the only way for blank and
    duplicate ones), and empty turns of the two inserted (3); a truncated row
    that stays adds 3. The role initials of the result are ``(s?(ua)+)?``.

    Rows come by turn, null turns first; those of one turn by role and text.
    Equal rows are one with a count. A conversation is cut into blocks of
    256 rows, weighed side by side for every state they may begin in; one fold
    over them settles the edits. What meets in one task are a conversation's
    block weights, some twenty times its audit; its texts only stream through
    the task that hashes them. Null roles and texts count as one space; a null
    conversation id is a conversation. Very long texts and conversations are
    read whole. An empty table gives no rows; further columns are ignored.
    """
    spaced = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    placed = _ordered(spaced)
    conv = dict(placed.dtypes)["conv_id"]
    codes = F.struct("id", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    blocks = placed.groupBy("conv_id", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(codes)).alias("rows"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_weights([(r["initial"], r["fault"], r["copies"]) for r in own]) for own in batch.column("rows").to_pylist()]
            ends = [[{"start": s, "to": t, "used": u, "weight": w.to_bytes(w.bit_length() // 8 + 1)} for s, t, u, w in e] for _, e in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("used", pa.int64()), ("weight", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array([w for w, _ in found], pa.int64()), pa.array(ends, kind)],
                names=["conv_id", "block", "width", "ends"],
            )

    weighed = blocks.mapInArrow(weigh, f"conv_id {conv}, block long, width long, ends array<struct<start:int,to:int,used:long,weight:binary>>")
    whole = weighed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "width", "ends"))).alias("blocks"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                fold([(b["width"], [(e["start"], e["to"], e["used"], int.from_bytes(e["weight"])) for e in b["ends"]]) for b in own])
                for own in batch.column("blocks").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=["conv_id", "cost", "audit"],
            )

    settled = whole.mapInArrow(settle, f"conv_id {conv}, cost long, audit string")
    # A conversation's edits come before its rows.
    none = {"turn": "long", "role": "string", "text": "string", "fault": "string", "copies": "long"}
    heads = settled.select("conv_id", F.lit(-1).cast("long").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "cost", "audit")
    lines = placed.select("conv_id", "id", *none, F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        reader, kind = None, None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            for r in batch.to_pylist():
                if r["id"] < 0:
                    if reader:
                        out.append(reader.done())
                    reader = Reader(r["conv_id"], r["cost"], r["audit"])
                else:
                    reader.row(r["turn"], r["role"], r["text"], r["fault"], r["copies"])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.done(), kinds)], names=names)

    sorted_rows = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "id")
    return small_batches(sorted_rows).mapInArrow(
        read,
        f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )


def repaired_or_empty(asked: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` with a row for every conversation of ``asked``: zeros and an empty text for those without any row."""
    every = asked.select(F.col("conv_id").alias("asked_id")).distinct()
    joined = every.join(repaired, F.col("asked_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("asked_id", "conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
