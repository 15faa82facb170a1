"""Conversation repair against a search over all edits, row by row as the contract tells it."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from cloudtally.llm import queries, repair

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults_of(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        full = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, faults):
    """(cost, letters, final rows) of every way to edit the rows with up to two inserts in each gap."""
    gaps = [[()] + [(r,) for r in ("user", "assistant")] + list(product(("user", "assistant"), repeat=2))] * (len(rows) + 1)
    moves = []
    for (_, _, role, text), fault in zip(rows, faults):
        own, extra = [("D", 4, None)], 3 if fault == "truncated" else 0
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, (role, text))] + [("R", 3 + extra, (r, text)) for r in ("user", "assistant")]
        moves.append(own)
    for inserts in product(*gaps):
        for chosen in product(*moves):
            cost = 3 * sum(map(len, inserts)) + sum(c for _, c, _ in chosen)
            letters, final = "", []
            for i in range(len(rows) + 1):
                letters += "I" * len(inserts[i])
                final += [(r, "") for r in inserts[i]]
                if i < len(rows):
                    letters += chosen[i][0]
                    final += [chosen[i][2]] if chosen[i][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in final)):
                yield cost, letters, final


def slow_report(rows):
    """What the operator says of one conversation's rows."""
    rows = in_order(rows)
    faults = faults_of(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, final = min(all_repairs(rows, faults), key=lambda x: x[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def conversations(seed, n=60, longest=2):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "d?  ", "", " \t", "e. f", None, "é?", "\x85"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(longest + 1)):
            at = rng.choice([turn, turn, turn + 1, None])
            rows.append((conv, at, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "unit"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repairs_are_the_cheapest(spark, seed):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations(seed)]
    got = told(repair.repair_conversations(spark.createDataFrame(rows, KIND).repartition(5)))
    assert got == {c: slow_report(own) for c, own in by_conversation(rows).items()}


def test_the_query_on_damaged_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(queries.op12_repair(spark, SF))
    damaged = by_conversation(slow_damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        own = damaged.get(conv, [])
        if len(own) <= 2:  # the search over all edits grows fast
            assert got[conv] == (slow_report(own) if own else nothing), conv
        else:
            assert got[conv] == single_block(own), conv


def single_block(rows):
    """The same, with the edits weighed by plain tuples instead of integers, over all rows at once."""
    rows = in_order(rows)
    faults = faults_of(rows)
    at = {0: (0, "", ())}

    def grow(at):
        out = dict(at)
        for s, (c, a, f) in at.items():
            for _ in range(2):
                s = (2, 2, 3, 2)[s]
                c, a, f = c + 3, a + "I", (*f, (repair._ROLE[s], ""))
                out[s] = min(out.get(s, (c, a, f)), (c, a, f))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        out = {}
        for s, (c, a, f) in grow(at).items():
            options = [(s, c + 4, a + "D", f)]
            if fault not in ("blank", "duplicate"):
                extra, n = 3 if fault == "truncated" else 0, (2, 2, 3, 2)[s]
                options.append((n, c + 3 + extra, a + "R", (*f, (repair._ROLE[n], text))))
                if (k := repair.kept_state(s, role[:1])) is not None:
                    options.append((k, c + extra, a + "K", (*f, (role, text))))
            for k, *w in options:
                out[k] = min(out.get(k, tuple(w)), tuple(w))
        at = out
    at = grow(at)
    cost, audit, final = min(at[s] for s in (0, 3) if s in at)
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[2][:1] for r in rows]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, digest,
    )


def test_a_long_conversation_is_cut_into_blocks_and_told_as_one(spark):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system"], ["", "x", "same."] + [f"t{i}." for i in range(900)]
    rows = [(1, i // 2, rng.choice(roles), rng.choice(texts)) for i in range(1400)] + [(2, 0, "user", "a.")]
    got = told(repair.repair_conversations(spark.createDataFrame(rows, KIND).repartition(7)))
    assert got == {c: single_block(own) for c, own in by_conversation(rows).items()}


@pytest.mark.parametrize("seed", range(3))
def test_longer_conversations(spark, seed):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations(10 + seed, n=80, longest=9)]
    small = [own for own in by_conversation(rows).values() if len(own) <= 2]
    assert all(single_block(own) == slow_report(own) for own in small) and len(small) > 10
    got = told(repair.repair_conversations(spark.createDataFrame(rows, KIND).repartition(5)))
    assert got == {c: single_block(own) for c, own in by_conversation(rows).items()}


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_blocks_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations(7, n=30, longest=9)]
    got = told(repair.repair_conversations(spark.createDataFrame(rows, KIND)))
    assert got == {c: single_block(own) for c, own in by_conversation(rows).items()}


def test_repeated_rows_are_one_with_a_count(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b.")] + [(1, 0, "user", "a.")] * 700 + [(1, None, "user", "")] * 300
    got = told(repair.repair_conversations(spark.createDataFrame(rows, KIND)))
    assert got == {1: single_block(rows)}
    assert got[1][6] == "D" * 300 + "K" + "D" * 700 + "K"


def test_odd_tables(spark):
    rows = [(None, None, None, None, 1), (5, 3, "user", "long " * 200_000 + "end.", 2), (5, 4, "assistant", "ok.", 2), (6, None, "s", "x.", 3)]
    table = spark.createDataFrame(rows, KIND + ", digest int").withColumns({"id": F.lit(1), "fault": F.lit("f"), "copies": F.lit(2)})
    got = told(repair.repair_conversations(table))
    spaced = [(c, t, r or " ", x or " ") for c, t, r, x, _ in rows]
    assert got == {c: slow_report(own) for c, own in by_conversation(spaced).items()}
    assert got[6][5:7] == (4, "D") and got[None][1] == 1
    assert repair.repair_conversations(table.limit(0)).collect() == []
    none = repair.repaired_or_empty(table.select("conv_id"), repair.repair_conversations(table.limit(0)))
    assert sorted(map(str, told(none))) == ["5", "6", "None"] and {v[-1] for v in told(none).values()} == {hashlib.sha256().hexdigest()}


def test_damage(spark):
    rows = conversations(3, n=80)
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(got, key=str) == sorted(slow_damage(rows), key=str)
    assert len(got) != len(rows)
