"""Conversation repair against every edit string tried one by one, small bounds, batches, and odd rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from framejobs.llm import turn_repair
from framejobs.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, audit string, cost string"
LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def shuffled(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return [(t, " " if ro is None else ro, " " if x is None else x) for _, t, ro, x, *_ in rows]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """All edit strings with at most two insertions in a row, shortest cost, then ASCII-least."""
    bad = faults(rows)
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in bad]
    best = None
    gaps = [[], ["Iu"], ["Ia"], ["Iu", "Ia"], ["Ia", "Iu"]]
    for edits in product(*choices):
        base = sum(2 if e == "D" else (1 if e[0] == "R" else 0) + (5 if f == "truncated" else 0) for e, f in zip(edits, bad))
        if best is not None and base > best[0]:
            continue
        for ins in product(gaps, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, ins))
            if best is not None and cost > best[0]:
                continue
            letters, turns = [], []
            for i in range(len(rows) + 1):
                for x in ins[i]:
                    letters.append("I")
                    turns.append(("user" if x[1] == "u" else "assistant", ""))
                if i < len(rows):
                    letters.append(edits[i][0])
                    if edits[i] != "D":
                        turns.append((rows[i][1] if edits[i] == "K" else "user" if edits[i] == "Ru" else "assistant", rows[i][2]))
            if not LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                continue
            offer = (cost, "".join(letters), turns)
            if best is None or offer[:2] < best[:2]:
                best = offer
    return best


def summary(conv_id, rows, best):
    bad = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    return (conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), best[0], best[1],
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 4)):
            out.append((c, rng.choice([t, t + rng.randint(0, 9), None]) if rng.random() < 0.3 else t,
                        rng.choice(["user", "assistant", "system", "tool", "", None] if rng.random() < 0.4 else ["user", "assistant"]),
                        rng.choice(["Yes.", "No!", "cut", " \t", None, "", "a:b?", "Well.\n"]), True, "", ""))
    return out


@pytest.mark.parametrize("seed,bound", [(1, 1 << 20), (2, 1)])
def test_matches_every_edit_string(spark, seed, bound):
    rows = conversations(seed, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(df, bound).collect()}
    plans = {}
    for c in {r[0] for r in rows}:
        mine = shuffled([r for r in rows if r[0] == c])
        plans[c] = brute(mine)
        assert got[c] == summary(c, mine, plans[c]), mine
    turns = {}
    for r in turn_repair.repaired_turns(df).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert all([t[1:] for t in sorted(turns.get(c, []))] == p[2] for c, p in plans.items())


def test_one_giant_conversation_over_batches(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", "cut", f"word {t}.", f"word {t}"]), True, "", "") for t in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        small = turn_repair.repair(spark.createDataFrame(rows, SCHEMA), 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert small == whole and len(whole) == 1
    row, mine = whole[0], shuffled(rows)
    bad = faults(mine)
    assert [row[c] for c in COLUMNS[2:5]] == [bad.count(f) for f in ("blank", "duplicate", "truncated")]
    letters = iter(mine)
    state, cost, kept = "", 0, []
    for e in row.audit:
        if e == "I":
            role, text = ("user" if state in ("", "s", "a") else "assistant"), ""
            cost += 5
        else:
            t, role, text = next(letters)
            fault = bad[t]
            if e == "D":
                cost += 2
                continue
            assert fault not in ("blank", "duplicate")
            cost += (5 if fault == "truncated" else 0) + (e == "R")
            role = role if e == "K" else "user" if state in ("", "s", "a") else "assistant"
        kept.append(f"{role}:{text}")
        state = role[0]
    assert next(letters, None) is None and cost == row.cost
    assert LEGAL.fullmatch("".join(k[0] for k in kept)) and hashlib.sha256("\n".join(kept).encode()).hexdigest() == row.repaired_sha256


def test_odd_rows(spark):
    rows = [(None, None, None, None, True, "", ""), (None, 3, "user", "One.", True, "", ""), (1, 0, "user", "Gone.", False, "", ""),
            (2, None, "user", "Hi.", True, "", ""), (2, None, "assistant", "Yo. " + "y" * 400000 + ".", True, "", ""), (3, 5, "user", "Same.", True, "", ""),
            (3, 5, "user", "Same.", True, "", ""), (3, 9, "assistant", "Fine", True, "", "")]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in (None, 2, 3):
        mine = shuffled([r for r in rows if r[0] == c])
        assert got[c] == summary(c, mine, brute(mine))
    assert got[1] == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    assert turn_repair.repair(turn_repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def test_damage_and_query(spark, sf_dir):
    source = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    source += [(None, None, None, None), (None, 4, "user", "A.B!"), (5, None, None, "x?")]
    df = spark.createDataFrame(source, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r)[:4] for r in turn_repair.damage(df).where("present").collect()), key=str)
    assert got == sorted(damaged(source), key=str)
    answer = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_conversation_repair"](spark, sf_dir).collect()}
    by = {}
    for r in damaged(source[:-3]):
        by.setdefault(r[0], []).append(r)
    assert set(answer) == {r[0] for r in source[:-3]}
    for c, row in answer.items():
        mine = shuffled(by.get(c, []))
        if len(mine) <= 4:
            assert row == summary(c, mine, brute(mine))
