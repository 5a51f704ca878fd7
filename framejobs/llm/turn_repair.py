"""Conversation repair by a secondary-sorted stream: the cheapest edits that make the roles alternate.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` then walks each conversation once, whatever its
length, and carries its state from one Arrow batch to the next. The state is a dynamic program over the four places in the
legal pattern ``(s?(ua)+)?``: nothing yet, after the system turn, after a user turn, after an assistant turn. For each place it
keeps the cost of the cheapest edits so far, their order among the places, and a running hash of the repaired text. As costs
differ by little and orders are few, the program is a finite machine, and its steps are remembered.

What grows with a conversation is three bytes a row, the edit by which each place was reached, and the digests of turns
seen; both move to scratch files beyond a bound. Edits are read back from the end. Of equally cheap edits the ASCII-least string
is taken: each row gives one letter of ``D``, ``K``, ``R``, so the strings of two places never extend each other and
their order settles every later tie.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framejobs.llm.common import shuffle_partitions
from framejobs.session import stored

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 20
#: What each place may be followed by: initial -> place.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, MUST_GO, CUT_OFF = range(3)
#: Letters of one step, ASCII order: an insertion may stand before the row's own edit.
STEPS = ("D", "ID", "IK", "IR", "K", "R")


@cache
def transitions(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """``(from, to, step, cost)`` of everything that can be done at a row."""
    found = []
    for place in range(4):
        starts = [(place, "", 0)] + [(to, "I", 5) for to in ({NEXT[place].get("u"), NEXT[place].get("a")} - {None})]
        for at, lead, cost in starts:
            found.append((place, at, STEPS.index(lead + "D"), cost + 2))
            if fault == MUST_GO:
                continue
            cost += 5 if fault == CUT_OFF else 0
            if initial in NEXT[at]:
                found.append((place, NEXT[at][initial], STEPS.index(lead + "K"), cost))
            for role in "ua":
                if role in NEXT[at]:
                    found.append((place, NEXT[at][role], STEPS.index(lead + "R"), cost + 1))
    return found


@cache
def advance(costs: tuple, order: tuple, initial: str, fault: int) -> tuple[tuple, tuple, tuple, int, int]:
    """One row: new costs (the least taken off), new order, ``(from, step)`` of each place, packed steps, the cost taken off."""
    best: list = [None] * 4
    for place, to, step, cost in transitions(initial, fault):
        offer = (costs[place] + cost, order[place], step, place)
        if costs[place] < FAR and (best[to] is None or offer < best[to]):
            best[to] = offer
    least = min(b[0] for b in best if b)
    rank = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
    place_of = {to: i for i, (_, _, to) in enumerate(rank)}
    moves = tuple((b[3], b[2]) if b else None for b in best)
    packed = sum((m[0] * 8 + m[1]) << (5 * to) for to, m in enumerate(moves) if m)
    return tuple(b[0] - least if b else FAR for b in best), tuple(place_of.get(to, 4) for to in range(4)), moves, packed, least


class Spill:
    """A growing byte string that moves to a scratch file beyond ``bound`` bytes; gone with the task."""

    def __init__(self, bound: int):
        self.file = tempfile.SpooledTemporaryFile(max_size=bound)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def blocks_from_end(self, item: int, block: int = 1 << 16):
        end = self.file.seek(0, 2)
        while end:
            start = max(0, end - block * item)
            self.file.seek(start)
            yield self.file.read(end - start)
            end = start


class Seen:
    """Digests of turns seen; a full set becomes a sorted run in a scratch file, searched from there."""

    def __init__(self, bound: int):
        self.recent: set[bytes] = set()
        self.bound, self.runs = bound, []

    def add(self, key: bytes) -> bool:
        """Whether ``key`` was there before."""
        if key in self.recent or any(self._holds(run, key) for run in self.runs):
            return True
        self.recent.add(key)
        if len(self.recent) >= self.bound:
            with tempfile.TemporaryFile() as file:
                np.frombuffer(b"".join(sorted(self.recent)), dtype="S16").tofile(file)
                self.runs.append(np.memmap(file, dtype="S16", mode="r", shape=(len(self.recent),)))
            self.recent = set()
            self.bound *= 2  # so that runs stay few
        return False

    @staticmethod
    def _holds(run: np.ndarray, key: bytes) -> bool:
        low, high = 0, len(run)
        while low < high:
            middle = (low + high) // 2
            if run[middle].ljust(16, b"\0") < key:
                low = middle + 1
            else:
                high = middle
        return low < len(run) and run[low].ljust(16, b"\0") == key


class Conversation:
    """State of one conversation between rows."""

    def __init__(self, conv_id, bound: int):
        self.conv_id = conv_id
        self.costs, self.order, self.base = (0, FAR, FAR, FAR), (0, 4, 4, 4), 0
        self.hashes = [hashlib.sha256()] + [None] * 3
        self.steps, self.seen = Spill(bound), Seen(max(1, bound // 64))
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.rows = self.turns = 0
        self.first = self.last = None
        self.before = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        body = text.rstrip(WHITE)
        raw, initial = role.encode() + b":" + text.encode(), role[:1]
        again = self.seen.add(hashlib.blake2b(b"%d:" % len(role.encode()) + raw, digest_size=16).digest())
        fault = FINE
        if not body:
            self.counts["blank"] += 1
            fault = MUST_GO
        elif again:
            self.counts["duplicate"] += 1
            fault = MUST_GO
        elif body[-1] not in ".!?":
            self.counts["truncated"] += 1
            fault = CUT_OFF
        if self.rows and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        self.rows += 1
        if turn is not None and turn != self.last:  # turns come in order
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        kept = initial if initial in ("s", "u", "a") else "-"
        self.costs, self.order, moves, packed, least = advance(self.costs, self.order, kept, fault)
        self.base += least
        self.steps.write(packed.to_bytes(3, "little"))
        old, self.hashes = self.hashes, [None] * 4
        for to, move in enumerate(moves):
            if move is None:
                continue
            place, letters = move[0], STEPS[move[1]]
            if letters == "D":
                self.hashes[to] = old[place]  # hashes are copied before they are changed
                continue
            state = old[place].copy()
            if letters[0] == "I":
                place = self._insert(state, place)
            if letters[-1] != "D":
                state.update((b"\n" if place else b"") + (raw if letters[-1] == "K" else ROLE[to].encode() + b":" + text.encode()))
            self.hashes[to] = state

    @staticmethod
    def _insert(state, place: int) -> int:
        """Add the turn that may stand after ``place`` without text; the place after it."""
        to = NEXT[place].get("u", NEXT[place].get("a"))
        state.update((b"\n" if place else b"") + ROLE[to].encode() + b":")
        return to

    def result(self) -> dict:
        ends = [(self.costs[p] + c, self.order[p], p, tail) for p, c, tail in ((START, 0, ""), (ASSISTANT, 0, ""), (USER, 5, "I")) if self.costs[p] < FAR]
        cost, _, place, tail = min(ends)
        state = self.hashes[place]
        if tail:
            state = state.copy()
            self._insert(state, place)
        pieces = [tail]
        for block in self.steps.blocks_from_end(3):
            codes = np.frombuffer(block, dtype=np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
            for code in codes[::-1].tolist():
                move = code >> (5 * place) & 31
                pieces.append(STEPS[move & 7][::-1])
                place = move >> 3
        return {
            "conv_id": self.conv_id, "gaps": self.last - self.first + 1 - self.turns if self.turns else 0, **self.counts,
            "cost": self.base + cost, "audit": "".join(pieces)[::-1], "repaired_sha256": state.hexdigest(),
        }


def _in_order(turns: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return turns.repartition(shuffle_partitions(turns), "conv_id").sortWithinPartitions(*order)


def repair(turns: DataFrame, bound: int = 1 << 20) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text[, present])``: ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A row that is not ``present`` only makes its
    conversation known. The first fault of a row counts: blank, the role and text of an earlier row, or an end other than
    ``.!?``. Keep costs 0, rerole 1, delete 2 (which blank and duplicate rows must be), insert 5, an unfinished row
    that stays 5 more. ``audit`` has the initials of the edits, of equally cheap ones the ASCII-least. A null role or text
    is one space; an empty role has no initial and cannot stay; rows of null ids are one conversation; one without rows has zeros and an empty audit. Very long texts are
    hashed as they pass. An empty table gives an empty result; extra columns are ignored. ``bound``: bytes of steps, and 64
    times the digests, that a conversation keeps in memory.
    """
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))

    schema = pa.schema(
        [(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        one, done = None, []
        for batch in batches:
            data = batch.to_pydict()
            for conv_id, turn, role, text, there in zip(*[data[c] for c in ("conv_id", "turn", "role", "text", "present")]):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        done.append(one.result())
                    one = Conversation(conv_id, bound)
                if there:
                    one.add(turn, role, text)
            if done:
                yield pa.RecordBatch.from_pylist([{k: d[k] for k in names} for d in done], schema=schema)
                done = []
        if one is not None:
            yield pa.RecordBatch.from_pylist([one.result()], schema=schema)

    return _in_order(rows).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by the checksum of id and turn: a row of twenty goes (``present`` false), one loses its text, one
    its final marks, one is said twice, one is given to the user. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repaired_turns(turns: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id``, ``place`` from 0, ``role``, ``text``, ``edit``.

    Each conversation's edits arrive before its rows, in the order ``repair`` took them; a second stream applies them.
    """
    repairs = stored(repairs if repairs is not None else repair(turns))
    keep = turns.where("present") if "present" in turns.columns else turns
    rows = keep.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("kind"))
    edits = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = rows.unionByName(edits)
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("kind"), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]]

    def run(batches):
        audit, at, place, state, conv = "", 0, 0, START, None
        columns = ["conv_id", "place", "role", "text", "edit"]
        for pdf in batches:
            out = []

            def put(role, text, edit):
                nonlocal place, state
                state = NEXT[state][role[:1]]
                out.append((conv, place, role, text, edit))
                place += 1

            def insert():
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put(ROLE[NEXT[state].get("u", NEXT[state].get("a"))], "", "I")
                    at += 1

            for conv_id, kind, role, text in zip(pdf["conv_id"].astype("Int64").tolist(), pdf["kind"].tolist(), pdf["role"].tolist(), pdf["text"].tolist()):
                if kind == 0:
                    audit, at, place, state, conv = text, 0, 0, START, None if conv_id is pd.NA else conv_id
                    continue
                insert()
                letter, at = audit[at], at + 1
                if letter == "K":
                    put(role, text, "K")
                elif letter == "R":
                    put(ROLE[NEXT[state].get("u", NEXT[state].get("a"))], text, "R")
                insert()  # the end may need one; before a row it is what the row would have found
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    return both.repartition(shuffle_partitions(turns), "conv_id").sortWithinPartitions(*order).mapInPandas(
        run, "conv_id long, place long, role string, text string, edit string")
