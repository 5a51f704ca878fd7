"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on each side is a completion. Only text
that an assistant says in a completion is trained on: its spans are given in characters of that completion, end mark
included; headers and all other turns are masked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from framejobs.llm.common import shuffle_partitions, spread_join
from framejobs.session import stored

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"
TURN = "array<struct<turn:long,role:string,text:string>>"
SPANS = "array<struct<start:long,stop:long>>"


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of some turns, and the spans an assistant says. Marks inside a text are broken up, so that only headers and
    ends look like marks."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{_plain(role)}{CLOSE}\n"
        body = _plain(text) + END
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(parts), spans


def _plain(text: str | None) -> str:
    return (text or "").replace(OPEN, "< |")


def common_turns(chosen: list[tuple[str, str]], rejected: list[tuple[str, str]]) -> int:
    """Length of the longest common prefix of turns."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair: ``pair_id``, ``prompt``, ``chosen``, ``rejected``, ``chosen_spans``, ``rejected_spans``, ``n_common``.

    Both tables have (pair, turn, role, text), one row per turn. Turns are compared by role and text in the order
    of (turn, role, text), so repeated rows are turns of their own and order is total. A null role or text is an empty one. A
    pair that one side lacks has an empty completion there and no common turn; equal sides give an empty
    completion each. Rows without a pair id are one pair. An empty table gives an empty result. A
    training example is one row, so the turns of one conversation meet in one row; extra columns are ignored.
    """
    def side(df, name):
        return df.select(
            F.col(pair_col).cast("long").alias("pair_id"), F.lit(name).alias("side"),
            F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
        )

    turns = side(chosen, "c").union(side(rejected, "r"))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("said"))))
    pairs = turns.groupBy("pair_id").agg(of("c").alias("c"), of("r").alias("r"))

    def run(batches):
        for pdf in batches:
            rows = []
            for pair, c, r in zip(pdf["pair_id"], pdf["c"], pdf["r"]):
                c, r = ([(t["role"], t["text"]) for t in x] for x in (c, r))
                n = common_turns(c, r)
                (prompt, _), (a, a_spans), (b, b_spans) = render(c[:n]), render(c[n:]), render(r[n:])
                spans = [[{"start": s, "stop": e} for s, e in x] for x in (a_spans, b_spans)]
                rows.append((None if pd.isna(pair) else int(pair), prompt, a, b, *spans, n))
            yield pd.DataFrame(rows, columns=["pair_id", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "n_common"]).astype({"pair_id": "Int64"})

    return pairs.mapInPandas(
        run, f"pair_id long, prompt string, chosen string, rejected string, chosen_spans {SPANS}, rejected_spans {SPANS}, n_common long")


def next_in_order(ids: DataFrame, id_col: str) -> DataFrame:
    """``(id, next)`` for the distinct values of ``id_col``: the following one in order, null last, and the first after the last.

    Rows are range partitioned, so order needs no single task; only each partition's first id meets the others'.
    """
    value = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    placed = stored(
        ids.select(value.alias("v")).distinct().repartitionByRange(shuffle_partitions(ids), "v").sortWithinPartitions("v")
        .withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    parts = Window.orderBy("part")  # one row a partition
    heads = placed.groupBy("part").agg(F.min("v").alias("head")).select(
        "part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts)).alias("ahead"))
    follows = F.lead("v").over(Window.partitionBy("part").orderBy("row"))
    return placed.withColumn("follows", follows).join(heads, "part").select(
        F.col("v.id").alias("id"), F.coalesce("follows", "ahead")["id"].alias("next"))


def answer_swaps(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from plain conversations.

    Chosen is a conversation as it is; rejected follows it to its last assistant turn, and there gives the last answer of the
    next answered conversation in id order, the last one that of the first, so every answered conversation makes a pair
    (alone in its table, with equal sides). One without an answer makes none. Rows of null ids are one conversation, in order
    after all others. A null turn comes before every other; of several assistant rows at the last turn the largest
    text is the answer, and all of them are exchanged, repeated rows included. An empty table gives empty sides.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = stored(
        turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("of"))
        .select("pair_id", F.col("of.turn").alias("last_turn"), F.col("of.text").alias("answer"))
    )
    order = stored(next_in_order(last, "pair_id").select(F.col("id").alias("pair_id"), F.col("next").alias("partner")))
    answers = last.select(F.col("pair_id").alias("partner"), "answer")
    swaps = stored(spread_join(spread_join(last.select("pair_id", "last_turn"), order, ["pair_id"]), answers, ["partner"]).drop("partner"))
    sided = spread_join(turns, swaps, ["pair_id"])
    chosen = sided.select("pair_id", "turn", "role", "text")
    swapped = F.col("turn").eqNullSafe(F.col("last_turn")) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    before = F.coalesce(F.col("turn") < F.col("last_turn"), F.col("turn").isNull() & F.col("last_turn").isNotNull())
    rejected = sided.where(before | swapped).select(
        "pair_id", "turn", "role", F.when(swapped, F.col("answer")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
