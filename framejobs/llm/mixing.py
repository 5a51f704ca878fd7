"""Mixing sources to target weights by weighted fair queueing.

Every document offers itself once per epoch in a shuffled order of its source. Its virtual finish time is the words
its source has offered up to and including it, divided by the source's target. All offers are put in one global
order of finish times and taken until the total budget is reached, so every source advances at the pace of its
target and ends near it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from framejobs.llm.common import WORD, release, running_totals, spread_join
from framejobs.session import stored


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, cap: int) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``budget_share`` of all sizes
    by weight; a target stops at ``cap`` times its source's size and the excess is shared anew until none is above.
    Only three totals per round reach the driver.
    """
    rank = running_totals(
        sizes.withColumn("one", F.lit(1)).withColumn("absent", F.col("source").isNull()),
        ["absent", "source"], {"one": "rank"},
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(rank.select("source", "source_size", weight.cast("long").alias("weight")))
    budget = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]) * budget_share
    pace, full = -1.0, 0
    while True:
        # A source whose cap lies below its share at the present pace is full.
        is_full = F.col("source_size") * cap <= F.col("weight") * F.lit(pace)
        row = table.agg(
            F.count_if(is_full), F.sum(F.when(is_full, F.col("source_size") * cap)), F.sum(F.when(~is_full, F.col("weight")))
        ).head()
        if not row[2] or (pace >= 0 and row[0] == full):
            break
        full, pace = row[0], max(0.0, (budget - (row[1] or 0)) / row[2])
    share = F.col("weight") * F.lit(pace)
    return table.select(
        "source", "source_size",
        F.when(F.col("source_size") * cap <= share, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, cap: int = 2, seed: int = 1,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``copies`` is how often the mix takes the document (0 to ``cap``), ``taken`` its words times copies. The document at which
    the budget is reached is still taken, so a source misses its target by one document at most. The
    shuffle depends on the seed, id and text only: reruns agree, and rows that repeat a document are placed one
    after the other. Wordless and null texts have size 0 and are never taken; null sources are one source; an
    empty table gives an empty result. Extra columns are ignored.
    """
    shuffle = lambda e: F.md5(F.concat_ws(":", F.lit(str(seed)), e, F.col("doc_id").cast("string"), F.col("key")))
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
    ))
    # Equal rows are numbered together: one offer stands for all of them.
    same = stored(rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("repeats")))
    targets = stored(source_targets(
        same.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).cast("long").alias("source_size")),
        weights, budget_share, cap,
    ))
    offers = (
        same.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
        .withColumn("turn", shuffle(F.col("epoch").cast("string")))
    )
    queued = running_totals(offers, ["epoch", "turn", "doc_id", "key", "repeat"], {"size": "offered"}, ["source"])
    timed = spread_join(queued, targets, ["source"]).where("target > 0").withColumn(
        "finish", (F.col("offered") + F.col("size")) / F.col("target"))
    release(rows)
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).head()[0]
    ordered = running_totals(
        timed.select("doc_id", "source", "size", "key", "epoch", "turn", "repeat", "finish"),
        ["finish", "turn", "doc_id", "source", "key", "repeat"], {"size": "mixed"},
    )
    # Sums of targets carry rounding; half a word keeps a full budget from taking one more document.
    won = ordered.where(F.col("mixed") < F.lit(budget - 0.5)).groupBy("doc_id", "source", "size", "key", "repeat").agg(
        F.count(F.lit(1)).alias("copies"))
    numbered = same.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    result = spread_join(
        numbered.drop("repeats"), won.withColumnRenamed("size", "__size"), ["doc_id", "source", "key", "repeat"], "left")
    return spread_join(result, targets, ["source"]).select(
        "doc_id", "source", "key", "repeat", "size", "source_size", "target",
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as the mix takes it."""
    columns = docs.columns
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    # One key without nulls for rows and results, so that one exchange of the texts serves the join and the numbering.
    key = lambda *cs: {"__a": F.xxhash64(*cs), "__b": F.xxhash64(F.lit(7), *cs)}
    taken = stored(
        mix(docs, text_col=text_col, **options).groupBy("doc_id", "source", "key")
        .agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
        .withColumns(key("doc_id", F.col("source").isNull(), "source", "key")).drop("doc_id", "source", "key")
    )
    source = F.col(source_col).cast("string")
    marked = docs.withColumns(key(F.col(id_col).cast("long"), source.isNull(), source, F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    repeat = F.row_number().over(Window.partitionBy("__a", "__b").orderBy("__rows"))
    # Rows that repeat a document are alike and share its copies evenly.
    own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(repeat <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    return marked.join(taken, ["__a", "__b"]).withColumn("__own", own.cast("int")).where("__own > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__own")))).select(*columns)
