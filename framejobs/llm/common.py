"""Helpers the training-data operators share: stored tables, running totals, connected components, local merging."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from framejobs.session import configure, stored

#: A word is a run of characters other than ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes one Arrow batch may carry, so that very long texts do not pile up in a Python worker.
BATCH_BYTES = 32 << 20


def prepare(spark):
    """Session settings the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(df: DataFrame) -> None:
    """Delete the folder of a table written by ``stored`` once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys; both sides should be stored tables or plain
    projections of them, so that run-time skew splitting can act on a hot key."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(df: DataFrame, order: list[str | Column], values: dict[str, str], keys: list[str] = []) -> DataFrame:
    """Add, for each ``{value: name}``, the total of ``value`` over all earlier rows of the same ``keys``.

    Rows are range partitioned on (keys, order), so a hot key spreads over many tasks: a row's total is the
    one inside its partition plus those of its key in earlier partitions. ``order`` must be total for a
    repeatable result. The sorted rows are stored, because two branches must see the same partitioning.
    """
    columns = df.columns
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stored(
        df.repartitionByRange(shuffle_partitions(df), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33))
    )
    inside = Window.partitionBy("__part", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("__part", *keys).agg(*[F.sum(v).alias(f"__s_{n}") for v, n in values.items()])
    # One row per key and partition it reaches: bounded by partitions + keys.
    offsets = stored(pieces.select("__part", *keys, *[
        F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values.values()
    ]))
    local = placed.select(*columns, "__part", *[
        F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__i_{n}") for v, n in values.items()
    ])
    return spread_join(local, offsets, ["__part", *keys]).select(
        *columns, *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in values.values()]
    )


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(id, root)`` per linked vertex, root the smallest id.

    Alternating large-star and small-star rounds, each a pair of aggregates and joins; every round is stored,
    so lineage stays short and lost executors cost one round at most. Ends when all edges form stars.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("__m"))
        large = stored(
            both.where(F.col("b") > F.col("a"))
            .join(lowest, "a")
            .select(F.col("b").alias("a"), F.least("a", "__m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("__m"))
        joined = large.join(lowest, "a")
        small = stored(
            joined.select("a", F.col("__m").alias("b"))
            .union(joined.where(F.col("b") != F.col("__m")).select(F.col("b").alias("a"), F.col("__m").alias("b")))
            .distinct()
        )
        release(edges)
        release(large)
        edges = small
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        roots.select(F.col("b").alias("id"), F.col("b").alias("root"))
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex is either a leaf with one edge or a root."""
    ends = edges.select("a").union(edges.select("b").distinct())
    return ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of index pairs on an array of root labels (each label the smallest index of its set)."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
