"""Ranks and bounded broadcasts that stay balanced when one group is very large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from framejobs.session import stored

# Largest group one task may sort; beyond it the range-partitioned form takes over.
MAX_GROUP_ROWS = 2_000_000
# Largest side that may be shipped to every executor.
MAX_BROADCAST_ROWS = 100_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the biggest group; partial counts, so only one number reaches the driver."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()
    return int(row[0] or 0)


def rank_within(
    df: DataFrame, keys: list[str], order: list[Column], name: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add the 1-based position of each row inside its group under a total order.

    Small groups take the plain window. When a group exceeds ``max_group_rows`` the rows are range
    partitioned on (keys, order), so a large group spreads over many tasks; the position is the
    place inside the partition plus the rows of that group in earlier partitions.
    """
    if largest_group(df, keys) <= max_group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _rank_by_range(df, keys, order, name)


def running_within(
    df: DataFrame, keys: list[str], order: list[Column], weight: str, name: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add the sum of ``weight`` over each row and those before it in its group, under a total order; spread as ranks are."""
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if largest_group(df, keys) <= max_group_rows:
        return df.withColumn(name, F.sum(weight).over(upto(*keys).orderBy(*order)))
    within = F.sum(weight).over(upto(*keys, "__part").orderBy("__row"))
    spread = _spread(df, keys, order)
    return _with_offsets(
        spread.withColumn("__within", within), _offsets(spread, keys, F.sum(weight)), keys, df.columns,
        F.col("l.__within") + F.col("r.__before"), name)


def _rank_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    spread = _spread(df, keys, order)
    return _with_offsets(
        spread, _offsets(spread, keys, F.count(F.lit(1))), keys, df.columns,
        (F.col("l.__row") - F.col("r.__first") + F.col("r.__before") + 1).cast("bigint"), name)


def _spread(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range partitioned on (keys, order), with the number of their partition and their place in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort_keys = [F.col(k) for k in keys] + order
    # monotonically_increasing_id carries the partition number above bit 33 and the row below it.
    spread = (
        df.repartitionByRange(parts, *sort_keys)
        .sortWithinPartitions(*sort_keys)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33))
        .withColumn("__row", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # All branches that read it must see the same partitioning, also after an executor is lost.
    return stored(spread)


def _offsets(spread: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """First place and total before it of each group in each partition."""
    pieces = spread.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), total.alias("__n"))
    # At most one row per (group, partition): bounded by the number of partitions in each group.
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")


def _with_offsets(
    spread: DataFrame, offsets: DataFrame, keys: list[str], columns: list[str], value: Column, name: str
) -> DataFrame:
    left, right = spread.alias("l"), offsets.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition = reduce(lambda a, b: a & b, same, F.col("l.__part") == F.col("r.__part"))
    return left.join(right, condition).select(*[F.col(f"l.`{c}`") for c in columns], value.alias(name))


def previous_within(
    df: DataFrame, keys: list[str], order: list[Column], columns: list[str], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``prev_<column>`` of the row before, in the same group and order."""
    if largest_group(df, keys) <= max_group_rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(window).alias(f"prev_{c}") for c in columns])
    ranked = _rank_by_range(df, keys, order, "__rank")
    before = ranked.select(
        *keys, (F.col("__rank") + 1).alias("__rank"), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return ranked.join(before, [*keys, "__rank"], "left").drop("__rank")


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only when it is known to be small; otherwise leave it to a shuffle."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def first_by(df: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """Keep the row with the smallest ``order`` per group through a map-side combined aggregate."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in kept]), order).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in kept])


def last_by(df: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """Keep the row with the largest ``order`` per group."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in kept]), order).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in kept])
