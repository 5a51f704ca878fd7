"""Catalogue ingest: classify, group into products, drop repeated bytes, number the shots."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from framejobs import vocab
from framejobs.functions import paths as P
from framejobs.functions.text import dedupe_key, stable_id
from framejobs.operators.ranking import MAX_GROUP_ROWS, first_by, largest_group, rank_within
from framejobs.session import stored


def classify(files: DataFrame) -> DataFrame:
    """Add the skip reason; null means accepted."""
    return files.withColumn(
        "skip_reason",
        P.skip_reason(F.col("relative_path"), F.col("file_name"), F.col("mime_type"), F.col("byte_size")),
    )


def group_products(files: DataFrame) -> DataFrame:
    """Product identity of each file: the folder is the product, the folder above its category.

    Files at the root have no folder and become a product each, named from the file.
    """
    staged = files.withColumn("relative_path", P.normalize_path(F.col("relative_path")))
    staged = staged.withColumn("folder_path", P.folder_of(F.col("relative_path")))
    staged = staged.withColumn("__parts", P.segments(F.col("folder_path")))
    depth = F.size("__parts")
    staged = staged.withColumn(
        "product_name",
        P.display_name(
            F.when(depth == 0, F.col("file_name")).otherwise(F.get(F.col("__parts"), depth - 1))
        ),
    ).withColumn("category", F.when(depth >= 2, P.display_name(F.get(F.col("__parts"), depth - 2))))
    staged = staged.withColumn("product_slug", P.slugify(F.col("product_name"))).drop("__parts")
    return staged.withColumn(
        "product_id", F.when(
            F.col("folder_path") == "", stable_id("prd", F.col("import_id"), F.lit(""), F.col("file_name"))
        ).otherwise(stable_id("prd", F.col("import_id"), F.col("folder_path")))
    )


def distinct_images(grouped: DataFrame) -> DataFrame:
    """First arrival of each (product, content hash); a partial aggregate, so hot bytes stay balanced."""
    return first_by(grouped, ["product_id", "source_hash"], F.col("arrival"))


def renumber(images: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Shot order inside each product by natural file name; the first shot is the primary one."""
    order = [P.natural_key(F.col("file_name")), F.col("created_at"), F.col("image_id")]
    staged = images.withColumn("__natural", order[0])
    ranked = rank_within(
        staged, ["product_id"], [F.col("__natural"), *order[1:]], "__rank", max_group_rows
    )
    return (
        ranked.withColumn("position", F.col("__rank") - 1)
        .withColumn("is_primary", F.col("__rank") == 1)
        .drop("__rank", "__natural")
    )


def reuse_analyses(images: DataFrame, analyses: DataFrame, engine_version: str) -> DataFrame:
    """Images whose bytes were analysed before are ready on arrival; the others wait."""
    ready = (
        analyses.filter((F.col("engine_version") == engine_version) & (F.col("status") == "ready"))
        .select("source_hash").distinct().withColumn("__ready", F.lit(True))
    )
    return images.join(ready, "source_hash", "left").withColumn(
        "vision_status", F.when(F.col("__ready"), "ready").otherwise("pending")
    ).drop("__ready")


def product_counters(images: DataFrame) -> DataFrame:
    """Image count and primary image per product."""
    preference = F.struct(~F.col("is_primary"), F.col("position"), F.col("created_at"), F.col("image_id"))
    return images.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("image_count"),
        F.min_by("image_id", preference).alias("primary_image_id"),
    )


def undecodable(files: DataFrame) -> Column:
    """Whether a file's bytes gave no picture, as far as the listing knows."""
    broken = F.lit(False)
    if {"width", "height"} <= set(files.columns):
        broken = (F.coalesce(F.col("width"), F.lit(0)) == 0) | (F.coalesce(F.col("height"), F.lit(0)) == 0)
    return broken | F.col("format").isNull() if "format" in files.columns else broken


def settle_types(images: DataFrame) -> DataFrame:
    """One stored type per content hash, so that equal bytes have one storage key: the type they decode to, or where
    the listing does not know it, the type under which they arrived first."""
    if "format" in images.columns:
        return images.withColumn("mime_type", P.mime_of_format(F.col("format")))
    arrived = images.withColumn("__type", P.stored_mime(F.col("file_name"), F.col("mime_type")))
    first = arrived.groupBy("source_hash").agg(
        F.min_by("__type", F.struct("created_at", "import_id", "arrival", "product_id")).alias("mime_type"))
    return arrived.drop("mime_type", "__type").join(first, "source_hash")


def import_catalog(
    files: DataFrame, analyses: DataFrame, engine_version: str, max_group_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ingest a listing; returns (outcomes per file, products, images).

    ``files`` carries arrival (unique inside the import), import_id, relative_path, file_name,
    mime_type, byte_size, source_hash, created_at, and optionally width and height, and the decoded ``format``.
    An accepted file without a size or a format cannot be decoded and has failed.
    """
    staged = classify(files).withColumn("__failed", F.col("skip_reason").isNull() & undecodable(files))
    usable = group_products(staged.filter(F.col("skip_reason").isNull() & ~F.col("__failed")))
    kept = settle_types(distinct_images(usable)).withColumn(
        "image_id", stable_id("img", F.col("product_id"), F.col("source_hash"))
    ).withColumn("storage_key", P.original_key(F.col("source_hash"), F.col("mime_type")))
    # Outcomes, products and images all derive from the kept files: write them once, read them back.
    kept = stored(kept.drop("skip_reason", "__failed"))
    numbered = renumber(kept, max_group_rows)

    # (import, arrival) is unique, so marking the kept file of each group never meets a hot key.
    marks = kept.select("import_id", "arrival", F.lit(True).alias("__kept"))
    outcomes = staged.join(marks, ["import_id", "arrival"], "left").select(
        "import_id", "arrival", P.normalize_path(F.col("relative_path")).alias("relative_path"),
        F.when(F.col("skip_reason").isNotNull(), "skipped")
        .when(F.col("__failed"), "failed")
        .when(F.col("__kept"), "imported")
        .otherwise("duplicate")
        .alias("outcome"),
        "skip_reason", "byte_size",
    )

    identity = ["product_name", "product_slug", "folder_path", "category", "import_id", "created_at"]
    described = first_by(
        kept.select("product_id", "arrival", *identity), ["product_id"], F.col("arrival"), identity
    )
    products = described.join(product_counters(numbered), "product_id")
    return outcomes, products, reuse_analyses(numbered, analyses, engine_version)


def import_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_files") for o in ("imported", "duplicate", "skipped", "failed")],
    )


def scan_summary(files: DataFrame) -> DataFrame:
    """What a picked folder holds before upload: accepted files, products, bytes, skip reasons."""
    grouped = group_products(classify(files))
    accepted = F.col("skip_reason").isNull()
    product = F.when(accepted, F.col("product_id"))
    return grouped.groupBy("import_id").agg(
        F.count_if(accepted).alias("accepted"),
        F.countDistinct(product).alias("products"),
        F.coalesce(F.sum(F.when(accepted, F.col("byte_size"))), F.lit(0)).alias("total_bytes"),
        *[
            F.count_if(F.col("skip_reason") == r).alias(r)
            for r in ("system_file", "empty", "too_large", "unsupported_type")
        ],
    )


def analysis_requests(images: DataFrame, force: bool = False) -> DataFrame:
    """One request per content hash, however many images share it."""
    suffix = ":force" if force else ""
    key = F.concat(dedupe_key("vision", F.col("source_hash")), F.lit(suffix))
    return first_by(
        images.select("source_hash", "image_id", "storage_key", key.alias("dedupe_key"), F.lit(10).alias("priority")),
        ["source_hash"], F.col("image_id"),
    )


def reanalysis_worklist(images: DataFrame, force: bool = False, all_pending: bool = False) -> DataFrame:
    """Images to analyse again: of one import (not ready, or all), or the sweep over all imports.

    The sweep takes pending, unavailable and failed images but leaves those being processed alone.
    """
    if all_pending:
        keep: Column = F.col("vision_status").isin("pending", "unavailable", "failed")
    else:
        keep = F.lit(True) if force else F.col("vision_status") != "ready"
    return images.filter(keep)


def propagate_status(images: DataFrame, results: DataFrame) -> DataFrame:
    """Content-addressed: one result settles every image with the same bytes."""
    fresh = results.select("source_hash", F.col("status").alias("__status"))
    return images.join(fresh, "source_hash", "left").withColumn(
        "vision_status", F.coalesce("__status", "vision_status")
    ).drop("__status")


def pack_by_bytes(
    files: DataFrame, keys: list[str], order: str, size: str = "byte_size", max_bytes: int = vocab.MAX_REQUEST_BYTES,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Greedy units bounded by bytes, in order; an oversize file goes alone. ``order`` is unique per key.

    Where a unit starts depends on where the previous one ended. Small keys are one streaming fold
    each. When a key exceeds ``max_group_rows`` it is range partitioned into blocks, and units are found as steps to
    "the first file of the next unit", by pointer doubling over blocks: see ``_pack_in_blocks``.
    """
    narrow = files.select(*keys, order, size)
    if largest_group(narrow, keys) <= max_group_rows:
        entry = narrow.withColumns({"__part": F.lit(0), "__open": F.lit(None).cast("double")})
        return _fold_units(entry, keys, order, size, max_bytes).select(*narrow.columns, "unit_id")
    return _pack_in_blocks(narrow, keys, order, size, max_bytes)


def _starts(sizes: np.ndarray, before: float, max_bytes: float) -> tuple[np.ndarray, np.ndarray]:
    """Bytes up to and with each file, and the first file of the unit after the one that starts at each (may be the end)."""
    ends = before + np.cumsum(sizes)
    follow = np.searchsorted(ends, ends - sizes + max_bytes, side="right")
    return ends, np.maximum(follow, np.arange(1, len(sizes) + 1))


def _last_start(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last unit start of the block that each start leads to, and the units on the way with its own."""
    at = np.arange(len(follow))
    step = np.where(follow < len(follow), follow, at)
    units = (step != at).astype(np.int64)
    while (step[step] != step).any():
        units, step = units + units[step], step[step]
    return step, units + 1


def _exits(ends: np.ndarray, sizes: np.ndarray, last: np.ndarray, max_bytes: float) -> np.ndarray:
    """What a chain leaves the block with: the bytes its open unit reaches to, or -1 if that holds one file too large."""
    return np.where(sizes[last] > max_bytes, -1.0, ends[last] - sizes[last] + max_bytes)


def _pack_in_blocks(narrow: DataFrame, keys: list[str], order: str, size: str, max_bytes: int) -> DataFrame:
    """Greedy units of keys too large for one task.

    A chain of units enters a block, leaves it with the bytes its open unit still reaches to, and enters a later block at the
    first file beyond them; -1 stands for a block's first file. Chains that enter a block at different files soon run
    together, so few such entries exist. They are the nodes of a graph in which each has one successor. The
    nodes that the key's first file leads to are found in as many rounds as the number of blocks has binary digits, each
    round doubling the steps; then every block is numbered by itself. A block is one task's rows.
    """
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(narrow.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()))
    along = Window.partitionBy(*keys).orderBy("__part")
    sums = placed.groupBy(*keys, "__part").agg(F.sum(size).cast("double").alias("__sum")).withColumn("__cell", F.monotonically_increasing_id())
    # One row per (key, block): at most the number of partitions for each key.
    cells = stored(stored(sums).withColumns({
        "__end": F.sum("__sum").over(along), "__key": F.first("__cell").over(along)}).withColumn("__before", F.col("__end") - F.col("__sum")))
    same = reduce(and_, [placed[k].eqNullSafe(cells[k]) for k in keys], placed["__part"] == cells["__part"])
    blocks = stored(placed.join(cells, same).select(*[placed[k] for k in keys], placed[order], placed[size], "__cell", "__key", "__before"))
    routes = stored(cells.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__part", "__cell", "__end"))).alias("__way")))

    def routed(exits: DataFrame) -> DataFrame:
        """The (cell, reach) at which chains that leave ``__cell`` with ``__reach`` enter next; none at the end of the key."""
        beyond = F.size(F.filter("__way", lambda c: c["__end"] <= F.col("__reach")))
        own = F.array_position(F.transform("__way", lambda c: c["__cell"]), F.col("__cell")).cast("int")
        place = F.when(F.col("__reach") >= 0, beyond).otherwise(own)  # positions count from one, places from nought
        return exits.join(routes, "__key").withColumn("__to", F.get(F.col("__way"), place)["__cell"]).drop("__way")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order)[size].to_numpy(dtype=float)
        ends, follow = _starts(sizes, pdf["__before"].iloc[0], max_bytes)
        found = np.unique(_exits(ends, sizes, np.unique(_last_start(follow)[0]), max_bytes))
        return pd.DataFrame({"__key": pdf["__key"].iloc[0], "__cell": pdf["__cell"].iloc[0], "__reach": found})

    def follow_up(pdf: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order)[size].to_numpy(dtype=float)
        ends, follow = _starts(sizes, pdf["__before"].iloc[0], max_bytes)
        last, units = _last_start(follow)
        at = np.where(nodes["__entry"] < 0, 0, np.searchsorted(ends, nodes["__entry"].to_numpy(), side="right"))
        return pd.DataFrame({
            "__key": pdf["__key"].iloc[0], "__cell": pdf["__cell"].iloc[0], "__entry": nodes["__entry"].to_numpy(), "__units": units[at],
            "__reach": _exits(ends, sizes, last[at], max_bytes)})

    exits = blocks.groupBy("__cell").applyInPandas(leave, "__key long, __cell long, __reach double")
    entries = routed(exits).where("__to is not null").select(
        F.col("__to").alias("__cell"), F.when(F.col("__reach") >= 0, F.col("__reach")).otherwise(-1.0).alias("__entry"))
    first = cells.where("__cell = __key").select("__cell", F.lit(-1.0).alias("__entry"))
    nodes = stored(entries.union(first).distinct())
    steps = stored(routed(blocks.join(nodes.select("__cell").distinct(), "__cell", "left_semi").groupBy("__cell").cogroup(nodes.groupBy("__cell")).applyInPandas(
        follow_up, "__key long, __cell long, __entry double, __units long, __reach double"
    )).withColumn("__next", F.when(F.col("__to").isNotNull(), F.greatest("__reach", F.lit(-1.0)))))

    reached = stored(first)
    jump = stored(steps.where("__to is not null").select("__cell", "__entry", "__to", "__next"))
    while not jump.isEmpty():
        ahead = reached.join(jump, ["__cell", "__entry"]).select(F.col("__to").alias("__cell"), F.col("__next").alias("__entry"))
        reached = stored(reached.union(ahead).distinct())
        onward = jump.select(F.col("__cell").alias("__to"), F.col("__entry").alias("__next"), F.col("__to").alias("__to2"), F.col("__next").alias("__next2"))
        jump = stored(jump.join(onward, ["__to", "__next"]).select("__cell", "__entry", F.col("__to2").alias("__to"), F.col("__next2").alias("__next")))

    taken = steps.join(reached, ["__cell", "__entry"]).select("__cell", "__entry", "__units")
    numbered = stored(cells.select("__cell", "__key", "__part").join(taken, "__cell", "left").withColumn(
        "__past", F.coalesce(F.sum("__units").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("__cell", "__entry", "__past"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = pdf[size].to_numpy(dtype=float)
        ends, follow = _starts(sizes, pdf["__before"].iloc[0], max_bytes)
        starts, entry = np.zeros(len(pdf), dtype=np.int64), pdf["__entry"].iloc[0]
        at = len(pdf) if pd.isna(entry) else 0 if entry < 0 else int(np.searchsorted(ends, entry, side="right"))
        while at < len(pdf):
            starts[at] = 1
            at = follow[at]
        return pdf[[*keys, order, size]].assign(unit_id=(pdf["__past"].iloc[0] - 1 + np.cumsum(starts)).astype(np.int32))

    schema = StructType([*narrow.schema.fields, StructField("unit_id", IntegerType())])
    return blocks.join(numbered, "__cell").groupBy("__cell").applyInPandas(number, schema)


def _fold_units(rows: DataFrame, keys: list[str], order: str, size: str, max_bytes: int) -> DataFrame:
    """Fold each (key, block) from its open bytes; adds unit_id inside the block and the running total.

    Rows stream in sorted order: memory holds one Arrow batch and one running total.
    """
    cell = [*keys, "__part"]
    schema = StructType([
        *rows.schema.fields, StructField("unit_id", IntegerType()), StructField("__total", DoubleType())
    ])

    def fold(batches):
        current, unit, total = None, 0, 0.0
        for pdf in batches:
            units, totals = [], []
            tags = pdf[cell].itertuples(index=False, name=None)
            for tag, opened, weight in zip(tags, pdf["__open"].tolist(), pdf[size].tolist()):
                fresh = tag != current
                if fresh:
                    carried = opened is not None and opened == opened
                    current, unit, total = tag, 0, opened if carried else 0.0
                if total + weight > max_bytes and (not fresh or carried):
                    unit, total = unit + 1, 0.0
                total += weight
                units.append(unit)
                totals.append(total)
            yield pdf.assign(unit_id=units, __total=totals).astype({"unit_id": "int32"})

    return rows.repartition(*cell).sortWithinPartitions(*cell, order).mapInPandas(fold, schema)
