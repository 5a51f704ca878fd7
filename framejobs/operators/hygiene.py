"""Storage hygiene: reference counts, deletes with their cascade, orphan sweeps, usage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from framejobs.operators.ranking import first_by

ROOTED = ("root", "key")


def hash_refs(images: DataFrame) -> DataFrame:
    """Images and products per content hash."""
    return images.groupBy("source_hash").agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("product_id").alias("products")
    )


def duplicate_content(images: DataFrame) -> DataFrame:
    """Bytes that more than one product uses."""
    return hash_refs(images).filter(F.col("products") > 1)


def storage_usage(listing: DataFrame) -> DataFrame:
    """Files and bytes per media root, with a grand total."""
    return listing.rollup("root").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).withColumn("root", F.coalesce("root", F.lit("total")))


def purgeable(candidates: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split candidate hashes into those nobody uses any more and those still shared."""
    hashes = candidates.select("source_hash").distinct()
    live = survivors.select("source_hash")
    return hashes.join(live, "source_hash", "left_anti"), hashes.join(live, "source_hash", "left_semi")


#: Id column of each table.
ID = {
    "imports": "import_id", "products": "product_id", "images": "image_id", "creatives": "creative_id", "jobs": "job_id",
    "batches": "batch_id", "rules": "rule_id", "templates": "template_id",
}
#: Foreign keys a delete follows: (table, column, table it refers to). Parents come before children.
FOREIGN_KEYS = (
    ("products", "import_id", "imports"), ("images", "import_id", "imports"), ("images", "product_id", "products"),
    ("jobs", "batch_id", "batches"), ("rules", "template_id", "templates"), ("creatives", "product_id", "products"),
    ("creatives", "image_id", "images"), ("creatives", "template_id", "templates"), ("creatives", "batch_id", "batches"),
)
KINDS = {"import": "imports", "product": "products", "image": "images", "batch": "batches", "template": "templates", "creative": "creatives"}


def cascade(
    tables: dict[str, DataFrame], kind: str, ids: DataFrame, keys: tuple[tuple[str, str, str], ...] = FOREIGN_KEYS,
) -> dict[str, DataFrame]:
    """Rows a delete removes, by table. ``ids`` has one column, the id of ``kind``.

    The closure over the declared foreign keys: a table loses the rows that refer to anything lost before it, through any
    of its keys. The declaration has no circle, so one pass in its order is the whole recursion, a join for each
    key. Tables and columns that are not there are not followed.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    root = KINDS[kind]
    lost = {root: ids.select(ID[root]).distinct()}
    gone = {root: tables[root].join(lost[root], ID[root], "left_semi")} if root in tables else {}
    for table in dict.fromkeys(t for t, _, _ in keys):
        if table not in tables or table in lost:
            continue
        parents = [(column, parent) for t, column, parent in keys if t == table and parent in lost and column in tables[table].columns]
        if not parents:
            continue
        rows = tables[table]
        for i, (column, parent) in enumerate(parents):
            rows = rows.join(lost[parent].select(F.col(ID[parent]).alias(column), F.lit(True).alias(f"__{i}")), column, "left")
        refers = reduce(or_, [F.col(f"__{i}").isNotNull() for i in range(len(parents))])
        gone[table] = rows.where(refers).select(*tables[table].columns)
        lost[table] = gone[table].select(ID[table]).distinct()
    return gone


def survivors(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after a delete."""
    return {name: df.join(gone[name].select(ID[name]), ID[name], "left_anti") if name in gone else df for name, df in tables.items()}


def delete_impact(
    tables: dict[str, DataFrame], kind: str, ids: DataFrame, listing: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Dry run of a delete: (removed rows by table, files to remove, one-row report).

    ``listing`` is what is on disk (root, key, size); only files that exist count as freed.
    """
    gone = cascade(tables, kind, ids)
    outputs = gone["creatives"] if "creatives" in gone else tables["creatives"].limit(0)
    wanted = [outputs.select(F.lit("creatives").alias("root"), F.col("storage_key").alias("key"))]
    shared_count = None
    if "images" in gone:
        rest = survivors({"images": tables["images"]}, gone)["images"]
        dead, shared = purgeable(gone["images"], rest)
        shared_count = shared.agg(F.count(F.lit(1)).alias("shared_files_kept"))
        originals = first_by(
            gone["images"].select("source_hash", "storage_key", "image_id"), ["source_hash"], F.col("image_id")
        ).join(dead, "source_hash", "left_semi")
        wanted.append(originals.select(F.lit("originals").alias("root"), F.col("storage_key").alias("key")))
        # The whole derived tree of a hash goes; the hash is the third segment of its keys.
        trees = listing.filter(F.col("root") == "derived").withColumn("source_hash", F.get(F.split("key", "/"), F.lit(2)))
        wanted.append(trees.join(dead, "source_hash", "left_semi").select("root", "key"))
    keys = reduce(DataFrame.unionByName, wanted).distinct()
    files = listing.join(keys, list(ROOTED), "left_semi")
    parts = [files.agg(F.count(F.lit(1)).alias("files_deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed_bytes"))]
    parts += [
        gone[t].agg(F.count(F.lit(1)).alias(f"removed_{t}")) for t in ("products", "images", "creatives", "batches", "jobs", "rules")
        if t in gone
    ]
    if shared_count is not None:
        parts.append(shared_count)
    # One-row aggregates side by side: each part is a single row joined on a constant key.
    keyed = [p.withColumn("__k", F.lit(1)) for p in parts]
    report = reduce(lambda a, b: a.join(F.broadcast(b), "__k"), keyed).drop("__k")
    return gone, files, report


def sweep_orphans(listing: DataFrame, creatives: DataFrame, images: DataFrame) -> DataFrame:
    """Files on disk that no row refers to. Rows without a file are left alone."""
    outputs = listing.filter(F.col("root") == "creatives").join(
        creatives.select(F.col("storage_key").alias("key")), "key", "left_anti"
    )
    originals = listing.filter(F.col("root") == "originals").join(
        images.select(F.col("storage_key").alias("key")), "key", "left_anti"
    )
    derived = (
        listing.filter(F.col("root") == "derived")
        .withColumn("source_hash", F.get(F.split("key", "/"), F.lit(2)))
        .join(images.select("source_hash"), "source_hash", "left_anti")
        .drop("source_hash")
    )
    return outputs.unionByName(originals).unionByName(derived)


def sweep_report(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("root").agg(F.count(F.lit(1)).alias("orphans"), F.sum("size").alias("freed_bytes"))
