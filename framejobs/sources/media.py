"""Media files: listings, content addresses, blob audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framejobs.functions import paths as P


def scan_media(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Recursive listing of media roots as relative keys. File contents are never read."""
    parts = []
    for root, base in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        prefix = base.rstrip("/") + "/"
        bare = F.regexp_replace("path", r"\Afile:/*", "/")
        parts.append(files.select(
            F.lit(root).alias("root"), F.replace(bare, F.lit(prefix), F.lit("")).alias("key"),
            F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        ))
    return reduce(DataFrame.unionByName, parts)


def content_address(blobs: DataFrame, mime: Column) -> DataFrame:
    """Content hash and storage key of each blob (path, content)."""
    return blobs.withColumn("source_hash", P.content_hash(F.col("content"))).withColumn(
        "storage_key", P.original_key(F.col("source_hash"), mime)
    )


def safe_key(key: Column) -> Column:
    """True for a key that cannot leave its root."""
    climbs = F.exists(F.split(key, r"[/\\]"), lambda part: part == "..")
    return (key != "") & ~key.contains("\x00") & ~key.startswith("/") & ~climbs


def complete_jpeg(content: Column) -> Column:
    """Start and end markers present: a truncated transfer loses the end."""
    head, tail = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, -2, 2))
    return (F.length(content) > 4) & (head == "FFD8") & (tail == "FFD9")


def audit_blobs(blobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Unusable blobs with the first reason found.

    ``blobs``: key, content, width, height; ``expected``: key, length, width, height (each may be null).
    """
    want = expected.select(
        "key", F.col("length").alias("__length"), F.col("width").alias("__width"), F.col("height").alias("__height")
    )
    joined = blobs.join(want, "key", "left")
    size = F.length("content")
    off = lambda have, wanted: F.coalesce(~F.col(have).eqNullSafe(F.col(wanted)) & F.col(wanted).isNotNull(), F.lit(False))
    reason = (
        F.when(size == 0, "empty")
        .when((F.col("__length") > 0) & (size != F.col("__length")), "truncated")
        .when(F.hex(F.substring("content", 1, 2)) != "FFD8", "not_jpeg")
        .when(F.hex(F.substring("content", -2, 2)) != "FFD9", "incomplete")
        .when(off("width", "__width") | off("height", "__height"), "wrong_size")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("key", "reason")
