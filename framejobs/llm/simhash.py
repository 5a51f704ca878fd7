"""SimHash near-dedup: pigeonhole blocks, joined by sorting, verified by Hamming distance.

A fingerprint is cut into ``blocks`` slices. Two fingerprints at ``distance`` or fewer differing bits agree on at
least ``blocks - distance`` slices, so they meet in the table of one such choice of slices. More slices mean more
tables with longer keys; the number follows the count of distinct fingerprints, and every choice is exact.

Equal fingerprints are one row before the tables are built. A bucket larger than ``tile`` is cut into tiles, and
every pair of tiles is compared as a unit of its own, so no task holds a whole bucket and no pair is lost. Units
are compared in place over sorted partitions and give a spanning forest of their links, never their pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.common import components, merge_labels, shuffle_partitions, spread_join
from framejobs.session import stored

BITS = 64


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the lower-cased word shingles of a text; zero if it has no word."""
    tokens = text.encode("utf-8").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1:].tolist())]
    values = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(values), 1 << 14):
        part = np.unpackbits(values[start:start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(values)).tolist())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keys: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, *keys, fp)`` of every row; ``fp`` is the fingerprint as a signed long, as are ``keys``."""
    def run(batches):
        for pdf in batches:
            yield pdf[["doc_id", *keys]].assign(
                fp=np.array([_signed(fingerprint(t, words)) for t in pdf["text"]], dtype=np.int64))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.col(text_col).alias("text"))
    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", *keys, "fp")))


def slices(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each slice."""
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def table_masks(blocks: int, distance: int) -> list[int]:
    """One bit mask for each choice of slices that two close fingerprints may agree on."""
    pieces = slices(blocks)
    return [sum(((1 << n) - 1) << first for first, n in chosen) for chosen in combinations(pieces, blocks - distance)]


def blocks_for(rows: int, distance: int) -> int:
    """Slices for which random fingerprints give less than about one chance meeting a row and table."""
    blocks = distance + 1
    while BITS * (blocks - distance) // blocks < np.log2(max(2, rows)) and blocks < distance + 5:
        blocks += 1
    return blocks


def _close(distance: int):
    """Compare within runs of equal unit keys of a sorted partition; yields the forest of the links found."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().astype(np.uint64)
        side = pdf["side"].to_numpy()
        unit = pd.factorize(pd.MultiIndex.from_frame(pdf[["number", "bucket", "low", "high"]]))[0]
        cross = (pdf["low"] != pdf["high"]).to_numpy()
        labels, left, step = np.arange(len(pdf)), np.arange(len(pdf)), 1
        while len(left := left[left + step < len(pdf)]):
            left = left[unit[left] == unit[left + step]]
            right = left + step
            near = np.bitwise_count(fps[left] ^ fps[right]) <= distance
            near &= ~cross[left] | (side[left] != side[right])
            labels = merge_labels(labels, left[near], right[near])
            step += 1
        child = np.flatnonzero(labels != np.arange(len(pdf)))
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[child], "b": signed[labels[child]]})

    def run(batches):
        keys, rest = ["number", "bucket", "low", "high"], None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(pdf) - int(last[::-1].argmin() if not last.all() else len(last))
            if cut:
                yield links(pdf.iloc[:cut])
            rest = pdf.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def near_links(distinct: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = 2048) -> DataFrame:
    """Links ``(a, b)`` whose components equal those of all pairs of ``distinct.fp`` within ``distance`` bits."""
    blocks = blocks or blocks_for(distinct.count(), distance)
    masks = [_signed(m) for m in table_masks(blocks, distance)]
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("number", "bucket"))
    sizes = stored(rows.groupBy("number", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tiles = F.ceil(F.col("n") / tile)
    units = (
        rows.join(sizes, ["number", "bucket"])
        .withColumn("side", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
        .select("fp", "number", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    keys = ["number", "bucket", "low", "high"]
    return (
        units.repartition(shuffle_partitions(distinct), *keys).sortWithinPartitions(*keys)
        .mapInPandas(_close(distance), "a long, b long")
    )


def survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
    blocks: int | None = None, tile: int = 2048,
) -> DataFrame:
    """One row of each component of near copies, with all columns of ``docs``: that of the smallest id, null ids last; of
    several rows with that id the one with the smallest row hash. Rows are told apart by a 128-bit hash of all their columns, never by
    their id. Links as in ``near_duplicates``.
    """
    every = [c for name in docs.columns for c in (F.col(name), F.col(name).isNull())]
    keyed = docs.withColumn("__h1", F.xxhash64(*every)).withColumn("__h2", F.xxhash64(F.lit(7), *every))
    keys = ["__h1", "__h2"]
    marked = stored(fingerprints(keyed, id_col, text_col, words, tuple(keys)))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *keys)
    classes = stored(marked.groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(stored(near_links(classes.select("fp"), distance, blocks, tile)))
    rooted = stored(
        classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    stay = stored(rooted.groupBy("root").agg(F.min("first").alias("of")).select("of.__h1", "of.__h2"))
    gone = stored(marked.select(*keys).distinct().join(stay, keys, "left_anti"))
    rows = keyed.join(gone, keys, "left_anti")
    if marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(keys)  # rows equal in all columns
    return rows.drop(*keys)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
    blocks: int | None = None, tile: int = 2048,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``.

    Whole texts are read. Null and wordless texts have fingerprint zero and link like any other. Exact: every
    pair at ``distance`` or fewer bits is linked, none beyond. ``component_id`` is the smallest id reachable, the
    document included; among rows of equal ids all are returned and all of the smallest are kept. A null id takes part in links and never names a
    component unless all ids of its component are null. An empty table gives an empty result; extra columns are ignored.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(stored(near_links(classes.select("fp"), distance, blocks, tile)))
    rooted = stored(
        classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    of_fp = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
