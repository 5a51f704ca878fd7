"""Embedding near-dedup by buckets of rotated cross-polytope hashes.

Every pass rotates the vectors, gives each a short string of random hashes and compares all vectors whose strings are
equal with each other. Verified pairs of all passes are united.

* Equal vectors are one class from the start (128-bit content hash), so thousands of copies cost one row.
* A hash symbol is the axis of a rotated vector with the largest magnitude, with its sign (cross-polytope hash):
  2d values, far more selective than sign bits at the same chance of collision.
* A bucket is compared whole, however dense: one larger than a tile is cut into tiles, and every pair of tiles is a unit of
  its own, so no task holds a whole bucket and no pair of a bucket is lost. Whether a pair meets in a pass thus depends on its own two
  vectors alone, and the number of passes follows from that chance.
* The length of the strings follows from the measured sizes of the buckets.
* Rows know their bucket in every pass. A pair counts in the first pass in which it meets, so link counts need no
  table of pairs: units of bounded size emit one count per row and a spanning forest of their links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from framejobs.llm.common import components, merge_labels
from framejobs.session import stored

#: Symbols of a hash string at most.
SYMBOLS = 4
#: Passes that bucket sizes are measured on.
MEASURED = 2
#: Comparisons that cost about as much as moving one row to its bucket.
ROW_COST = 1000


def agreement(dimension: int, threshold: float) -> float:
    """Chance that one hash symbol agrees for two vectors at cosine ``threshold``, by simulation, less three standard errors."""
    if dimension < 2:
        return 0.999
    n = max(2000, min(20000, (1 << 23) // dimension))
    x, y = np.random.default_rng(dimension).standard_normal((2, n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y
    top, other = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
    at = np.arange(n)
    p = float(((top == other) & ((x[at, top] < 0) == (y[at, other] < 0))).mean())
    return min(0.999, max(0.01, p - 3 * math.sqrt(p * (1 - p) / n)))


def passes_for(depth: int, agree: float, recall: float) -> int:
    """Passes after which a pair whose strings of ``depth`` symbols agree with chance ``agree ** depth`` has met with chance ``recall``."""
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree**depth)))


def rotation(seed: int, number: int, symbol: int, dimension: int) -> np.ndarray:
    gauss = np.random.default_rng([seed, number, symbol, dimension]).standard_normal((dimension, dimension))
    return np.linalg.qr(gauss)[0]


def _codes(passes: int, depth: int, seed: int, every: bool = False):
    """The hash string of each pass as one number; of each of its beginnings too if ``every``. Numbers that wrap around only
    merge buckets."""
    def run(batches):
        turned: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in batches:
            sizes = pdf["embedding"].map(len).to_numpy()
            out = np.empty((len(pdf), passes, depth), dtype=np.int64)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = np.stack(pdf["embedding"].to_numpy()[rows]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                for p in range(passes):
                    code = np.full(len(rows), d, dtype=np.int64)
                    for s in range(depth):
                        key = (p, s, int(d))
                        if key not in turned:
                            turned[key] = rotation(seed, *key)
                        y = x @ turned[key]
                        top = np.abs(y).argmax(axis=1)
                        code = code * (2 * d) + 2 * top + (y[np.arange(len(y)), top] < 0)
                        out[rows, p, s] = code
            yield pdf.assign(codes=list(out.reshape(len(pdf), -1) if every else out[:, :, -1]))

    return run


def depth_for(reps: DataFrame, total: int, agree: float, recall: float, passes: int | None, seed: int) -> int:
    """Symbols for which moving all rows to their buckets and comparing these costs least, over all passes needed."""
    if passes is not None:
        return max([k for k in range(1, SYMBOLS + 1) if passes_for(k, agree, recall) <= passes], default=1)
    codes = reps.select("rep", "embedding").mapInPandas(
        lambda batches: (pdf[["codes"]] for pdf in _codes(MEASURED, SYMBOLS, seed, True)(batches)), "codes array<long>")
    pairs = (
        codes.select(F.posexplode("codes").alias("at", "code")).groupBy("at", "code").agg(F.count(F.lit(1)).alias("n"))
        .groupBy((F.col("at") % SYMBOLS + 1).alias("depth")).agg((F.sum(F.col("n").cast("double") * F.col("n")) / MEASURED).alias("pairs"))
    )
    cost = {r.depth: passes_for(r.depth, agree, recall) * (total * ROW_COST + r.pairs) for r in pairs.collect()}
    return min(cost, key=lambda k: (cost[k], k), default=1)


def _compare(threshold: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        number, cross = int(key[0]), key[2] != key[3]
        codes = np.stack(pdf["codes"].to_numpy())
        ids, copies, side = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        sizes = pdf["embedding"].map(len).to_numpy()
        labels, counts = np.arange(len(pdf)), np.zeros(len(pdf), dtype=np.int64)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = np.stack(pdf["embedding"].to_numpy()[rows]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            for start in range(0, len(rows), 256):
                i, j = np.nonzero(x[start:start + 256] @ x[start:].T >= threshold)
                i, j = rows[start + i[i < j]], rows[start + j[i < j]]
                if cross:
                    apart = side[i] != side[j]
                    i, j = i[apart], j[apart]
                for q in range(number):
                    new = codes[i, q] != codes[j, q]
                    i, j = i[new], j[new]
                counts += np.bincount(i, copies[j], len(pdf)).astype(np.int64) + np.bincount(j, copies[i], len(pdf)).astype(np.int64)
                labels = merge_labels(labels, i, j)
        linked, child = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(pdf)))
        return pd.DataFrame({
            "a": np.concatenate([ids[linked], ids[child]]),
            "b": np.concatenate([ids[linked], ids[labels[child]]]),
            "n": np.concatenate([counts[linked], np.zeros(len(child), dtype=np.int64)]),
        })

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    window: int = 1024, recall: float = 0.999, passes: int | None = None, seed: int = 7,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Compares all rows, whatever their other columns, by cosine in double precision. Null, empty or zero vectors and
    those with null or non-finite components link with nothing, nor do rows without an id (component null, kept).
    Vectors of different lengths never link. Repeated ids: one row, with the vector smallest in array order. An
    empty table gives an empty result. Links are verified, so none lies below ``threshold``; pairs that share
    no bucket in any pass are missed, which the pass count holds under 1 - ``recall`` for pairs at
    the threshold, however many vectors lie around them. ``window``: rows of one tile. Extra columns are ignored.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    anonymous = named.where("vec_id is null").select("vec_id")
    named = named.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = (F.size("embedding") > 0) & fine & F.exists("embedding", lambda x: x != 0)
    keyed = stored(named.select(
        "vec_id", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(seed), "embedding").alias("h2"),
    ))
    valid = keyed.where("usable")
    classes = stored(valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    members = valid.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "rep", "copies")
    reps = stored(
        valid.select(F.col("vec_id").alias("rep"), "embedding")
        .join(classes.select("rep", "copies"), "rep")
    )
    total = reps.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).head()
    agree = agreement(total[1] or 2, threshold)
    depth = depth_for(reps, total[0], agree, recall, passes, seed)
    if passes is None:
        passes = passes_for(depth, agree, recall)

    shape = T.StructType([*reps.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    coded = stored(reps.mapInPandas(_codes(passes, depth, seed), shape))
    large = stored(
        coded.select(F.posexplode("codes").alias("pass", "code")).groupBy("pass", "code").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > window)
    )
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / window).cast("int")
    units = (
        coded.select("*", F.posexplode("codes").alias("pass", "code")).join(large, ["pass", "code"], "left")
        .withColumn("side", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("n", "other")
    )
    found = stored(
        units.groupBy("pass", "code", "low", "high").applyInPandas(_compare(threshold), "a long, b long, n long")
    )
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("a", "b")).select(F.col("id").alias("rep"), "root")
    per_rep = stored(
        reps.select("rep").join(counts, "rep", "left").join(roots, "rep", "left")
        .select("rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    linked = members.join(per_rep, "rep").select(
        "vec_id", (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("root").alias("component_id"))
    alone = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).union(
        anonymous.select("vec_id", F.lit(0).cast("long"), F.lit(None).cast("long"))
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
