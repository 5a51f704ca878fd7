"""Keyed tables: rows dealt to buckets by their key, in immutable runs under a versioned manifest.

A write adds one run, a folder with a part for each bucket it touches, and then one manifest that says which runs make
up which bucket. The manifest appears by a single rename, so a reader sees a version whole or not at all, and a crash
before it leaves only files nobody refers to. Buckets that a write does not touch keep their runs.

``upsert`` rewrites the touched buckets. ``append_new`` only adds runs; each run carries Bloom sketches of its keys, so
later appends read the keys of those buckets alone whose sketch may hold one of theirs. There is one writer to a table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from framejobs.operators.ranking import last_by
from framejobs.session import stored

#: Runs of a bucket beyond which an append merges them.
MAX_RUNS = 8
#: Bloom sketch: positions a key sets, and bits a key is given.
HASHES, BITS_PER_KEY = 4, 16


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: dict
    runs: dict[int, list[str]] = field(default_factory=dict)
    sketch_bits: dict[str, int] = field(default_factory=dict)

    def parts(self, path: str, buckets: set[int] | None = None) -> list[str]:
        return [
            f"{path}/runs/{run}/bucket={b}" for b, runs in sorted(self.runs.items()) if buckets is None or b in buckets for run in runs]


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, before: int | None = None) -> Manifest | None:
    """The newest manifest, or the newest of a version under ``before``; none where the table has none."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    if not known:
        return None
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/manifest/{known[-1]:012d}").collect())
    data = json.loads(text)
    return Manifest(data["version"], data["keys"], data["buckets"], data["schema"],
                    {int(b): runs for b, runs in data["runs"].items()}, data["sketch_bits"])


def commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Make a version visible: the manifest is written aside and moved into place in one step."""
    aside, target = f"{path}/manifest/_{uuid.uuid4().hex}", f"{path}/manifest/{new.version:012d}"
    fs, source = _fs(spark, aside)
    out = fs.create(source, False)
    out.write(bytearray(json.dumps(new.__dict__).encode("utf-8")))
    out.close()
    fs, final = _fs(spark, target)
    if fs.exists(final) or not fs.rename(source, final):
        raise RuntimeError(f"version {new.version} of {path} was written by someone else")


def _rows(spark: SparkSession, schema: dict, parts: list[str]) -> DataFrame:
    kind = StructType.fromJson(schema)
    if not parts:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*parts)


def read(spark: SparkSession, path: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The rows of the newest version, or of the newest under ``before``, optionally of some buckets only."""
    current = manifest(spark, path, before)
    if current is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    return _rows(spark, current.schema, current.parts(path, buckets))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``known`` does not have; a null is a value like any other."""
    other = known.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return rows.join(other, reduce(and_, [rows[k].eqNullSafe(other[f"__{k}"]) for k in keys]), "left_anti")


def _touched(rows: DataFrame) -> set[int]:
    """Buckets with rows: at most as many numbers as there are buckets."""
    return {r.bucket for r in rows.select("bucket").distinct().collect()}


def _write_run(rows: DataFrame, path: str) -> str:
    run = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/runs/{run}")
    return run


def _start(df: DataFrame, keys: list[str], buckets: int | None) -> Manifest:
    """A table without rows; its buckets are for good, and as many as the cluster shuffles to unless the caller says otherwise."""
    return Manifest(0, list(keys), buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.schema.jsonValue())


def _base(df: DataFrame, path: str, keys: list[str], buckets: int | None, version: int | None) -> tuple[Manifest, bool]:
    """The manifest to build on, and whether ``version`` is there already."""
    spark = df.sparkSession
    if version is not None and version in versions(spark, path):
        return manifest(spark, path, version + 1), True
    return manifest(spark, path, version) or _start(df, keys, buckets), False


def upsert(
    df: DataFrame, path: str, keys: list[str], order: Column, buckets: int | None = None, version: int | None = None,
) -> Manifest:
    """Overwrite on key: the newest row of ``df`` per key replaces the table's, whatever the order says of that one.

    Only buckets with incoming keys are read and written. With a ``version`` the write happens once: it builds on the
    versions under it, and a version that is there already is left alone, so a replayed batch is harmless.
    """
    spark = df.sparkSession
    current, done = _base(df, path, keys, buckets, version)
    if done:
        return current
    columns = [f["name"] for f in current.schema["fields"]]
    incoming = stored(last_by(df.select(*columns), keys, order).withColumn("bucket", _bucket(keys, current.buckets)))
    touched = _touched(incoming)
    before = _rows(spark, current.schema, current.parts(path, touched & set(current.runs)))
    stays = _without(before, incoming, keys).withColumn("bucket", _bucket(keys, current.buckets))
    runs = dict(current.runs)
    if touched:
        run = _write_run(stays.unionByName(incoming), path)
        runs |= {b: [run] for b in touched}
    new = replace(current, version=version if version is not None else current.version + 1, runs=runs)
    commit(spark, path, new)
    return new


def _places(keys: list[str], bits: Column) -> Column:
    """The positions a key sets in a sketch of ``bits`` bits, a power of two."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), bits) for i in range(HASHES)])


def _write_sketches(rows: DataFrame, path: str, run: str, keys: list[str], bits: int) -> None:
    """The sketches of a run, a row for each word of 64 bits that is not empty."""
    placed = rows.select("bucket", F.explode(_places(keys, F.lit(bits))).alias("at"))
    words = placed.groupBy("bucket", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    words.write.parquet(f"{path}/sketches/{run}")


def _may_hold(incoming: DataFrame, current: Manifest, path: str, touched: set[int]) -> set[tuple[int, str]]:
    """Which (bucket, run) may hold a key of ``incoming``, by the sketches alone; bounded by the manifest."""
    spark = incoming.sparkSession
    pairs = [(b, run, current.sketch_bits[run]) for b in touched & set(current.runs) for run in current.runs[b]]
    if not pairs:
        return set()
    runs = spark.createDataFrame(pairs, "bucket int, run string, size long")
    read_runs = sorted({run for _, run, _ in pairs})
    sketches = None
    for run in read_runs:
        rows = spark.read.parquet(f"{path}/sketches/{run}").withColumn("run", F.lit(run))
        sketches = rows if sketches is None else sketches.unionByName(rows)
    asked = incoming.select("bucket", F.xxhash64(*current.keys).alias("key"), *current.keys).join(F.broadcast(runs), "bucket").select(
        "bucket", "run", "key", F.explode(_places(current.keys, F.col("size"))).alias("at"),
    ).select("bucket", "run", "key", F.shiftright("at", 6).alias("word"), F.expr("CAST(at % 64 AS INT)").alias("bit"))
    hits = (
        asked.join(sketches, ["bucket", "run", "word"]).where(F.expr("shiftright(bits, bit) & 1") == 1)
        .groupBy("bucket", "run", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HASHES)
    )
    return {(r.bucket, r.run) for r in hits.select("bucket", "run").distinct().collect()}


def append_new(
    df: DataFrame, path: str, keys: list[str], buckets: int | None = None, version: int | None = None, max_runs: int = MAX_RUNS,
) -> DataFrame:
    """Append the rows whose key the table does not have yet; returns them.

    Sketches say which runs may hold an incoming key; only their keys are read for the exact test. A bucket of more than
    ``max_runs`` runs is merged on the way. With a ``version`` a replayed batch is harmless, as in ``upsert``.
    """
    spark = df.sparkSession
    current, done = _base(df, path, keys, buckets, version)
    columns = [f["name"] for f in current.schema["fields"]]
    if done:
        return spark.createDataFrame([], StructType.fromJson(current.schema))
    incoming = stored(df.select(*columns).dropDuplicates(keys).withColumn("bucket", _bucket(keys, current.buckets)))
    touched = _touched(incoming)
    held = sorted(_may_hold(incoming, current, path, touched))
    fresh = incoming
    if held:
        known = _rows(spark, current.schema, [f"{path}/runs/{run}/bucket={b}" for b, run in held]).select(*keys)
        fresh = stored(_without(incoming, known, keys))
        touched = _touched(fresh)
    full = {b for b in touched if len(current.runs.get(b, [])) >= max_runs}
    rows = fresh
    if full:
        old = _rows(spark, current.schema, current.parts(path, full)).withColumn("bucket", _bucket(keys, current.buckets))
        rows = fresh.unionByName(old)
    runs, sketch_bits = dict(current.runs), dict(current.sketch_bits)
    if touched:
        run = _write_run(rows, path)
        written = spark.read.schema(rows.schema).parquet(f"{path}/runs/{run}")
        largest = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
        bits = 64
        while bits < largest * BITS_PER_KEY:
            bits *= 2
        _write_sketches(written, path, run, keys, bits)
        sketch_bits[run] = bits
        for b in touched:
            runs[b] = [run] if b in full else [*runs.get(b, []), run]
    used = {run for of in runs.values() for run in of}
    commit(spark, path, replace(
        current, version=version if version is not None else current.version + 1, runs=runs,
        sketch_bits={run: n for run, n in sketch_bits.items() if run in used}))
    return fresh.select(*columns)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what the newest ``keep`` versions do not refer to; not while a write is under way."""
    known = versions(spark, path)
    stay = [manifest(spark, path, v + 1) for v in known[-keep:]]
    used = {run for m in stay for of in m.runs.values() for run in of}
    for name, live in (("manifest", {f"{m.version:012d}" for m in stay}), ("runs", used), ("sketches", used)):
        fs, folder = _fs(spark, f"{path}/{name}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)
