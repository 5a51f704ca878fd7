"""Keyed tables: what a write touches, crashes between its steps, sketches, replays."""

import os

import pytest
from pyspark.sql import functions as F

from framejobs.sources import keyed


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v int")


def content(spark, path, **options):
    return sorted(map(tuple, keyed.read(spark, path, **options).collect()))


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    keyed.upsert(frame(spark, [(k, 0) for k in range(500)]), path, ["k"], F.col("v"), buckets=64)
    before = keyed.manifest(spark, path)
    keyed.upsert(frame(spark, [(3, 7), (3, 9), (900, 1)]), path, ["k"], F.col("v"))
    after = keyed.manifest(spark, path)
    changed = {b for b in after.runs if after.runs[b] != before.runs.get(b)}
    assert len(changed) <= 2 and len(after.runs) >= 60
    assert content(spark, path) == sorted([(k, 0) for k in range(500) if k != 3] + [(3, 9), (900, 1)])
    assert content(spark, path, before=after.version) == [(k, 0) for k in range(500)]


@pytest.mark.parametrize("step", ["_write_run", "commit", "rename"])
@pytest.mark.parametrize("kind", ["upsert", "append"])
def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, step, kind):
    path = f"{tmp_path}/t"
    write = (lambda rows: keyed.upsert(frame(spark, rows), path, ["k"], F.col("v"))) if kind == "upsert" else (
        lambda rows: keyed.append_new(frame(spark, rows), path, ["k"]))
    write([(1, 1), (2, 1)])
    whole = getattr(keyed, "commit" if step == "rename" else step)

    def broken(*args):
        if step == "_write_run":
            whole(*args)  # the run is there, nothing refers to it
        if step == "rename":
            open(f"{path}/manifest/_cut", "w").close()
        raise KeyboardInterrupt

    monkeypatch.setattr(keyed, "commit" if step == "rename" else step, broken)
    with pytest.raises(KeyboardInterrupt):
        write([(2, 5), (3, 5)])
    assert content(spark, path) == [(1, 1), (2, 1)]
    monkeypatch.undo()
    write([(2, 5), (3, 5)])
    want = [(1, 1), (2, 5 if kind == "upsert" else 1), (3, 5)]
    assert content(spark, path) == want
    keyed.vacuum(spark, path, 1)
    assert content(spark, path) == want and len(os.listdir(f"{path}/manifest")) - len([n for n in os.listdir(f"{path}/manifest") if n.endswith(".crc")]) == 1


def test_replayed_version_is_harmless(spark, tmp_path):
    path = f"{tmp_path}/t"
    for version, rows in ((1, [(1, 1)]), (2, [(1, 2), (2, 2)]), (2, [(1, 9)])):
        keyed.upsert(frame(spark, rows), path, ["k"], F.col("v"), version=version)
    assert content(spark, path) == [(1, 2), (2, 2)]


def test_append_reads_only_where_a_sketch_hits(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    keyed.append_new(frame(spark, [(k, 0) for k in range(2000)]), path, ["k"], buckets=64)
    read = []
    rows = keyed._rows
    monkeypatch.setattr(keyed, "_rows", lambda spark, schema, parts: read.append(parts) or rows(spark, schema, parts))
    fresh = keyed.append_new(frame(spark, [(5, 1), (5, 1), (100_000, 1)]), path, ["k"])
    assert [tuple(r) for r in fresh.collect()] == [(100_000, 1)]
    assert len(read) == 1 and len(read[0]) == 1 and "bucket=" in read[0][0]
    read.clear()
    keyed.append_new(frame(spark, [(k, 2) for k in range(200_000, 200_020)]), path, ["k"])
    assert sum(map(len, read)) <= 3  # none but a rare false hit
    assert keyed.read(spark, path).count() == 2021


def test_many_appends_merge_runs(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in range(6):
        keyed.append_new(frame(spark, [(k, n) for k in range(n * 50, n * 50 + 80)]), path, ["k"], buckets=4, max_runs=2)
    state = keyed.manifest(spark, path)
    assert all(len(of) <= 2 for of in state.runs.values())
    assert content(spark, path) == [(k, 0 if k < 80 else (k - 30) // 50) for k in range(330)]


def test_empty_and_null(spark, tmp_path):
    path = f"{tmp_path}/t"
    keyed.upsert(frame(spark, []), path, ["k"], F.col("v"))
    assert content(spark, path) == []
    keyed.append_new(frame(spark, [(1, 1)]), path, ["k"])
    keyed.append_new(frame(spark, []), path, ["k"])
    assert content(spark, path) == [(1, 1)]
    for v in (2, 3):
        keyed.append_new(frame(spark, [(None, v)]), path, ["k"])
    assert keyed.read(spark, path).where("k is null").collect()[0].v == 2
    keyed.upsert(frame(spark, [(None, 4)]), path, ["k"], F.col("v"))
    assert [r.v for r in keyed.read(spark, path).where("k is null").collect()] == [4]
