"""Stream jobs over disorder: the reorder buffer against the ordered fold, late rows, replays of the rollup."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framejobs.sources import keyed
from framejobs.streaming import jobs as SJ

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "job_id string, event string, ts timestamp, event_id bigint"
KINDS = "claim run heartbeat complete fail defer defer_refund park retry cancel reclaim".split()


class Cell:
    """Value, list and timers of one key, as the engine keeps them."""

    def __init__(self):
        self.row, self.rows, self.timers = None, [], []

    def exists(self):
        return self.row is not None or bool(self.rows)

    def get(self):
        return self.row if self.row is not None else iter(self.rows)

    def update(self, row):
        self.row = row

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = self.rows + list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def machine(stale_ms=None):
    m = SJ.JobMachine(stale_ms=stale_ms)
    m.state, m.waiting, m.handle = Cell(), Cell(), Cell()
    return m


def chunks(events, size=3):
    for i in range(0, len(events), size):
        yield pd.DataFrame([{"ts_ms": t, "event_id": n, "event": e, "detail": None} for t, n, e in events[i:i + size]])


@pytest.mark.parametrize("seed", range(6))
def test_any_order_within_the_watermark_gives_the_ordered_fold(seed):
    rng = random.Random(seed)
    log = sorted((rng.randrange(0, 2000) * 1000, n, rng.choice(KINDS)) for n in range(300))
    stale = 5_000
    whole = machine(stale)
    want = [f for f in whole.handleInputRows(("j",), chunks(log), At(-1))]
    want += list(whole.handleExpiredTimer(("j",), At(2_100_000), None))
    m, got, mark, at = machine(stale), [], -1, 0
    while at < len(log):  # batches that overlap by less than the watermark's delay
        size = rng.randint(1, 60)
        batch = log[at:at + size]
        at += size
        rng.shuffle(batch)
        got += list(m.handleInputRows(("j",), chunks(batch), At(mark)))
        mark = log[min(at, len(log) - 1)][0] - 1
    got += list(m.handleExpiredTimer(("j",), At(2_100_000), None))
    spells = lambda frames: sorted((r.silent_since, r.status, r.attempts) for f in frames for r in f.itertuples() if r.stale)
    assert spells(got) == spells(want) and spells(got)
    last = lambda frames: max((r for f in frames for r in f.itertuples() if not r.stale), key=lambda r: r.revision)
    assert last(got)[2:5] == last(want)[2:5]
    assert m.waiting.rows == whole.waiting.rows == []


def source(spark, folder, waves):
    for wave in waves:
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_silent_workers_are_found_by_event_time(spark, tmp_path):
    from framejobs.session import configure

    configure(spark)
    at = lambda h, m=0: AT + timedelta(hours=h, minutes=m)
    waves = [
        [("a", "claim", at(0), 1), ("b", "claim", at(0), 2), ("b", "complete", at(0, 5), 3)],
        [("c", "claim", at(5), 4)], [("d", "claim", at(5, 30), 5)],
    ]
    found = SJ.run_to_table(SJ.stream_stale(source(spark, f"{tmp_path}/in", waves), 3_600_000, "1 minute"), str(tmp_path), "update").collect()
    assert [(r.job_id, r.status, r.stale, r.silent_since) for r in found] == [("a", "pending", True, int(AT.timestamp() * 1000))]


def test_late_rows_are_kept_and_counted_and_replays_change_nothing(spark, tmp_path):
    at = lambda h: AT + timedelta(hours=h)
    waves = [
        [("a", "x", at(0.5), 1), ("a", "x", at(5), 2), ("a", None, None, 3)],
        [("a", "x", at(0.6), 4), ("a", "x", at(3.5), 5), ("b", "y", at(4.2), 6), ("b", None, at(6), 7)],
    ]
    events = source(spark, f"{tmp_path}/in", waves)
    SJ.land_windows(events, "1 hour", None, "1 hour", f"{tmp_path}/t", f"{tmp_path}/c1").awaitTermination()
    table = lambda: sorted(((r.start - datetime(2024, 1, 1)).total_seconds() / 3600, str(r.event), r.n, r.late)
                           for r in SJ.window_counts(spark, f"{tmp_path}/t").where("start is not null").collect())
    want = [(0.0, "x", 1, 1), (3.0, "x", 0, 1), (4.0, "y", 1, 0), (5.0, "x", 1, 0), (6.0, "None", 1, 0)]
    assert table() == want
    SJ.land_windows(source(spark, f"{tmp_path}/in", []), "1 hour", None, "1 hour", f"{tmp_path}/t", f"{tmp_path}/c2").awaitTermination()
    assert table() == want  # the same micro-batches again, as after a crash


def test_rollup_follows_moves_and_replays_change_nothing(spark, tmp_path):
    schema = "job_id string, status string, revision bigint, n int"
    waves = [[("a", "pending", 1, 0), ("b", "pending", 1, 0), ("z", "failed", 1, 0)], [("a", "completed", 2, 0), ("b", "claimed", 2, 0), ("b", "pending", 3, 0)]]
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batches = spark.createDataFrame([("one", "queued"), ("two", "cancelled"), ("idle", "queued")], "batch_id string, status string")
    homes = spark.createDataFrame([("a", "one"), ("b", "one"), ("z", "two")], "job_id string, batch_id string")
    want = {("one", "running", 2, 1, 0), ("two", "cancelled", 1, 0, 1), ("idle", "queued", 0, 0, 0)}
    for checkpoint in ("c1", "c2"):
        states = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        SJ.land_rollup(states, homes, f"{tmp_path}/t", f"{tmp_path}/{checkpoint}").awaitTermination()
        rolled = SJ.live_rollup(spark, f"{tmp_path}/t", batches, AT).collect()
        assert {(r.batch_id, r.status, r.total_jobs, r.completed_jobs, r.failed_jobs) for r in rolled} == want
    counts = keyed.read(spark, f"{tmp_path}/t/counts")
    assert {(r.batch_id, r.status, r.n) for r in counts.where(F.col("n") > 0).collect()} == {
        ("one", "completed", 1), ("one", "pending", 1), ("two", "failed", 1)}
