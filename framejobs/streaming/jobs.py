"""Structured Streaming jobs: incremental ingest, job state, throughput, bursts, stale workers.

Every job takes its watermark as an argument. Events behind it are dropped by Spark's own stateful operators;
``land_windows`` keeps and counts them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from framejobs import vocab
from framejobs.functions.text import stable_id
from framejobs.operators import ingest
from framejobs.operators.jobs import settle_batches
from framejobs.operators.ranking import last_by
from framejobs.session import stored
from framejobs.sources import keyed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, directory: str, schema: str, pattern: str, files_per_trigger: int = 1000) -> DataFrame:
    """File stream over a directory; the glob keeps other tables of the directory out."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(directory)
    )


def stream_import(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Classify and store arriving files as they come; shot numbers are settled by ``finalise_import``.

    Each micro-batch appends only rows whose (product, hash) is new, so a replayed batch is harmless.
    """
    def land(batch: DataFrame, epoch: int) -> None:
        staged = stored(ingest.classify(batch).withColumn("__failed", ingest.undecodable(batch)))
        usable, version = F.col("skip_reason").isNull(), epoch + 1
        fresh = ingest.group_products(staged.filter(usable & ~F.col("__failed")).drop("skip_reason", "__failed"))
        keyed.append_new(ingest.distinct_images(fresh), f"{target}/images", ["product_id", "source_hash"], version=version)
        for name, rows in (("skipped", staged.filter(~usable)), ("failed", staged.filter(usable & F.col("__failed")))):
            keyed.append_new(rows.select("import_id", "arrival", "skip_reason"), f"{target}/{name}", ["import_id", "arrival"], version=version)

    return (
        files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finalise_import(spark: SparkSession, target: str) -> DataFrame:
    """Number the shots of everything that landed, independent of the order it landed in."""
    images = keyed.read(spark, f"{target}/images").withColumn(
        "image_id", stable_id("img", F.col("product_id"), F.col("source_hash"))
    )
    return ingest.renumber(images)


def stream_requests(requests: DataFrame, watermark: str) -> DataFrame:
    """Idempotent enqueue: a key is accepted once within the watermark."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["dedupe_key"])


def stream_throughput(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Events per window and kind; a slide smooths the rate."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", watermark).groupBy(window.alias("w"), "event").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n")


def stream_bursts(events: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Bursts of activity per job: sessions closed by a quiet gap."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "job_id").agg(
        F.count(F.lit(1)).alias("n")
    ).select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


STATE_FIELDS = "status attempts max_attempts heartbeat_at available_at error updated_at revision timer waiting".split()
STATE_SCHEMA = (
    "status string, attempts int, max_attempts int, heartbeat_at bigint, available_at bigint, error string, "
    "updated_at bigint, revision bigint, timer bigint, waiting string"
)
STATE_OUTPUT = (
    "job_id string, status string, attempts int, heartbeat_at bigint, error string, updated_at bigint, stale boolean, "
    "silent_since bigint, revision bigint"
)


class JobMachine(StatefulProcessor):
    """Job life cycle over an event log that may arrive in any order within the watermark.

    A claim costs an attempt, a failure returns the job to pending while attempts remain, a deferral
    may refund its attempt, a retry starts afresh. With ``stale_ms`` a claimed or running job whose worker is silent for
    longer goes back to pending at that moment, before any later event counts.

    Events wait in state until the watermark has passed them, when nothing can arrive before them any more; then
    they are taken in event-time order into the settled state. A timer at the first waiting event releases it
    also where a job hears nothing more. Every call on state is a round trip to the JVM, so a job is one value, its waiting
    events a JSON text in it, read and written once a call; a timer is set only where none is set before it. Each row put out shows the settled state with the waiting events applied on top, so
    the last row of a job is that of the ordered log whatever order the log came in. What is kept for a job is
    its events inside the watermark; a micro-batch's chunks pass one by one.
    """

    def __init__(self, max_attempts: int = vocab.RETRY_ATTEMPTS, stale_ms: int | None = None):
        self.max_attempts, self.stale_ms = max_attempts, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE_SCHEMA)

    def _step(self, s: dict, event: str, ts: int, detail: str | None) -> None:
        working = s["status"] in ("claimed", "running")
        if event == "claim" and s["status"] == "pending" and (s["available_at"] is None or s["available_at"] <= ts):
            s.update(status="claimed", attempts=s["attempts"] + 1, heartbeat_at=ts, available_at=None, updated_at=ts)
        elif event == "run" and working:
            s.update(status="running", heartbeat_at=ts, updated_at=ts)
        elif event == "heartbeat" and working:
            s.update(heartbeat_at=ts)
        elif event == "complete":
            s.update(status="completed", error=None, updated_at=ts)
        elif event == "fail":
            again = s["attempts"] < s["max_attempts"]
            s.update(status="pending" if again else "failed", error=detail or "failed", updated_at=ts)
            if again:
                s.update(heartbeat_at=None)
        elif event in ("defer", "defer_refund"):
            delay = int(detail or vocab.FILL_POLL_MS)
            s.update(status="pending", available_at=ts + delay, heartbeat_at=None, updated_at=ts)
            if event == "defer_refund":
                s.update(attempts=max(0, s["attempts"] - 1))
        elif event == "park":
            s.update(status="failed", attempts=s["max_attempts"], error=detail or "parked", updated_at=ts)
        elif event == "retry" and s["status"] in ("failed", "cancelled"):
            s.update(status="pending", attempts=0, error=None, heartbeat_at=None, updated_at=ts)
        elif event == "cancel" and s["status"] in ("pending", "claimed"):
            s.update(status="cancelled", updated_at=ts)
        elif event == "reclaim" and working:
            s.update(status="pending", heartbeat_at=None, error="reclaimed after worker went silent", updated_at=ts)

    def _silence(self, s: dict, until: int) -> int | None:
        """Take the job back if its worker was silent too long before ``until``; the last sign of life, if so."""
        if self.stale_ms is None or s["status"] not in ("claimed", "running") or s["heartbeat_at"] is None:
            return None
        since = s["heartbeat_at"]
        if since + self.stale_ms >= until:
            return None
        self._step(s, "reclaim", since + self.stale_ms, None)
        return since

    def _fold(self, s: dict, events: list[tuple], until: int | None) -> list[tuple[int, dict]]:
        """Apply events in order, then the silence before ``until``; the spells of silence with the state after each."""
        spells = []
        for ts, _, event, detail in events:
            since = self._silence(s, ts)
            if since is not None:
                spells.append((since, dict(s)))
            self._step(s, event, ts, detail)
        since = None if until is None else self._silence(s, until)
        return spells if since is None else [*spells, (since, dict(s))]

    def _load(self) -> tuple[dict, list[tuple]]:
        """The settled state and the events that wait."""
        kept = tuple(self.state.get() or ())
        if not kept:
            return {
                "status": "pending", "attempts": 0, "max_attempts": self.max_attempts, "heartbeat_at": None,
                "available_at": None, "error": None, "updated_at": 0, "revision": 0, "timer": None,
            }, []
        s = dict(zip(STATE_FIELDS, kept))
        return s, [tuple(e) for e in json.loads(s.pop("waiting"))]

    def _settle(self, s: dict, waiting: list[tuple], watermark: int) -> tuple[list[tuple[int, dict]], list[tuple]]:
        """Move the waiting events the watermark has passed into ``s``; the spells of silence and the events left."""
        waiting = sorted(waiting, key=lambda e: (e[0], e[1]))
        due = [e for e in waiting if e[0] < watermark]
        return self._fold(s, due, watermark), waiting[len(due):]

    def _save(self, s: dict, left: list[tuple]) -> None:
        wake = None
        if left:
            wake = left[0][0] + 1
        elif self.stale_ms is not None and s["status"] in ("claimed", "running"):
            wake = s["heartbeat_at"] + self.stale_ms + 1
        if wake is not None and (s["timer"] is None or wake < s["timer"]):
            self.handle.registerTimer(wake)
            s["timer"] = wake
        self.state.update(tuple({**s, "waiting": json.dumps(left)}[f] for f in STATE_FIELDS))

    def _rows(self, key, s: dict, spells: list[tuple[int, dict]], now: dict | None) -> list[Row]:
        found = [(since, after, True) for since, after in spells] + ([(None, now, False)] if now else [])
        rows = []
        for since, state, stale in found:
            s["revision"] += 1
            rows.append(Row(job_id=key[0], **{c: state[c] for c in ("status", "attempts", "heartbeat_at", "error", "updated_at")},
                            stale=stale, silent_since=since, revision=s["revision"]))
        return rows

    def arrive(self, key, events: list[tuple], watermark: int) -> list[Row]:
        """Take in events; the silences settled by them and the job as it stands."""
        s, waiting = self._load()
        spells, left = self._settle(s, waiting + events, watermark)
        now = dict(s)
        self._fold(now, left, None)
        out = self._rows(key, s, spells, now)
        self._save(s, left)
        return out

    def expire(self, key, watermark: int) -> list[Row]:
        """Settle what the watermark has passed; rows only where that found a silence."""
        s, waiting = self._load()
        if s["timer"] is not None and s["timer"] <= watermark:
            s["timer"] = None
        spells, left = self._settle(s, waiting, watermark)
        # The view with all events applied changes only where a silence was settled.
        now = dict(s)
        self._fold(now, left, None)
        out = self._rows(key, s, spells, now) if spells else []
        self._save(s, left)
        return out

    def _frame(self, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame([r.asDict() for r in rows]).astype({"heartbeat_at": "Int64", "silent_since": "Int64", "attempts": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = []
        for chunk in rows:
            details = [None if pd.isna(d) else str(d) for d in chunk["detail"]]
            events += zip(chunk["ts_ms"].tolist(), chunk["event_id"].tolist(), chunk["event"].tolist(), details)
        yield self._frame(self.arrive(key, events, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.expire(key, timerValues.getCurrentWatermarkInMs())
        if found:
            yield self._frame(found)

    def close(self) -> None:
        pass


class RowJobMachine(JobMachine):
    """The job machine over plain rows: with a few events a job and call, frames cost more than the events in them."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r["ts_ms"], r["event_id"], r["event"], r["detail"]) for r in rows]
        yield from self.arrive(key, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.expire(key, timerValues.getCurrentWatermarkInMs())


def stream_job_state(
    events: DataFrame, watermark: str, max_attempts: int = vocab.RETRY_ATTEMPTS, stale_ms: int | None = None
) -> DataFrame:
    """Latest state of each job touched in a micro-batch, the last row per job by ``revision``; with ``stale_ms`` also silent workers.

    ``events``: job_id, event, ts, event_id and optionally detail. The watermark covers the disorder of the log; events behind
    it are dropped (``land_windows`` shows how to keep and count them). Needs the RocksDB state store.
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = events if "detail" in events.columns else events.withColumn("detail", F.lit(None).cast("string"))
    rows = rows.withWatermark("ts", watermark).select("job_id", "event", "event_id", "detail", F.unix_millis("ts").alias("ts_ms"), "ts")
    return rows.groupBy("job_id").transformWithState(
        RowJobMachine(max_attempts, stale_ms), STATE_OUTPUT, "update", "EventTime")


def stream_stale(events: DataFrame, timeout_ms: int = vocab.STALE_CLAIM_MS, watermark: str = "1 minute") -> DataFrame:
    """Every spell in which a job's worker was silent for too long, once the watermark has settled it."""
    return stream_job_state(events, watermark, stale_ms=timeout_ms).filter("stale")


def land_job_state(states: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep a job table current: each micro-batch overwrites the rows it touched, in their buckets alone."""
    def land(batch: DataFrame, epoch: int) -> None:
        keyed.upsert(batch, target, ["job_id"], F.col("revision"), version=epoch + 1)

    return (
        states.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def land_rollup(states: DataFrame, job_batches: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Counts per (batch, status), kept by what changes: a job leaves its former status and enters its new one.

    ``states`` is joined to the static ``job_batches(job_id, batch_id)`` as it passes. Jobs and counts are keyed tables
    whose versions are micro-batches: a replayed batch builds on the versions under it, so it writes the same or nothing.
    """
    def land(batch: DataFrame, epoch: int) -> None:
        spark, version = batch.sparkSession, epoch + 1
        moved = stored(last_by(batch.select("job_id", "batch_id", "status", "revision"), ["job_id"], F.col("revision")))
        if keyed.manifest(spark, f"{target}/jobs", version) is None:
            keyed.upsert(moved.limit(0), f"{target}/jobs", ["job_id"], F.col("revision"), version=0)
            empty = spark.createDataFrame([], "batch_id string, status string, n bigint")
            keyed.upsert(empty, f"{target}/counts", ["batch_id", "status"], F.col("n"), version=0)
        former = keyed.read(spark, f"{target}/jobs", before=version).join(moved.select("job_id"), "job_id", "left_semi")
        change = moved.select("batch_id", "status", F.lit(1).alias("n")).unionByName(
            former.select("batch_id", "status", F.lit(-1).alias("n"))
        ).groupBy("batch_id", "status").agg(F.sum("n").alias("by")).where("by <> 0")
        counts = keyed.read(spark, f"{target}/counts", before=version)
        both = change.alias("c").join(counts.alias("o"), F.col("c.batch_id").eqNullSafe(F.col("o.batch_id")) & (F.col("c.status") == F.col("o.status")), "left")
        keyed.upsert(both.select("c.batch_id", "c.status", (F.col("c.by") + F.coalesce("o.n", F.lit(0))).alias("n")),
                     f"{target}/counts", ["batch_id", "status"], F.col("n"), version=version)
        keyed.upsert(moved, f"{target}/jobs", ["job_id"], F.col("revision"), version=version)

    joined = states.join(job_batches, "job_id", "left")
    return joined.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_rollup(spark: SparkSession, target: str, batches: DataFrame, as_of: datetime) -> DataFrame:
    """Every batch with its counters and settled status, from the counts ``land_rollup`` keeps."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0))
    counted = keyed.read(spark, f"{target}/counts").where("batch_id is not null").groupBy("batch_id").agg(
        F.sum("n").alias("total_jobs"), of("completed").alias("completed_jobs"), of("failed").alias("failed_jobs"),
        of("cancelled").alias("cancelled_jobs"), of(*vocab.LIVE_JOB_STATUSES).alias("active_jobs"))
    return settle_batches(counted, batches, as_of)


def land_windows(
    events: DataFrame, size: str, slide: str | None, delay: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Events per window and kind with every late row kept and counted; read the result with ``window_counts``.

    The horizon of a micro-batch is the latest event time of all earlier ones less ``delay``, as for a watermark. An event
    whose window ended at or before it is late for that window and goes to ``late`` instead of the counts. The
    batch's own latest time, its rows and its late rows are observed while they are written. Counts are a keyed table by
    micro-batch, late rows and horizons are files by micro-batch: a replay writes the same again or nothing.
    """
    def land(batch: DataFrame, epoch: int) -> None:
        spark, version = batch.sparkSession, epoch + 1
        past = [r.latest for r in _progress(spark, target).where(F.col("epoch") < epoch).agg(F.max("latest").alias("latest")).collect()]
        horizon = F.lit(past[0]).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        window = F.window("ts", size, slide) if slide else F.window("ts", size)
        seen = Observation()
        placed = batch.observe(seen, F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n")).select("*", window.alias("w"))
        late = F.coalesce(F.col("w.end") <= horizon, F.lit(False))
        marked = stored(placed.select(*batch.columns, F.col("w.start").alias("start"), F.col("w.end").alias("end"), late.alias("late")))
        marked.where("late").drop("late").write.mode("overwrite").parquet(f"{target}/late/epoch={epoch}")
        change = marked.where("not late").groupBy("start", "end", "event").agg(F.count(F.lit(1)).alias("by"))
        if keyed.manifest(spark, f"{target}/counts", version) is None:
            keyed.upsert(change.limit(0).withColumnRenamed("by", "n"), f"{target}/counts", ["start", "event"], F.col("n"), version=0)
        counts = keyed.read(spark, f"{target}/counts", before=version).withColumnRenamed("event", "__event")
        both = change.join(counts.drop("end"), (change.start == counts.start) & change.event.eqNullSafe(counts.__event), "left")
        keyed.upsert(both.select(change.start, "end", "event", (F.col("by") + F.coalesce("n", F.lit(0))).alias("n")),
                     f"{target}/counts", ["start", "event"], F.col("n"), version=version)
        row = [(epoch, seen.get["latest"], seen.get["n"])]
        spark.createDataFrame(row, PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{target}/progress/batch-{epoch}")

    return events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "epoch bigint, latest timestamp, n bigint"


def _progress(spark: SparkSession, target: str) -> DataFrame:
    """One row per micro-batch: its number, latest event time and rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/progress")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(f"{target}/progress")


def window_counts(spark: SparkSession, target: str) -> DataFrame:
    """``start``, ``event``, ``n`` in time and ``late`` of every window."""
    late = spark.read.parquet(f"{target}/late").groupBy("start", "event").agg(F.count(F.lit(1)).alias("late"))
    return keyed.read(spark, f"{target}/counts").select("start", "event", "n").join(late, ["start", "event"], "full").select(
        "start", "event", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("late", F.lit(0)).alias("late"))


def run_to_table(stream: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read the result back as a table.

    Update-mode output goes through foreachBatch; the caller keeps the last row per key.
    """
    run = uuid.uuid4().hex
    out, checkpoint = f"{base}/stream-{run}", f"{base}/stream-{run}-state"

    def land(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(land).start().awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).option(
        "recursiveFileLookup", "true"
    ).parquet(out)
