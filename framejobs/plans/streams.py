"""Queries that run the streaming jobs over the event table until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framejobs import vocab
from framejobs.operators.ranking import last_by
from framejobs.plans import shared_sql as S
from framejobs.plans.operations import AS_OF
from framejobs.plans.registry import cte, query
from framejobs.session import checkpoint_dir
from framejobs.sources import bridge as B
from framejobs.streaming import jobs as SJ

_KINDS = " ".join(f"WHEN '{k}' THEN {S.sql_list(v)}[(event_id % 4)::int + 1]" for k, v in B.JOB_EVENTS.items())
cte("b_job_events", f"""
  SELECT 'job_' || user_id AS job_id, CASE event_type {_KINDS} END AS event, ts, event_id, event_id % 6 AS piece FROM events""")

PIECES = 6


def in_pieces(spark, sf_dir, ordered=False):
    """The event table as a stream of six pieces, one a trigger, and the disorder in it: dealt by event number so that each
    piece reaches over the whole table, or one after the other in event time.

    The table is written once, each piece in as many files as the cluster has tasks for it. Files are read in the order
    of their times, which are set by piece. Rows without a time go to the first piece.
    """
    base = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    table = B.job_events(spark, sf_dir).select("job_id", "event", "ts", "event_id")
    low, high = table.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).head()
    span = max(1, high - low + 1)
    piece = F.col("event_id") % PIECES
    if ordered:
        piece = F.coalesce(F.floor((F.unix_millis("ts") - low) * PIECES / span), F.lit(0))
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PIECES)
    placed = table.withColumns({"piece": piece.cast("int"), "part": F.pmod(F.xxhash64("event_id"), F.lit(files))})
    return pieces_stream(spark, placed, base, PIECES, files), f"{span + 1000} milliseconds"


def pieces_stream(spark, placed, base, pieces, files):
    """A stream of rows marked with ``piece`` and ``part``, one piece a trigger, from one write."""
    placed.repartition(pieces * files, "piece", "part").write.partitionBy("piece", "part").parquet(base)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.Path(f"{base}/piece=*/part=*/*.parquet")):
        number = int(status.getPath().getParent().getParent().getName().split("=")[1])
        fs.setTimes(status.getPath(), (B.BASE_EPOCH + number) * 1000, -1)
    schema = placed.drop("piece", "part").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(base)


@query("stream_throughput", uses=("b_job_events",), sql="""
  SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::bigint AS start, event, count(*) AS n FROM b_job_events GROUP BY ALL""")
def stream_throughput(spark, sf_dir):
    # Update mode: the last count of a window is the final one, also for windows still open.
    events, disorder = in_pieces(spark, sf_dir)
    out = SJ.run_to_table(SJ.stream_throughput(events, "6 hours", watermark=disorder), checkpoint_dir(spark), "update")
    return last_by(out, ["start", "event"], F.struct("epoch", "n")).select(
        F.unix_seconds("start").alias("start"), "event", "n"
    )


@query("stream_smoothed_rate", uses=("b_job_events",), sql="""
  SELECT epoch(w)::bigint AS start, event, count(*) AS n FROM (
    SELECT event, time_bucket(INTERVAL 3 HOUR, ts) - to_hours(k * 3) AS w FROM b_job_events, (VALUES (0), (1), (2), (3)) t(k))
  GROUP BY ALL""")
def stream_smoothed_rate(spark, sf_dir):
    events, disorder = in_pieces(spark, sf_dir)
    stream = SJ.stream_throughput(events, "12 hours", "3 hours", disorder)
    out = SJ.run_to_table(stream, checkpoint_dir(spark), "update")
    return last_by(out, ["start", "event"], F.struct("epoch", "n")).select(
        F.unix_seconds("start").alias("start"), "event", "n"
    )


@query("stream_bursts", uses=("b_job_events",), sql="""
  SELECT job_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS session FROM (
      SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh
      FROM b_job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)))
  GROUP BY job_id, session""")
def stream_bursts(spark, sf_dir):
    # Complete mode also shows the sessions the watermark has not closed yet; the last epoch holds all.
    events, disorder = in_pieces(spark, sf_dir)
    out = SJ.run_to_table(SJ.stream_bursts(events, "4 hours", disorder), checkpoint_dir(spark), "complete")
    final = out.join(F.broadcast(out.agg(F.max("epoch").alias("epoch"))), "epoch", "left_semi")
    return final.select("job_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_requests", uses=("b_job_events",), sql="SELECT DISTINCT job_id || ':' || event AS dedupe_key FROM b_job_events")
def stream_requests(spark, sf_dir):
    events, disorder = in_pieces(spark, sf_dir)
    requests = events.withColumn("dedupe_key", F.concat_ws(":", "job_id", "event"))
    return SJ.run_to_table(SJ.stream_requests(requests, disorder), checkpoint_dir(spark)).select("dedupe_key")


# The windows of the events of each piece and whether they ended before the horizon of the pieces before it, an hour back.
@query("stream_late_rows", uses=("b_job_events",), sql="""
  SELECT epoch(start)::bigint AS start, event, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM (
    SELECT time_bucket(INTERVAL 1 DAY, e.ts) AS start, event,
      coalesce(time_bucket(INTERVAL 1 DAY, e.ts) + INTERVAL 1 DAY <= h.latest - INTERVAL 1 HOUR, false) AS late
    FROM b_job_events e LEFT JOIN (
      SELECT p.piece, max(x.ts) AS latest FROM (SELECT DISTINCT piece FROM b_job_events) p JOIN b_job_events x ON x.piece < p.piece GROUP BY 1) h
      ON h.piece = e.piece)
  GROUP BY ALL""")
def stream_late_rows(spark, sf_dir):
    """Daily counts under a watermark of an hour over shuffled pieces, with the late rows counted beside them."""
    base = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    events, _ = in_pieces(spark, sf_dir)
    SJ.land_windows(events, "1 day", None, "1 hour", f"{base}/table", f"{base}/state").awaitTermination()
    return SJ.window_counts(spark, f"{base}/table").select(F.unix_seconds("start").alias("start"), "event", "n", "late")


def walk_sql(stale_ms=None, until="NULL"):
    """The job machine as a recursive walk over the ordered log; with ``stale_ms`` the silences before ``until`` too."""
    working = "status IN ('claimed', 'running')"
    silent = f"coalesce({working} AND beat + {stale_ms} < ms, false)" if stale_ms else "false"
    rows = "SELECT job_id, epoch_us(ts) // 1000 AS ms, event_id, event FROM b_job_events"
    if stale_ms:  # events the watermark has passed, and the watermark itself as the last moment
        rows = f"""SELECT * FROM ({rows}) WHERE ms < {until}
      UNION ALL SELECT DISTINCT job_id, {until}, 9223372036854775807, 'end' FROM b_job_events"""
    return f"""
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, event_id) AS i FROM ({rows})),
  w AS (
    SELECT DISTINCT job_id, 0::bigint AS i, 'pending' AS status, 0 AS attempts, NULL::bigint AS beat, NULL::bigint AS avail, NULL::bigint AS silent_since, 0 AS attempts_then FROM o
    UNION ALL
    SELECT job_id, i,
      CASE WHEN event = 'claim' AND status = 'pending' AND (avail IS NULL OR avail <= ms) THEN 'claimed'
        WHEN event = 'run' AND {working} THEN 'running' WHEN event = 'complete' THEN 'completed'
        WHEN event = 'fail' THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END
        WHEN event IN ('defer', 'defer_refund') THEN 'pending' WHEN event = 'park' THEN 'failed'
        WHEN event = 'retry' AND status IN ('failed', 'cancelled') THEN 'pending'
        WHEN event = 'cancel' AND status IN ('pending', 'claimed') THEN 'cancelled'
        WHEN event = 'reclaim' AND {working} THEN 'pending' ELSE status END,
      CASE WHEN event = 'claim' AND status = 'pending' AND (avail IS NULL OR avail <= ms) THEN attempts + 1
        WHEN event = 'defer_refund' THEN greatest(0, attempts - 1) WHEN event = 'park' THEN 3
        WHEN event = 'retry' AND status IN ('failed', 'cancelled') THEN 0 ELSE attempts END,
      CASE WHEN event = 'claim' AND status = 'pending' AND (avail IS NULL OR avail <= ms) OR event IN ('run', 'heartbeat') AND {working} THEN ms
        WHEN event = 'fail' AND attempts < 3 OR event IN ('defer', 'defer_refund')
          OR event = 'retry' AND status IN ('failed', 'cancelled') OR event = 'reclaim' AND {working} THEN NULL ELSE beat END,
      CASE WHEN event = 'claim' AND status = 'pending' AND (avail IS NULL OR avail <= ms) THEN NULL
        WHEN event IN ('defer', 'defer_refund') THEN ms + {vocab.FILL_POLL_MS} ELSE avail END,
      since, attempts
    FROM (
      SELECT w.job_id, o.i, o.ms, o.event, attempts, avail, CASE WHEN {silent} THEN beat END AS since,
        CASE WHEN {silent} THEN 'pending' ELSE status END AS status, CASE WHEN {silent} THEN NULL ELSE beat END AS beat
      FROM w JOIN o ON o.job_id = w.job_id AND o.i = w.i + 1))
  """


cte("b_walk", walk_sql() + """
  SELECT job_id, status, attempts, beat FROM w QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1""", ("b_job_events",))
cte("b_silent_walk", walk_sql(3_600_000, "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM b_job_events)") + """
  SELECT job_id, silent_since, attempts_then AS attempts FROM w WHERE silent_since IS NOT NULL""", ("b_job_events",))


def job_states(spark, sf_dir):
    """Jobs from a log in disorder over all of its pieces."""
    events, disorder = in_pieces(spark, sf_dir)
    out = SJ.run_to_table(SJ.stream_job_state(events, disorder), checkpoint_dir(spark), "update")
    return last_by(out, ["job_id"], F.col("revision"))


@query("stream_job_state", uses=("b_walk",), sql="SELECT job_id, status, attempts, beat FROM b_walk")
def stream_job_state(spark, sf_dir):
    return job_states(spark, sf_dir).select("job_id", "status", "attempts", F.col("heartbeat_at").alias("beat"))


@query("stream_batch_rollup", uses=("b_walk", "b_batches"), sql="""
  SELECT batch_id, name, total_jobs, completed_jobs, failed_jobs, cancelled_jobs, active_jobs,
    CASE WHEN old = 'cancelled' THEN 'cancelled' WHEN active_jobs > 0 THEN 'running' WHEN total_jobs = 0 THEN 'queued'
      WHEN failed_jobs > 0 AND completed_jobs = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM (
    SELECT b.batch_id, b.name, b.status AS old, count(w.job_id) AS total_jobs,
      count(*) FILTER (w.status = 'completed') AS completed_jobs, count(*) FILTER (w.status = 'failed') AS failed_jobs,
      count(*) FILTER (w.status = 'cancelled') AS cancelled_jobs,
      count(*) FILTER (w.status IN ('pending', 'claimed', 'running')) AS active_jobs
    FROM b_batches b LEFT JOIN b_walk w ON 'bat_' || (substr(w.job_id, 5)::int % 50) = b.batch_id GROUP BY ALL)""")
def stream_batch_rollup(spark, sf_dir):
    """Counters and status of every batch, kept current by the changes of each micro-batch."""
    base = f"{checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    events, disorder = in_pieces(spark, sf_dir)
    states = SJ.stream_job_state(events, disorder)
    SJ.land_rollup(states, B.job_batches(spark, sf_dir), f"{base}/table", f"{base}/state").awaitTermination()
    rolled = SJ.live_rollup(spark, f"{base}/table", B.batches(spark, sf_dir), AS_OF)
    return rolled.select("batch_id", "name", "total_jobs", "completed_jobs", "failed_jobs", "cancelled_jobs", "active_jobs", "status")


@query("stream_stale", uses=("b_silent_walk",), sql="SELECT job_id, silent_since, 'pending' AS status, attempts, true AS stale FROM b_silent_walk")
def stream_stale(spark, sf_dir):
    """Every silence of a worker for more than an hour that the watermark has settled, over pieces in event time."""
    events, _ = in_pieces(spark, sf_dir, True)
    stale = SJ.stream_stale(events, 3_600_000, "1 hour")
    return SJ.run_to_table(stale, checkpoint_dir(spark), "update").select("job_id", "silent_since", "status", "attempts", "stale")


@query("stream_import", uses=("b_images",), sql="SELECT product_id, source_hash, image_id, position, position = 0 AS is_primary FROM b_images")
def stream_import(spark, sf_dir):
    base = f"{checkpoint_dir(spark)}/import-{uuid.uuid4().hex}"
    # The listing lands in three parts in order of arrival, written at once; the stream takes one a micro-batch.
    listing = B.files(spark, sf_dir)
    low, high = listing.agg(F.min("arrival"), F.max("arrival")).head()
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    placed = listing.withColumns({
        "piece": F.floor((F.col("arrival") - low) * 3 / (high - low + 1)).cast("int"), "part": F.pmod(F.xxhash64("arrival"), F.lit(files))})
    stream = SJ.stream_import(pieces_stream(spark, placed, f"{base}/listing", 3, files), f"{base}/catalogue", f"{base}/state")
    stream.awaitTermination()
    return SJ.finalise_import(spark, f"{base}/catalogue").select(
        "product_id", "source_hash", "image_id", "position", "is_primary")
