"""Job tables: counts, batch rollups, progress, dependencies, and bulk rewrites."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from framejobs import vocab
from framejobs.functions.geometry import js_round
from framejobs.functions.text import dedupe_key
from framejobs.operators.ranking import MAX_GROUP_ROWS, bounded, first_by, last_by, rank_within


def _live() -> Column:
    return F.col("status").isin(*vocab.LIVE_JOB_STATUSES)


def job_stats(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """Jobs per status in one row, zero for a status without jobs."""
    chosen = jobs if kind is None else jobs.filter(F.col("kind") == kind)
    return chosen.agg(*[F.count_if(F.col("status") == s).alias(s) for s in vocab.JOB_STATUSES])


def by_status(jobs: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Work list of one status, oldest first."""
    ordered = jobs.filter(F.col("status") == status).orderBy("created_at", "job_id")
    return ordered if limit is None else ordered.limit(limit)


def failed_recently(jobs: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    chosen = jobs.filter(F.col("status") == "failed")
    if kind:
        chosen = chosen.filter(F.col("kind") == kind)
    return chosen.orderBy(F.desc("updated_at"), F.asc("job_id")).limit(limit)


def batch_rollup(jobs: DataFrame, batches: DataFrame, as_of: datetime) -> DataFrame:
    """Counters and settled status of every batch, derived from its jobs. A cancelled batch stays so."""
    counted = jobs.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_jobs"),
        F.count_if(_live()).alias("active_jobs"),
    )
    return settle_batches(counted, batches, as_of)


def settle_batches(counted: DataFrame, batches: DataFrame, as_of: datetime) -> DataFrame:
    """Counters and status of every batch from ``counted``, one row per batch that has jobs."""
    columns = ("total_jobs", "completed_jobs", "failed_jobs", "cancelled_jobs", "active_jobs")
    own = [c for c in batches.columns if c not in columns]
    out = batches.select(*own).join(counted, "batch_id", "left").fillna(0, subset=list(columns))
    status = (
        F.when(F.col("status") == "cancelled", "cancelled")
        .when(F.col("active_jobs") > 0, "running")
        .when(F.col("total_jobs") == 0, "queued")
        .when((F.col("failed_jobs") > 0) & (F.col("completed_jobs") == 0), "failed")
        .otherwise("completed")
    )
    now = F.lit(as_of).cast("timestamp")
    begun = (F.col("completed_jobs") + F.col("failed_jobs") + F.col("active_jobs")) > 0
    started = F.col("started_at") if "started_at" in own else F.lit(None).cast("timestamp")
    ended = F.col("completed_at") if "completed_at" in own else F.lit(None).cast("timestamp")
    terminal = F.col("status").isin("completed", "failed", "cancelled")
    return out.withColumn("status", status).withColumns({
        "started_at": F.coalesce(started, F.when(begun, now)),
        "completed_at": F.when(terminal, F.coalesce(ended, now)),
    })


def eta_seconds(started_at: Column, total: Column, finished: Column, as_of: Column) -> Column:
    """Remaining seconds from observed throughput; null before five jobs or after the last."""
    elapsed = F.unix_millis(as_of) - F.unix_millis(started_at)
    known = started_at.isNotNull() & (finished >= 5) & (finished < total) & (elapsed > 0)
    return F.when(known, js_round((total - finished) * F.try_divide(elapsed, finished) / 1000))


def batch_progress(jobs: DataFrame, batches: DataFrame, as_of: datetime) -> DataFrame:
    rolled = batch_rollup(jobs, batches, as_of)
    finished = F.col("completed_jobs") + F.col("failed_jobs") + F.col("cancelled_jobs")
    now = F.lit(as_of).cast("timestamp")
    return rolled.withColumns({
        "progress": F.coalesce(F.try_divide(finished, F.col("total_jobs")), F.lit(0.0)),
        "eta_seconds": eta_seconds(F.col("started_at"), F.col("total_jobs"), finished, now),
    })


def failures(jobs: DataFrame, n: int = 50) -> DataFrame:
    """First failures of each batch; the rank limit is applied before the shuffle as well."""
    order = Window.partitionBy("batch_id").orderBy("created_at", "job_id")
    failed = jobs.filter((F.col("status") == "failed") & F.col("batch_id").isNotNull())
    return failed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).select(
        "batch_id", "job_id", F.coalesce("error", F.lit("unknown error")).alias("error"), "n"
    )


def latest_by_key(jobs: DataFrame, within_ms: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """Most recently updated job of each dedupe key, optionally only if touched lately."""
    chosen = jobs.filter(F.col("dedupe_key").isNotNull())
    if within_ms is not None:
        now = F.unix_millis(F.lit(as_of).cast("timestamp"))
        chosen = chosen.filter(F.unix_millis("updated_at") >= now - within_ms)
    return last_by(chosen, ["dedupe_key"], F.struct("updated_at", "job_id"))


def dedupe_requests(requests: DataFrame, jobs: DataFrame, order: Column) -> DataFrame:
    """Requests to insert: one per key, none whose key is live. A null key is never deduplicated."""
    keyed = first_by(requests.filter(F.col("dedupe_key").isNotNull()), ["dedupe_key"], order)
    live = jobs.filter(_live() & F.col("dedupe_key").isNotNull()).select("dedupe_key")
    fresh = keyed.join(live, "dedupe_key", "left_anti").select(*requests.columns)
    return fresh.unionByName(requests.filter(F.col("dedupe_key").isNull()))


def fill_dependency(renders: DataFrame, jobs: DataFrame, cached: DataFrame, as_of: datetime) -> DataFrame:
    """What each waiting render should do about its generated background.

    ``renders`` carries source_hash, template_id and fill_storage_key; ``cached`` holds storage_key.
    ready: the file exists. failed: the fill failed, with its reason. wait: a fill is alive or was
    asked for within the cooldown. queue: ask for one.
    """
    staged = renders.withColumn("dedupe_key", dedupe_key("bgfill", F.col("source_hash"), F.col("template_id")))
    have = cached.select(F.col("storage_key").alias("fill_storage_key")).distinct().withColumn("__have", F.lit(True))
    latest = latest_by_key(jobs).select(
        "dedupe_key", F.col("status").alias("__status"), F.col("error").alias("__error"),
        F.col("updated_at").alias("__updated"),
    )
    joined = staged.join(have, "fill_storage_key", "left").join(latest, "dedupe_key", "left")
    now = F.unix_millis(F.lit(as_of).cast("timestamp"))
    alive = F.coalesce(F.col("__status").isin(*vocab.LIVE_JOB_STATUSES), F.lit(False))
    recent = F.coalesce(F.unix_millis("__updated") >= now - vocab.FILL_COOLDOWN_MS, F.lit(False))
    state = (
        F.when(F.col("__have"), "ready")
        .when(F.col("__status").isin("failed", "cancelled"), "failed")
        .when(alive | recent, "wait")
        .otherwise("queue")
    )
    return joined.withColumns({
        "state": state,
        "dependency_active": (state == "wait") & alive,
        "reason": F.when(state == "failed", F.coalesce("__error", F.lit("unknown error"))),
    }).drop("__have", "__status", "__error", "__updated")


def backlog(jobs: DataFrame, as_of: datetime, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Claimable jobs ranked per kind. There are three kinds, so the rank must not rely on the key."""
    now = F.lit(as_of).cast("timestamp")
    ready = jobs.filter(
        (F.col("status") == "pending") & (F.col("available_at").isNull() | (F.col("available_at") <= now))
    )
    return rank_within(
        ready, ["kind"], [F.asc("priority"), F.asc("created_at"), F.asc("job_id")], "backlog_rank", max_group_rows
    )


def _rewrite(jobs: DataFrame, hit: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    return jobs.select(*[
        F.when(hit, changes[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in jobs.columns
    ])


def _now(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp")


def retry_failed(jobs: DataFrame, batch_id: str, as_of: datetime) -> DataFrame:
    """Failed jobs of a batch go back to pending with a fresh attempt count."""
    hit = (F.col("batch_id") == batch_id) & (F.col("status") == "failed")
    return _rewrite(jobs, hit, {
        "status": F.lit("pending"), "attempts": F.lit(0), "error": F.lit(None), "worker_id": F.lit(None),
        "claimed_at": F.lit(None), "heartbeat_at": F.lit(None), "completed_at": F.lit(None), "updated_at": _now(as_of),
    })


def cancel_open(jobs: DataFrame, batch_id: str, as_of: datetime) -> DataFrame:
    """Pending and claimed jobs of a batch are cancelled; running ones finish."""
    hit = (F.col("batch_id") == batch_id) & F.col("status").isin("pending", "claimed")
    return _rewrite(jobs, hit, {
        "status": F.lit("cancelled"), "completed_at": _now(as_of), "updated_at": _now(as_of),
    })


def park(jobs: DataFrame, parked: DataFrame, as_of: datetime) -> DataFrame:
    """Fail the listed jobs (job_id, reason) at once, using up their attempts."""
    reasons = parked.select("job_id", F.col("reason").alias("__reason"))
    joined = jobs.join(bounded(reasons), "job_id", "left")
    return _rewrite(joined, F.col("__reason").isNotNull(), {
        "status": F.lit("failed"), "error": F.col("__reason"), "attempts": F.col("max_attempts"),
        "completed_at": _now(as_of), "updated_at": _now(as_of),
    }).select(*jobs.columns)


def reclaim_stale(jobs: DataFrame, as_of: datetime, older_than_ms: int = vocab.STALE_CLAIM_MS) -> DataFrame:
    """Claimed or running jobs whose worker went silent return to pending."""
    cutoff = F.unix_millis(_now(as_of)) - older_than_ms
    silent = F.col("heartbeat_at").isNull() | (F.unix_millis("heartbeat_at") < cutoff)
    return _rewrite(jobs, F.col("status").isin("claimed", "running") & silent, {
        "status": F.lit("pending"), "worker_id": F.lit(None), "claimed_at": F.lit(None), "heartbeat_at": F.lit(None),
        "error": F.lit("reclaimed after worker went silent"), "updated_at": _now(as_of),
    })


def clear_queue(
    jobs: DataFrame, images: DataFrame, batches: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stop everything: live jobs and open batches are cancelled, half-analysed images wait again."""
    stopped = _rewrite(jobs, _live(), {
        "status": F.lit("cancelled"), "completed_at": _now(as_of), "updated_at": _now(as_of),
    })
    waiting = _rewrite(images, F.col("vision_status") == "processing", {"vision_status": F.lit("pending")})
    closed = _rewrite(batches, F.col("status").isin("queued", "running"), {"status": F.lit("cancelled")})
    return stopped, waiting, closed


def prune(jobs: DataFrame, as_of: datetime, older_than_ms: int = vocab.PRUNE_AFTER_MS) -> DataFrame:
    """Drop finished jobs past the cutoff; failed ones stay for a retry."""
    cutoff = F.unix_millis(_now(as_of)) - older_than_ms
    old = F.col("status").isin("completed", "cancelled") & F.coalesce(
        F.unix_millis("completed_at") < cutoff, F.lit(False)
    )
    return jobs.filter(~old)
