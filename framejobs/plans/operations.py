"""Queries over jobs, batches, storage, exports and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window, functions as F

from framejobs.functions import geometry as G, paths as P, text as X
from framejobs.operators import exports, hygiene, jobs as J, lookup, reports
from framejobs.plans import settings, shared_sql as S
from framejobs.plans.catalog import ingested
from framejobs.plans.registry import cte, query
from framejobs.session import stored
from framejobs.sources import bridge as B

AS_OF = datetime(1998, 8, 5, 12, 0, 0, tzinfo=timezone.utc)
_NOW = "TIMESTAMP '1998-08-05 12:00:00'"


@query("job_stats", uses=("b_jobs",), sql="""
  SELECT 'all' AS kind, """ + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in
       ("pending", "claimed", "running", "completed", "failed", "cancelled")) + """ FROM b_jobs
  UNION ALL SELECT 'render', """ + ", ".join(f"count(*) FILTER (status = '{s}')" for s in
       ("pending", "claimed", "running", "completed", "failed", "cancelled")) + " FROM b_jobs WHERE kind = 'render'")
def job_stats(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    every = J.job_stats(jobs).withColumn("kind", F.lit("all"))
    return every.unionByName(J.job_stats(jobs, "render").withColumn("kind", F.lit("render")))


cte("rolled", f"""
  SELECT *, greatest(completed_jobs + failed_jobs + cancelled_jobs, 0) AS finished,
    coalesce(started_at, CASE WHEN completed_jobs + failed_jobs + active_jobs > 0 THEN {_NOW} END) AS begun,
    CASE WHEN old = 'cancelled' THEN 'cancelled' WHEN active_jobs > 0 THEN 'running' WHEN total_jobs = 0 THEN 'queued'
      WHEN failed_jobs > 0 AND completed_jobs = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM (SELECT b.batch_id, b.status AS old, b.started_at, count(j.k) AS total_jobs,
    count(*) FILTER (j.status = 'completed') AS completed_jobs, count(*) FILTER (j.status = 'failed') AS failed_jobs,
    count(*) FILTER (j.status = 'cancelled') AS cancelled_jobs,
    count(*) FILTER (j.status IN ('pending', 'claimed', 'running')) AS active_jobs
    FROM b_batches b LEFT JOIN b_jobs j USING (batch_id) GROUP BY ALL)""", ("b_batches", "b_jobs"))


@query("batch_rollup", uses=("rolled",), sql=f"""
  SELECT batch_id, total_jobs, completed_jobs, failed_jobs, cancelled_jobs, active_jobs, status,
    epoch(begun)::bigint AS started, CASE WHEN status IN ('completed', 'failed', 'cancelled')
      THEN epoch({_NOW})::bigint END AS ended FROM rolled""")
def batch_rollup(spark, sf_dir):
    return J.batch_rollup(B.jobs(spark, sf_dir), B.batches(spark, sf_dir), AS_OF).select(
        "batch_id", "total_jobs", "completed_jobs", "failed_jobs", "cancelled_jobs", "active_jobs", "status",
        F.unix_seconds("started_at").alias("started"), F.unix_seconds("completed_at").alias("ended"),
    )


@query("batch_progress", uses=("rolled",), sql=f"""
  SELECT batch_id, status, {S.r('CASE WHEN total_jobs > 0 THEN finished / total_jobs::double ELSE 0.0 END')} AS progress,
    CASE WHEN begun IS NOT NULL AND finished >= 5 AND finished < total_jobs AND epoch_ms({_NOW}) > epoch_ms(begun)
      THEN floor((total_jobs - finished) * ((epoch_ms({_NOW}) - epoch_ms(begun)) / finished::double) / 1000 + 0.5)::bigint
      END AS eta_seconds FROM rolled""")
def batch_progress(spark, sf_dir):
    p = J.batch_progress(B.jobs(spark, sf_dir), B.batches(spark, sf_dir), AS_OF)
    return p.select("batch_id", "status", G.round_to(F.col("progress")).alias("progress"), "eta_seconds")


@query("batch_failures", uses=("b_jobs",), sql="""
  SELECT batch_id, job_id, error, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, job_id) AS n
  FROM b_jobs WHERE status = 'failed' QUALIFY n <= 5""")
def batch_failures(spark, sf_dir):
    return J.failures(B.jobs(spark, sf_dir), 5)


@query("latest_by_key", uses=("b_jobs",), sql=f"""
  SELECT 'any' AS scope, dedupe_key, job_id, status FROM b_jobs WHERE dedupe_key IS NOT NULL QUALIFY row_number() OVER
    (PARTITION BY dedupe_key ORDER BY updated_at DESC, job_id DESC) = 1
  UNION ALL SELECT 'recent', dedupe_key, job_id, status FROM b_jobs WHERE dedupe_key IS NOT NULL
    AND epoch_ms(updated_at) >= epoch_ms({_NOW}) - 8640000000 QUALIFY row_number() OVER
    (PARTITION BY dedupe_key ORDER BY updated_at DESC, job_id DESC) = 1""")
def latest_by_key(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    columns = ["scope", "dedupe_key", "job_id", "status"]
    every = J.latest_by_key(jobs).withColumn("scope", F.lit("any")).select(*columns)
    recent = J.latest_by_key(jobs, 100 * 86_400_000, AS_OF).withColumn("scope", F.lit("recent")).select(*columns)
    return every.unionByName(recent)


@query("backlog", uses=("b_jobs",), sql=f"""
  SELECT kind, job_id, priority, row_number() OVER (PARTITION BY kind ORDER BY priority, created_at, job_id) AS backlog_rank
  FROM b_jobs WHERE status = 'pending' AND (available_at IS NULL OR available_at <= {_NOW})""")
def backlog(spark, sf_dir):
    return J.backlog(B.jobs(spark, sf_dir), AS_OF).select("kind", "job_id", "priority", "backlog_rank")


@query("dedupe_requests", uses=("b_jobs",), sql="""
  SELECT min(c_custkey) AS request, 'bgfill:' || (c_custkey % 700) AS dedupe_key FROM customer WHERE c_custkey % 11 <> 0
    AND 'bgfill:' || (c_custkey % 700) NOT IN (SELECT dedupe_key FROM b_jobs WHERE dedupe_key IS NOT NULL
      AND status IN ('pending', 'claimed', 'running')) GROUP BY 2
  UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 11 = 0""")
def dedupe_requests(spark, sf_dir):
    k = F.col("c_custkey")
    requests = B.table(spark, sf_dir, "customer").select(
        k.alias("request"),
        F.when(k % 11 != 0, F.concat(F.lit("bgfill:"), (k % 700).cast("string"))).alias("dedupe_key"),
    )
    return J.dedupe_requests(requests, B.jobs(spark, sf_dir), F.col("request"))


@query("fill_dependency", uses=("b_jobs",), sql=f"""
  WITH l AS (SELECT * FROM b_jobs WHERE dedupe_key IS NOT NULL QUALIFY row_number() OVER
    (PARTITION BY dedupe_key ORDER BY updated_at DESC, job_id DESC) = 1)
  SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'ready' WHEN l.status IN ('failed', 'cancelled') THEN 'failed'
      WHEN l.status IN ('pending', 'claimed', 'running') OR epoch_ms(l.updated_at) >= epoch_ms({_NOW}) - 20000 THEN 'wait'
      ELSE 'queue' END AS state,
    p_size % 10 <> 0 AND coalesce(l.status IN ('pending', 'claimed', 'running'), false) AS dependency_active,
    CASE WHEN p_size % 10 <> 0 AND l.status IN ('failed', 'cancelled') THEN coalesce(l.error, 'unknown error') END AS reason
  FROM part LEFT JOIN l ON l.dedupe_key = 'bgfill:h' || (p_partkey % 600) || ':t'
  """.replace("'bgfill:h' || (p_partkey % 600) || ':t'", "'bgfill:' || (p_partkey % 600)").replace(
      "WITH l AS", "SELECT * FROM (WITH l AS") + ")")
def fill_dependency(spark, sf_dir):
    part, k = B.table(spark, sf_dir, "part"), F.col("p_partkey")
    # Job keys of the bridge have one part; rewrite them as (photo, template) keys.
    jobs = B.jobs(spark, sf_dir).withColumn("dedupe_key", F.concat("dedupe_key", F.lit(":t")))
    renders = part.select(
        k, (k % 600).cast("string").alias("source_hash"), F.lit("t").alias("template_id"),
        F.concat(F.lit("fill/"), k.cast("string")).alias("fill_storage_key"),
    )
    cached = part.filter(F.col("p_size") % 10 == 0).select(F.concat(F.lit("fill/"), k.cast("string")).alias("storage_key"))
    return J.fill_dependency(renders, jobs, cached, AS_OF).select("p_partkey", "state", "dependency_active", "reason")


@query("bulk_controls", uses=("b_jobs",), sql=f"""
  SELECT 'retry' AS control, CASE WHEN batch_id = 'bat_7' AND status = 'failed' THEN 'pending' ELSE status END AS status,
    sum(CASE WHEN batch_id = 'bat_7' AND status = 'failed' THEN 0 ELSE attempts END)::bigint AS attempts,
    count(CASE WHEN batch_id = 'bat_7' AND status = 'failed' THEN NULL ELSE completed_at END) AS ended, count(*) AS n
    FROM b_jobs GROUP BY 2
  UNION ALL SELECT 'cancel', CASE WHEN batch_id = 'bat_7' AND status IN ('pending', 'claimed') THEN 'cancelled' ELSE status
    END, sum(attempts)::bigint, count(CASE WHEN batch_id = 'bat_7' AND status IN ('pending', 'claimed') THEN {_NOW}
    ELSE completed_at END), count(*) FROM b_jobs GROUP BY 2
  UNION ALL SELECT 'park', CASE WHEN k % 100 = 0 THEN 'failed' ELSE status END,
    sum(CASE WHEN k % 100 = 0 THEN max_attempts ELSE attempts END)::bigint,
    count(CASE WHEN k % 100 = 0 THEN {_NOW} ELSE completed_at END), count(*) FROM b_jobs GROUP BY 2
  UNION ALL SELECT 'reclaim', CASE WHEN status IN ('claimed', 'running') AND (heartbeat_at IS NULL OR
      epoch_ms(heartbeat_at) < epoch_ms({_NOW}) - 86400000000) THEN 'pending' ELSE status END,
    sum(attempts)::bigint, count(completed_at), count(*) FROM b_jobs GROUP BY 2
  UNION ALL SELECT 'prune', status, sum(attempts)::bigint, count(completed_at), count(*) FROM b_jobs
    WHERE NOT (status IN ('completed', 'cancelled') AND epoch_ms(completed_at) < epoch_ms({_NOW}) - 86400000000) GROUP BY 2""")
def bulk_controls(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir).withColumns({
        "worker_id": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("timestamp")
    })
    key = F.substring("job_id", 5, 20).cast("long")
    parked = jobs.filter(key % 100 == 0).select("job_id", F.lit("template gone").alias("reason"))
    long_ago = 1000 * 86_400_000
    rewritten = {
        "retry": J.retry_failed(jobs, "bat_7", AS_OF), "cancel": J.cancel_open(jobs, "bat_7", AS_OF),
        "park": J.park(jobs, parked, AS_OF), "reclaim": J.reclaim_stale(jobs, AS_OF, long_ago),
        "prune": J.prune(jobs, AS_OF, long_ago),
    }
    out = None
    for name, df in rewritten.items():
        counted = df.groupBy("status").agg(
            F.sum("attempts").alias("attempts"), F.count("completed_at").alias("ended"), F.count(F.lit(1)).alias("n")
        ).withColumn("control", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("clear_queue", uses=("b_jobs", "b_batches"), sql="""
  SELECT 'jobs' AS what, CASE WHEN status IN ('pending', 'claimed', 'running') THEN 'cancelled' ELSE status END AS status,
    count(*) AS n FROM b_jobs GROUP BY 2
  UNION ALL SELECT 'batches', CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END, count(*)
    FROM b_batches GROUP BY 2
  UNION ALL SELECT 'images', CASE quality WHEN 1 THEN 'ready' ELSE 'pending' END, count(*) FROM labels GROUP BY 2""")
def clear_queue(spark, sf_dir):
    images = B.table(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 1, "ready").otherwise("processing").alias("vision_status")
    )
    jobs, images, batches = J.clear_queue(B.jobs(spark, sf_dir), images, B.batches(spark, sf_dir), AS_OF)
    frames = {"jobs": jobs, "batches": batches, "images": images.withColumnRenamed("vision_status", "status")}
    parts = [
        df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name)) for name, df in frames.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("failed_jobs_page", uses=("b_jobs",), sql="""
  SELECT job_id, batch_id, error FROM b_jobs WHERE status = 'failed' AND kind = 'render'
  ORDER BY updated_at DESC, job_id LIMIT 100""")
def failed_jobs_page(spark, sf_dir):
    return J.failed_recently(B.jobs(spark, sf_dir), "render").select("job_id", "batch_id", "error")


@query("merge_creatives", uses=("b_creatives",), sql="""
  SELECT creative_id, image_id, template_id, batch_id, byte_size FROM b_creatives""")
def merge_creatives(spark, sf_dir):
    return B.creatives(spark, sf_dir, "creative_id", "image_id", "template_id", "batch_id", "byte_size")


@query("list_creatives", uses=("b_creatives", "b_templates"), sql="""
  SELECT c.creative_id, coalesce(p.name, '—') AS product_name, coalesce(t.name, c.template_id) AS template_name,
    used_fallback, len(violations) AS violations, true AS has_more
  FROM (SELECT * FROM b_creatives ORDER BY created_at DESC, creative_id LIMIT 200 OFFSET 40) c
  LEFT JOIN (SELECT 'prd_' || p_partkey AS product_id, p_name AS name FROM part) p USING (product_id)
  LEFT JOIN b_templates t ON t.template_id = c.template_id AND t.template_id <> 'tpl_5'""")
def list_creatives(spark, sf_dir):
    products = B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("prd_"), F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_name").alias("product_name")
    )
    listed = B.creatives(spark, sf_dir, "creative_id", "product_id", "template_id", "used_fallback", "violations", "created_at")
    shown = lookup.page(listed, [F.desc("created_at"), F.asc("creative_id")], 200, 40)
    named = lookup.list_creatives(shown, products, settings.templates(spark).filter("template_id <> 'tpl_5'"))
    return named.select(
        "creative_id", "product_name", "template_name", "used_fallback", F.size("violations").alias("violations"), "has_more"
    )


@query("creative_keys_for_import", uses=("b_creatives",), sql="""
  SELECT storage_key FROM b_creatives WHERE image_id IN (SELECT 'img_' || p_partkey FROM part WHERE p_brand = 'Brand#4')""")
def creative_keys_for_import(spark, sf_dir):
    images = B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("image_id"), F.col("p_brand").alias("import_id")
    )
    return lookup.creative_keys_for_import(B.creatives(spark, sf_dir, "image_id", "storage_key"), images, "Brand#4")


@query("creative_report", uses=("b_creatives",), sql=f"""
  SELECT strategy_id, count(*) AS creatives, count(*) FILTER (used_fallback) AS fallbacks,
    {S.r('avg(CASE WHEN used_fallback THEN 1.0 ELSE 0.0 END)')} AS fallback_rate,
    count(*) FILTER (used_fallback OR len(violations) > 0) AS review FROM b_creatives GROUP BY 1""")
def creative_report(spark, sf_dir):
    current = B.creatives(spark, sf_dir, "strategy_id", "used_fallback", "violations")
    review = reports.needs_review(current).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("review"))
    return reports.strategy_report(current).withColumn("fallback_rate", G.round_to(F.col("fallback_rate"))).join(
        review, "strategy_id", "left"
    ).fillna(0, subset=["review"])


@query("violation_histogram", uses=("b_creatives",), sql="""
  SELECT code, count(*) AS count FROM (SELECT unnest(violations) AS code FROM b_creatives) GROUP BY 1""")
def violation_histogram(spark, sf_dir):
    return reports.violation_histogram(B.creatives(spark, sf_dir, "violations"))


@query("storage_usage", uses=("b_media",), sql="""
  SELECT coalesce(root, 'total') AS root, count(*) AS files, sum(size)::bigint AS bytes FROM b_media GROUP BY ROLLUP (root)""")
def storage_usage(spark, sf_dir):
    return hygiene.storage_usage(B.media_listing(spark, sf_dir))


cte("b_doc_images", """
  SELECT sha256(text) AS source_hash, doc_id, 'img_' || doc_id AS image_id, 'prd_' || (doc_id % 40) AS product_id,
    'imp_' || (doc_id % 4) AS import_id,
    substr(sha256(text),1,2) || '/' || substr(sha256(text),3,2) || '/' || sha256(text) ||
      CASE WHEN doc_id % 6 = 0 THEN '.png' ELSE '.jpg' END AS storage_key
  FROM documents""")


def doc_images(spark, sf_dir):
    n, h = F.col("doc_id"), F.col("source_hash")
    docs = B.table(spark, sf_dir, "documents")
    return docs.select(n, F.sha2("text", 256).alias("source_hash")).select(
        n, h, F.concat(F.lit("img_"), n.cast("string")).alias("image_id"),
        F.concat(F.lit("prd_"), (n % 40).cast("string")).alias("product_id"),
        F.concat(F.lit("imp_"), (n % 4).cast("string")).alias("import_id"),
        P.original_key(h, F.when(n % 6 == 0, "image/png").otherwise("image/jpeg")).alias("storage_key"),
    )


@query("sweep_orphans", uses=("b_media", "b_creatives", "b_doc_images"), sql="""
  SELECT root, key, size FROM b_media WHERE
    (root = 'creatives' AND key NOT IN (SELECT storage_key FROM b_creatives WHERE used_fallback)) OR
    (root = 'originals' AND key NOT IN (SELECT storage_key FROM b_doc_images)) OR
    (root = 'derived' AND split_part(key, '/', 3) NOT IN (SELECT source_hash FROM b_doc_images))""")
def sweep_orphans(spark, sf_dir):
    rows = B.creatives(spark, sf_dir, "storage_key", "used_fallback").filter("used_fallback")
    return hygiene.sweep_orphans(B.media_listing(spark, sf_dir), rows, doc_images(spark, sf_dir)).select("root", "key", "size")


@query("duplicate_content", uses=("b_doc_images",), sql="""
  SELECT source_hash, count(*) AS images, count(DISTINCT product_id) AS products FROM b_doc_images GROUP BY 1
  HAVING count(DISTINCT product_id) > 1""")
def duplicate_content(spark, sf_dir):
    return hygiene.duplicate_content(doc_images(spark, sf_dir))


_DEAD = """(SELECT DISTINCT source_hash FROM b_doc_images WHERE import_id = 'imp_1' AND source_hash NOT IN
  (SELECT source_hash FROM b_doc_images WHERE import_id <> 'imp_1'))"""


_CREATIVE_ORDER = [("created_at", True), ("creative_id", False), ("image_id", False), ("template_id", False)]


@query("deep_pages", uses=("b_creatives", "b_batches"), sql="""
  SELECT what, key, n FROM (
    SELECT 'creatives' AS what, creative_id || ' ' || image_id || ' ' || template_id AS key,
      row_number() OVER (ORDER BY created_at DESC, creative_id, image_id, template_id) AS n FROM b_creatives
    UNION ALL SELECT 'batches', batch_id, row_number() OVER (ORDER BY status, name DESC, batch_id) FROM b_batches)
  WHERE what = 'creatives' AND n BETWEEN 2501 AND 2620 OR what = 'batches' AND n BETWEEN 61 AND 90""")
def deep_pages(spark, sf_dir):
    """A jump to a deep page of outputs, the page behind it, and a page of batches."""
    creatives = stored(B.creatives(spark, sf_dir, "created_at", "creative_id", "image_id", "template_id"))
    index = stored(lookup.rank_index(creatives, _CREATIVE_ORDER, 1000))
    jump = stored(lookup.page_at(creatives, _CREATIVE_ORDER, index, 60, 2500))
    end = jump.orderBy(*[F.asc(k) if down else F.desc(k) for k, down in _CREATIVE_ORDER]).limit(1).collect()
    onward = lookup.page_after(creatives, _CREATIVE_ORDER, 60, end[0].asDict()) if end else jump.limit(0)
    numbered = lambda df, order, start: df.withColumn("n", F.row_number().over(Window.orderBy(*order)) + start)
    by = lookup._order(_CREATIVE_ORDER)
    shown = numbered(jump, by, 2500).unionByName(numbered(onward, by, 2560)).select(
        F.lit("creatives").alias("what"), F.concat_ws(" ", "creative_id", "image_id", "template_id").alias("key"), "n")
    order = [F.asc("status"), F.desc("name"), F.asc("batch_id")]
    batches = lookup.page(B.batches(spark, sf_dir), order, 30, 60, shallow=0)
    return shown.unionByName(numbered(batches, order, 60).select(F.lit("batches").alias("what"), F.col("batch_id").alias("key"), "n"))


@query("delete_import_impact", uses=("b_doc_images", "b_media", "b_creatives"), sql=f"""
  SELECT (SELECT count(DISTINCT product_id) FROM b_doc_images WHERE import_id = 'imp_1') AS removed_products,
    (SELECT count(*) FROM b_doc_images WHERE import_id = 'imp_1') AS removed_images,
    (SELECT count(*) FROM b_creatives WHERE image_id IN (SELECT image_id FROM b_doc_images WHERE import_id = 'imp_1'))
      AS removed_creatives,
    (SELECT count(DISTINCT source_hash) FROM b_doc_images WHERE import_id = 'imp_1')
      - (SELECT count(*) FROM {_DEAD}) AS shared_files_kept,
    count(*) AS files_deleted, sum(size)::bigint AS freed_bytes
  FROM b_media WHERE
    (root = 'creatives' AND key IN (SELECT storage_key FROM b_creatives WHERE image_id IN
      (SELECT image_id FROM b_doc_images WHERE import_id = 'imp_1'))) OR
    (root = 'originals' AND key IN (SELECT storage_key FROM b_doc_images WHERE source_hash IN {_DEAD})) OR
    (root = 'derived' AND split_part(key, '/', 3) IN {_DEAD})""")
def delete_import_impact(spark, sf_dir):
    images = doc_images(spark, sf_dir)
    tables = {
        "images": images, "products": images.select("product_id", "import_id").distinct(),
        "creatives": B.creatives(spark, sf_dir, "creative_id", "image_id", "storage_key"),
    }
    ids = images.filter("import_id = 'imp_1'").select("import_id").distinct()
    _, _, report = hygiene.delete_impact(tables, "import", ids, B.media_listing(spark, sf_dir))
    return report.select(
        "removed_products", "removed_images", "removed_creatives", "shared_files_kept", "files_deleted", "freed_bytes"
    )


_DELETES = {
    "product": ("product_id = 'prd_7'", "product_id = 'prd_7'"),
    "batch": ("batch_id = 'bat_9'", "false"),
    "template": ("template_id = 'tpl_3'", "false"),
    "creative": ("creative_id LIKE 'crt_%1_2'", "false"),
    "all creatives": ("true", "false"),
}


def _delete_sql(kind: str, creatives: str, images: str) -> str:
    """One row: what goes with it by every key, and the files nobody refers to any more."""
    lost = f"(SELECT * FROM b_doc_images WHERE {images})"
    dead = f"(SELECT source_hash FROM {lost} WHERE source_hash NOT IN (SELECT source_hash FROM b_doc_images WHERE NOT ({images})))"
    outputs = f"(SELECT * FROM b_creatives WHERE {creatives} OR image_id IN (SELECT image_id FROM {lost}))"
    count = lambda when, sql: f"({sql})" if kind == when else "NULL"
    return f"""
  SELECT '{kind}' AS kind, {count('product', f'SELECT count(*) FROM {lost}')} AS removed_images,
    (SELECT count(*) FROM {outputs}) AS removed_creatives,
    {count('batch', "SELECT count(*) FROM b_jobs WHERE batch_id = 'bat_9'")} AS removed_jobs,
    {count('template', "SELECT count(*) FROM part WHERE p_partkey % 10 = 3")} AS removed_rules,
    {count('product', f'SELECT count(DISTINCT source_hash) - (SELECT count(DISTINCT source_hash) FROM {dead}) FROM {lost}')} AS shared_files_kept,
    count(*) AS files_deleted, coalesce(sum(size), 0)::bigint AS freed_bytes
  FROM b_media WHERE (root = 'creatives' AND key IN (SELECT storage_key FROM {outputs}))
    OR (root = 'originals' AND key IN (SELECT storage_key FROM b_doc_images WHERE source_hash IN {dead}))
    OR (root = 'derived' AND split_part(key, '/', 3) IN {dead})"""


@query("delete_impact", uses=("b_doc_images", "b_media", "b_creatives", "b_jobs"), sql=" UNION ALL ".join(
    _delete_sql(kind, *where) for kind, where in _DELETES.items()))
def delete_impact(spark, sf_dir):
    """Dry runs of deleting a product, a batch, a template, some creatives and all of them."""
    images = stored(doc_images(spark, sf_dir))
    creatives = stored(B.creatives(spark, sf_dir, "creative_id", "image_id", "product_id", "template_id", "batch_id", "storage_key"))
    rules = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.concat(F.lit("tpl_"), (F.col("p_partkey") % 10).cast("string")).alias("template_id"))
    tables = {
        "images": images.drop("import_id"), "products": images.select("product_id").distinct(), "creatives": creatives,
        "jobs": B.jobs(spark, sf_dir), "batches": B.batches(spark, sf_dir), "rules": rules,
    }
    listing, out = stored(B.media_listing(spark, sf_dir)), None
    columns = ("removed_images", "removed_creatives", "removed_jobs", "removed_rules", "shared_files_kept", "files_deleted", "freed_bytes")
    for kind, (chosen, _) in _DELETES.items():
        name = "creative" if kind == "all creatives" else kind
        source = tables["products"] if kind == "product" else creatives
        ids = source.where(chosen).select(f"{name}_id")
        report = hygiene.delete_impact(tables, name, ids, listing)[2]
        row = report.select(F.lit(kind).alias("kind"), *[
            (F.col(c) if c in report.columns else F.lit(None)).cast("long").alias(c) for c in columns])
        out = row if out is None else out.unionByName(row)
    return out


@query("delete_batch_survivors", uses=("b_creatives", "b_jobs", "b_batches"), sql="""
  SELECT 'creatives' AS what, count(*) AS n FROM b_creatives WHERE batch_id <> 'bat_9'
  UNION ALL SELECT 'jobs', count(*) FROM b_jobs WHERE batch_id <> 'bat_9'
  UNION ALL SELECT 'batches', count(*) FROM b_batches WHERE batch_id <> 'bat_9'""")
def delete_batch_survivors(spark, sf_dir):
    tables = {"creatives": B.creatives(spark, sf_dir, "creative_id", "batch_id"), "jobs": B.jobs(spark, sf_dir), "batches": B.batches(spark, sf_dir)}
    ids = tables["batches"].filter("batch_id = 'bat_9'").select("batch_id")
    left = hygiene.survivors(tables, hygiene.cascade(tables, "batch", ids))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(t)) for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("status_counts", uses=("b_images",), sql="""
  SELECT import_id, 0 AS failed, count(*) FILTER (vision_status = 'pending') AS pending, 0 AS processing,
    count(*) FILTER (vision_status = 'ready') AS ready, 0 AS unavailable FROM b_images GROUP BY 1""")
def status_counts(spark, sf_dir):
    return reports.status_counts(ingested(spark, sf_dir)[2], ["import_id"])


@query("overview", uses=("b_images",), sql=f"""
  SELECT count(*) AS total_images, count(*) FILTER (vision_status = 'ready') AS analysed,
    {S.r("count(*) FILTER (vision_status = 'ready') / count(*)::double")} AS coverage,
    count(*) FILTER (vision_status = 'pending') AS outstanding FROM b_images""")
def overview(spark, sf_dir):
    o = reports.overview(ingested(spark, sf_dir)[2])
    return o.withColumn("coverage", G.round_to(F.col("coverage")))


@query("shot_type_counts", uses=("b_analyses",), sql="""
  SELECT shot_type, count(*) AS count FROM b_analyses WHERE status = 'ready' AND shot_type IS NOT NULL GROUP BY 1""")
def shot_type_counts(spark, sf_dir):
    return reports.shot_type_counts(B.analyses(spark, sf_dir))


@query("category_folder_counts", uses=("b_products",), sql="""
  SELECT 'category' AS what, category AS value, count(*) AS count FROM b_products WHERE category <> '' GROUP BY 2
  UNION ALL SELECT 'folder', folder_path, count(*) FROM b_products GROUP BY 2""")
def category_folder_counts(spark, sf_dir):

    products = stored(ingested(spark, sf_dir)[1])
    a = reports.category_counts(products).select(F.lit("category").alias("what"), F.col("category").alias("value"), "count")
    return a.unionByName(
        reports.folder_counts(products).select(F.lit("folder").alias("what"), F.col("folder_path").alias("value"), "count")
    )


@query("filtered_products", sql="""
  SELECT p_partkey AS product_id, p_name AS product_name FROM part
  WHERE p_brand = 'Brand#4' OR p_name ILIKE '%RED%'""")
def filtered_products(spark, sf_dir):
    products = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"),
        F.col("p_type").alias("folder_path"),
    )
    a = lookup.filter_products(products, category="Brand#4")
    b = lookup.filter_products(products, search="RED")
    return a.unionByName(b).select("product_id", "product_name").distinct()


@query("export_manifest", uses=("b_creatives", "b_templates"), sql="""
  SELECT creative_id, output_width, action, CASE WHEN n = 1 THEN name || '.webp' ELSE name || '-' || n || '.webp' END
    AS archive_name
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, creative_id) AS n FROM (
    SELECT c.*, replace(t.name, ' ', '-') || '/' || replace(p.p_name, ' ', '-') AS name, 'encode' AS action,
      greatest(1, floor(width * 0.5 + 0.5))::bigint AS output_width
    FROM b_creatives c JOIN b_templates t USING (template_id) JOIN part p ON 'prd_' || p.p_partkey = c.product_id))""")
def export_manifest(spark, sf_dir):
    products = B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("prd_"), F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_name").alias("product_name"),
        F.lit("imp_0").alias("import_id"),
    )
    m = exports.export_manifest(
        B.creatives(spark, sf_dir, "creative_id", "product_id", "template_id", "mime_type", "width", "created_at"), None, products, None, settings.templates(spark), "template",
        exports.ExportOptions("webp", 50),
    )
    return m.select("creative_id", "archive_name", "output_width", "action")


@query("archive_name_clashes", sql="""
  WITH RECURSIVE o AS (SELECT p_partkey, name, row_number() OVER (ORDER BY real DESC, p_partkey) AS i FROM (
      SELECT p_partkey, p_partkey % 10 = 0 AS real, CASE WHEN p_partkey % 10 = 0
        THEN split_part(p_name, ' ', 1) || '-' || (2 + p_partkey % 7) ELSE split_part(p_name, ' ', 1) END AS name
      FROM part WHERE true)),
  firsts AS (SELECT DISTINCT name FROM o),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS n FROM o),
  free AS (SELECT f.name, s.k, row_number() OVER (PARTITION BY f.name ORDER BY s.k) + 1 AS n
    FROM firsts f, range(2, 20000) s(k) WHERE f.name || '-' || s.k NOT IN (SELECT name FROM firsts)
      AND s.k <= 20 + (SELECT count(*) FROM o WHERE o.name = f.name))
  SELECT r.p_partkey, CASE WHEN r.n = 1 THEN r.name || '.jpg' ELSE r.name || '-' || free.k || '.jpg' END AS archive_name
  FROM ranked r LEFT JOIN free ON free.name = r.name AND free.n = r.n""")
def archive_name_clashes(spark, sf_dir):
    k, word = F.col("p_partkey"), F.get(F.split("p_name", " "), F.lit(0))
    real = k % 10 == 0
    named = B.table(spark, sf_dir, "part").select(
        k, real.alias("real"), F.lit("jpg").alias("extension"),
        F.concat(F.when(real, F.concat(word, F.lit("-"), (k % 7 + 2).cast("string"))).otherwise(word), F.lit(".jpg"))
        .alias("archive_name"),
    )
    return exports.number_collisions(named, [F.desc("real"), F.asc("p_partkey")]).select("p_partkey", "archive_name")


@query("report_cells", sql="""
  SELECT p_partkey, CASE WHEN p_size * p_partkey < 1 THEN '0 KB' WHEN p_size * p_partkey < 1024
      THEN (p_size * p_partkey) || ' B' ELSE floor(p_size * p_partkey / 1024.0 + 0.5)::bigint || ' KB' END AS bytes_text,
    CASE WHEN p_size * p_partkey < 60 THEN (p_size * p_partkey) || 's' WHEN p_size * p_partkey < 3600
      THEN (p_size * p_partkey // 60) || 'm ' || (p_size * p_partkey % 60) || 's'
      ELSE (p_size * p_partkey // 3600) || 'h ' || ((p_size * p_partkey // 60) % 60) || 'm' END AS seconds_text,
    CASE WHEN p_partkey < 1000 THEN p_partkey || 'ms'
      WHEN p_partkey < 60000 AND p_partkey % 125 = 0 THEN printf('%d.%ds', (p_partkey + 50) // 1000, (p_partkey + 50) // 100 % 10)
      WHEN p_partkey < 60000 THEN printf('%.1fs', p_partkey / 1000.0)
      ELSE (p_partkey // 60000) || 'm ' || floor(p_partkey % 60000 / 1000.0 + 0.5)::bigint || 's' END AS duration_text,
    p_size || '%' AS percent_text, upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS type_text
  FROM part""")
def report_cells(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    n = F.col("p_size").cast("long") * F.col("p_partkey")
    return part.select(
        "p_partkey", X.format_bytes(n).alias("bytes_text"), X.format_seconds(n).alias("seconds_text"),
        X.format_duration(F.col("p_partkey")).alias("duration_text"),
        X.percent(F.col("p_size") / 100.0).alias("percent_text"), X.humanize(F.col("p_type")).alias("type_text"),
    )


@query("work_lists", uses=("b_jobs",), sql="""
  SELECT * FROM (SELECT 'pending' AS list, job_id, priority FROM b_jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'running', job_id, priority FROM b_jobs WHERE status = 'running' ORDER BY created_at, job_id LIMIT 50)""")
def work_lists(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    lists = [
        J.by_status(jobs, s, 50).select(F.lit(s).alias("list"), "job_id", "priority") for s in ("pending", "running")
    ]
    return lists[0].unionByName(lists[1])


@query("age_text", sql=f"""
  SELECT o_orderkey, CASE WHEN s < 45 THEN 'just now' WHEN s < 90 THEN 'a minute ago' WHEN m < 60 THEN m || ' minutes ago'
      WHEN h < 24 THEN h || CASE WHEN h = 1 THEN ' hour ago' ELSE ' hours ago' END
      WHEN d < 30 THEN d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END
      ELSE strftime(placed, '%Y-%m-%d') END AS age,
    epoch_ms({_NOW}) - epoch_ms(placed) AS elapsed_ms
  FROM (SELECT *, floor(h / 24.0 + 0.5)::bigint AS d FROM (SELECT *, floor(m / 60.0 + 0.5)::bigint AS h FROM (
    SELECT *, floor(s / 60.0 + 0.5)::bigint AS m FROM (
      SELECT *, floor(greatest(0, epoch_ms({_NOW}) - epoch_ms(placed)) / 1000.0 + 0.5)::bigint AS s FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::timestamp
          ELSE {_NOW} - to_milliseconds((o_orderkey * 7919) % 9000000) END AS placed FROM orders)))))""")
def age_text(spark, sf_dir):
    """Ages of all orders; three in four are placed within hours of the report, so every wording occurs."""
    now, k = F.lit(AS_OF).cast("timestamp"), F.col("o_orderkey")
    recent = F.timestamp_millis(F.unix_millis(now) - (k * 7919) % 9000000)
    at = F.when(k % 4 == 0, F.col("o_orderdate").cast("timestamp")).otherwise(recent)
    return B.table(spark, sf_dir, "orders").select(k, at.alias("at")).select(
        "o_orderkey", X.time_ago(F.col("at"), now).alias("age"), X.elapsed_ms(F.col("at"), now).alias("elapsed_ms"),
    )


@query("anchor_lookup", uses=("b_subjects",), sql=f"""
  SELECT source_hash, coalesce(a_chin.c >= 0.35, false) AS has_chin, {S.r('a_feet.x')} AS feet_x,
    {S.r('1.0 / (1.0 + exp(-(a_neck.x / 100.0)))')} AS neck_score FROM b_subjects""")
def anchor_lookup(spark, sf_dir):
    a = F.col("anchors")
    return B.framing_subjects(spark, sf_dir).select(
        "source_hash", G.has_anchor(a, "chin", 0.35).alias("has_chin"),
        G.round_to(F.element_at(a, "feet")["x"]).alias("feet_x"),
        G.round_to(G.sigmoid(F.element_at(a, "neck")["x"] / 100.0)).alias("neck_score"),
    )
