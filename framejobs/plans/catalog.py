"""Queries over catalogue ingest: classification, grouping, deduplication, numbering, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from framejobs.functions import paths as P, text as X
from framejobs.operators import ingest
from framejobs.plans import shared_sql as S
from framejobs.plans.registry import query
from framejobs.sources import bridge as B


def ingested(spark, sf_dir):
    return ingest.import_catalog(B.files(spark, sf_dir), B.analyses(spark, sf_dir), B.ENGINE_VERSION)


@query("classify_files", uses=("b_classified",), sql="""
  SELECT import_id, coalesce(skip_reason, 'accepted') AS outcome, count(*) AS n, sum(byte_size)::bigint AS bytes
  FROM b_classified GROUP BY ALL""")
def classify_files(spark, sf_dir):
    files = ingest.classify(B.files(spark, sf_dir))
    return files.groupBy("import_id", F.coalesce("skip_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("byte_size").alias("bytes")
    )


@query("path_expressions", uses=("b_files",), sql=f"""
  SELECT arrival, trim(replace(relative_path, '\\', '/'), '/') AS norm,
    lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) AS ext,
    regexp_extract(relative_path, '([^/\\\\]*)$', 1) AS base,
    regexp_replace(file_name, '\\.[^./\\\\]+$', '') AS stem,
    regexp_replace(file_name, '\\.[^./]+$', '') || '.webp' AS swapped,
    {S.DISPLAY.format('relative_path')} AS display, {S.SLUG.format('relative_path')} AS slug,
    array_to_string({S.NATKEY.format('file_name')}, '|') AS natural_key,
    substr(source_hash,1,2) || '/' || substr(source_hash,3,2) || '/' || source_hash || '.' ||
      CASE mime_type WHEN 'image/jpeg' THEN 'jpg' ELSE 'bin' END AS original_key,
    substr(source_hash,1,2) || '/' || substr(source_hash,3,2) || '/' || source_hash || '/preview.png' AS derived_key,
    import_id || '/' || arrival || '.jpg' AS creative_key
  FROM b_files""")
def path_expressions(spark, sf_dir):
    path, name, digest = F.col("relative_path"), F.col("file_name"), F.col("source_hash")
    return B.files(spark, sf_dir).select(
        "arrival",
        P.normalize_path(path).alias("norm"),
        P.file_extension(name).alias("ext"),
        P.base_name(path).alias("base"),
        P.strip_extension(name).alias("stem"),
        P.with_extension(name, F.lit("webp")).alias("swapped"),
        P.display_name(path).alias("display"),
        P.slugify(path).alias("slug"),
        F.array_join(P.natural_key(name), "|").alias("natural_key"),
        P.original_key(digest, F.coalesce("mime_type", F.lit(""))).alias("original_key"),
        P.derived_key(digest, F.lit("preview"), F.lit("png")).alias("derived_key"),
        P.creative_key(F.col("import_id"), F.col("arrival").cast("string"), F.lit("jpg")).alias("creative_key"),
    )


@query("display_metadata", sql="""
  SELECT p_partkey, CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 THEN p_size + 100 ELSE p_size END AS width,
    CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 THEN p_size ELSE p_size + 100 END AS height,
    CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/heif' ELSE 'application/octet-stream' END AS mime,
    CASE WHEN p_size <= 28 AND p_partkey % 3 <> 2 THEN
      epoch(make_timestamp(2024, 2, p_size, 10, 20, 30))::bigint END AS captured
  FROM part WHERE p_size > 0""")
def display_metadata(spark, sf_dir):
    part = B.table(spark, sf_dir, "part").filter("p_size > 0")
    k, fmt = F.col("p_partkey"), F.get(F.array(F.lit("jpg"), F.lit("heif"), F.lit("bmp")), (F.col("p_partkey") % 3).cast("int"))
    size = P.display_size(F.col("p_size"), F.col("p_size") + 100, F.when(k % 10 > 0, k % 10))
    # Days past the end of February are malformed dates and give null, as does the broken separator.
    raw = F.concat(
        F.lit("2024:02:"), F.lpad(F.when(F.col("p_size") > 28, 31).otherwise(F.col("p_size")).cast("string"), 2, "0"),
        F.when(k % 3 == 0, "T").when(k % 3 == 1, " ").otherwise("_"), F.lit("10:20:30"),
    )
    return part.select(
        k, size["width"].alias("width"), size["height"].alias("height"), P.mime_of_format(fmt).alias("mime"),
        F.unix_seconds(P.exif_timestamp(raw)).alias("captured"),
    )


@query("group_products", uses=("b_grouped",), sql="""
  SELECT import_id, folder_path, product_name, product_slug, category, count(*) AS files, min(arrival) AS first_arrival
  FROM b_grouped WHERE skip_reason IS NULL GROUP BY ALL""")
def group_products(spark, sf_dir):
    files = ingest.classify(B.files(spark, sf_dir)).filter("skip_reason IS NULL")
    return ingest.group_products(files).groupBy(
        "import_id", "folder_path", "product_name", "product_slug", "category"
    ).agg(F.count(F.lit(1)).alias("files"), F.min("arrival").alias("first_arrival"))


@query("import_outcomes", uses=("b_classified", "b_kept"), sql="""
  SELECT c.arrival, c.import_id, c.norm AS relative_path, c.skip_reason,
    CASE WHEN c.skip_reason IS NOT NULL THEN 'skipped' WHEN c.format IS NULL THEN 'failed' WHEN k.arrival IS NOT NULL THEN 'imported'
      ELSE 'duplicate' END AS outcome
  FROM b_classified c LEFT JOIN b_kept k USING (arrival)""")
def import_outcomes(spark, sf_dir):
    outcomes, _, _ = ingested(spark, sf_dir)
    return outcomes.select("arrival", "import_id", "relative_path", "skip_reason", "outcome")


@query("import_images", uses=("b_images",), sql="""
  SELECT image_id, product_id, source_hash, file_name, position, position = 0 AS is_primary, vision_status, storage_key
  FROM b_images""")
def import_images(spark, sf_dir):
    _, _, images = ingested(spark, sf_dir)
    return images.select(
        "image_id", "product_id", "source_hash", "file_name", "position", "is_primary", "vision_status", "storage_key"
    )


@query("import_products", uses=("b_products",), sql="""
  SELECT product_id, product_name, product_slug, folder_path, category, import_id, image_count, primary_image_id
  FROM b_products""")
def import_products(spark, sf_dir):
    _, products, _ = ingested(spark, sf_dir)
    return products.select(
        "product_id", "product_name", "product_slug", "folder_path", "category", "import_id", "image_count",
        "primary_image_id",
    )


@query("import_counters", uses=("b_classified", "b_kept"), sql="""
  SELECT c.import_id, count(*) AS total_files, count(k.arrival) AS imported_files,
    count(*) FILTER (c.skip_reason IS NULL AND c.format IS NOT NULL AND k.arrival IS NULL) AS duplicate_files,
    count(c.skip_reason) AS skipped_files, count(*) FILTER (c.skip_reason IS NULL AND c.format IS NULL) AS failed_files
  FROM b_classified c LEFT JOIN b_kept k USING (arrival) GROUP BY 1""")
def import_counters(spark, sf_dir):
    outcomes, _, _ = ingested(spark, sf_dir)
    return ingest.import_counters(outcomes)


@query("scan_summary", uses=("b_grouped",), sql="""
  SELECT import_id, count(*) FILTER (skip_reason IS NULL) AS accepted,
    count(DISTINCT CASE WHEN skip_reason IS NULL THEN product_id END) AS products,
    coalesce(sum(byte_size) FILTER (skip_reason IS NULL), 0)::bigint AS total_bytes,
    count(*) FILTER (skip_reason = 'system_file') AS system_file, count(*) FILTER (skip_reason = 'empty') AS empty,
    count(*) FILTER (skip_reason = 'too_large') AS too_large,
    count(*) FILTER (skip_reason = 'unsupported_type') AS unsupported_type
  FROM b_grouped GROUP BY 1""")
def scan_summary(spark, sf_dir):
    return ingest.scan_summary(B.files(spark, sf_dir))


@query("analysis_requests", uses=("b_images",), sql="""
  SELECT source_hash, min(image_id) AS image_id, any_value(storage_key) AS storage_key,
    'vision:' || source_hash AS dedupe_key, 10 AS priority
  FROM b_images WHERE vision_status <> 'ready' GROUP BY source_hash""")
def analysis_requests(spark, sf_dir):
    _, _, images = ingested(spark, sf_dir)
    return ingest.analysis_requests(images.filter("vision_status <> 'ready'"))


@query("reanalysis_worklist", uses=("b_images",), sql="""
  SELECT k.image_id, coalesce(CASE l.quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' END, k.vision_status)
    AS vision_status, 'vision:' || k.source_hash || ':force' AS dedupe_key
  FROM b_images k LEFT JOIN labels l ON l.doc_id = k.arrival
  WHERE coalesce(CASE l.quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' END, k.vision_status)
    IN ('pending', 'unavailable', 'failed')""")
def reanalysis_worklist(spark, sf_dir):
    _, _, images = ingested(spark, sf_dir)
    labelled = images.join(B.vision_status(spark, sf_dir), "arrival", "left").withColumn(
        "vision_status", F.coalesce("label_status", "vision_status")
    )
    return ingest.reanalysis_worklist(labelled, all_pending=True).select(
        "image_id", "vision_status",
        F.concat(X.dedupe_key("vision", F.col("source_hash")), F.lit(":force")).alias("dedupe_key"),
    )


@query("propagated_status", uses=("b_images", "b_analyses"), sql="""
  SELECT k.image_id, coalesce(a.status, k.vision_status) AS vision_status
  FROM b_images k LEFT JOIN (SELECT * FROM b_analyses WHERE engine_version = '1.0') a USING (source_hash)""")
def propagated_status(spark, sf_dir):
    _, _, images = ingested(spark, sf_dir)
    results = B.analyses(spark, sf_dir).filter("engine_version = '1.0'")
    return ingest.propagate_status(images, results).select("image_id", "vision_status")


@query("pack_by_bytes", sql="""
  WITH RECURSIVE ordered AS (
    SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
  walk AS (
    SELECT source, doc_id, i, 0 AS unit_id, n_chars AS total FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.source, o.doc_id, o.i,
      CASE WHEN w.total + o.n_chars > 20000 THEN w.unit_id + 1 ELSE w.unit_id END,
      CASE WHEN w.total + o.n_chars > 20000 THEN o.n_chars ELSE w.total + o.n_chars END
    FROM walk w JOIN ordered o ON o.source = w.source AND o.i = w.i + 1)
  SELECT source, doc_id, unit_id FROM walk""")
def pack_by_bytes(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return ingest.pack_by_bytes(docs, ["source"], "doc_id", "n_chars", 20_000).select("source", "doc_id", "unit_id")
