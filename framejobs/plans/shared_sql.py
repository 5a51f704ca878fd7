"""The driver-table mappings of ``sources.bridge`` as SQL, for the second engine."""

from framejobs import vocab
from framejobs.plans.registry import cte


def sql_list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def r(expr: str, digits: int = 4) -> str:
    """Reporting round, same arithmetic as ``geometry.round_to``."""
    scale = float(10**digits)
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


NATKEY = (
    "list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN "
    "regexp_matches(x, '^[0-9]') THEN '0' || lpad(length(ltrim(x, '0'))::varchar, 4, '0') || ltrim(x, '0') "
    "ELSE x END)"
)
DISPLAY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract({0}, '([^/\\\\]*)$', 1), "
    "'\\.[^./\\\\]+$', ''), '_+|-{{2,}}', ' ', 'g'), '\\s+', ' ', 'g'))"
)
SLUG = (
    "CASE WHEN regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g') = '' THEN 'item' ELSE "
    "substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) END"
)
SHOTS, GARMENTS = sql_list(vocab.SHOT_TYPES), sql_list(vocab.GARMENT_TYPES)
AT = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(({0})::bigint))"

cte("b_files", f"""
  SELECT doc_id AS arrival, 'imp_' || (doc_id % 2) AS import_id,
    CASE WHEN doc_id % 50 = 7 THEN fn
         WHEN doc_id % 17 = 0 THEN lang || '/.cache/' || fn
         WHEN doc_id % 13 = 0 THEN '\\' || lang || '\\set-0\\' || fn
         WHEN doc_id % 2 = 0 THEN lang || '/' || source || '/' || fn
         ELSE lang || '/set-' || (doc_id % 3) || '/' || fn END AS relative_path,
    fn AS file_name,
    CASE doc_id % 11 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' END AS mime_type,
    n_chars AS byte_size, sha256(text) AS source_hash, {AT.format('doc_id')} AS created_at,
    CASE WHEN sha256(text) LIKE '0%' THEN NULL WHEN substr(sha256(text), 1, 1) IN ('1', '2', '3') THEN 'png'
         WHEN substr(sha256(text), 1, 1) IN ('4', '5') THEN 'webp' ELSE 'jpeg' END AS format
  FROM (SELECT *, 'look-' || doc_id ||
          (['.jpg','.PNG','.webp','.txt','.DS_Store'])[(doc_id % 5)::int + 1] AS fn FROM documents)""")

cte("b_classified", """
  SELECT *, trim(replace(relative_path, '\\', '/'), '/') AS norm,
    CASE
      WHEN regexp_matches(lower(trim(replace(relative_path, '\\', '/'), '/')),
        '(?:^|/)(?:\\.|~\\$|(?:__macosx|thumbs\\.db|desktop\\.ini|ehthumbs\\.db|node_modules|\\.picasaoriginals)(?:/|$))')
        THEN 'system_file'
      WHEN byte_size <= 0 THEN 'empty'
      WHEN byte_size > 67108864 THEN 'too_large'
      WHEN mime_type IS NOT NULL AND mime_type NOT LIKE 'image/%' THEN 'unsupported_type'
      WHEN mime_type IN ('image/jpeg','image/png','image/webp','image/avif','image/tiff') THEN NULL
      WHEN lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) IN ('jpg','jpeg','png','webp','avif','tif','tiff')
        THEN NULL
      ELSE 'unsupported_type' END AS skip_reason
  FROM b_files""", ("b_files",))

cte("b_grouped", f"""
  SELECT *, {SLUG.format('product_name')} AS product_slug,
    'prd_' || sha256(import_id || chr(31) || folder_path || CASE WHEN folder_path = '' THEN chr(31) || file_name ELSE '' END)
      AS product_id
  FROM (
    SELECT *, CASE WHEN folder_path = '' THEN {DISPLAY.format('file_name')}
                   ELSE {DISPLAY.format('parts[-1]')} END AS product_name,
      CASE WHEN folder_path <> '' AND len(parts) >= 2 THEN {DISPLAY.format('parts[-2]')} END AS category
    FROM (SELECT *, string_split(folder_path, '/') AS parts
          FROM (SELECT * EXCLUDE (relative_path), norm AS relative_path,
                  regexp_extract(norm, '^(.*)/[^/]*$', 1) AS folder_path FROM b_classified)))""", ("b_classified",))

cte("b_kept", """
  SELECT *, 'img_' || sha256(product_id || chr(31) || source_hash) AS image_id
  FROM b_grouped WHERE skip_reason IS NULL AND format IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id, source_hash ORDER BY arrival) = 1""", ("b_grouped",))

cte("b_analysis_events", f"""
  SELECT doc_id AS arrival, sha256(text) AS source_hash, v || '.0' AS engine_version,
    CASE WHEN doc_id % 10 = 9 THEN 0 ELSE 1 END AS schema_version,
    CASE WHEN (doc_id + v) % 7 <= 1 THEN 'failed' WHEN (doc_id + v) % 7 = 2 THEN 'unavailable' ELSE 'ready' END
      AS status,
    CASE WHEN (doc_id + v) % 7 > 2 THEN ({SHOTS})[((doc_id + v) % 9)::int + 1] END AS shot_type,
    CASE WHEN (doc_id + v) % 7 > 2 THEN ({GARMENTS})[(doc_id % 6)::int + 1] END AS garment_type,
    CASE WHEN (doc_id + v) % 7 > 2 THEN (doc_id % 100) / 100.0::double ELSE 0.0::double END AS overall_confidence,
    CASE WHEN (doc_id + v) % 7 <= 2 THEN 'error ' || doc_id END AS error,
    {AT.format('(doc_id * 7) % 1000 + v * 500')} AS created_at
  FROM documents, (VALUES (1), (2)) t(v) WHERE v = 1 OR doc_id % 3 <> 0""")

cte("b_analyses", """
  SELECT * FROM b_analysis_events
  QUALIFY row_number() OVER (PARTITION BY source_hash, engine_version ORDER BY created_at DESC, arrival DESC) = 1""",
    ("b_analysis_events",))

cte("b_images", f"""
  SELECT k.*, row_number() OVER (PARTITION BY product_id ORDER BY {NATKEY.format('file_name')}, created_at, image_id)
      - 1 AS position,
    CASE WHEN EXISTS (SELECT 1 FROM b_analyses a WHERE a.source_hash = k.source_hash AND a.engine_version = '2.0'
         AND a.status = 'ready') THEN 'ready' ELSE 'pending' END AS vision_status,
    substr(source_hash, 1, 2) || '/' || substr(source_hash, 3, 2) || '/' || source_hash ||
      CASE format WHEN 'jpeg' THEN '.jpg' ELSE '.' || format END AS storage_key
  FROM b_kept k""", ("b_kept", "b_analyses"))

cte("b_products", """
  SELECT product_id, arg_min(product_name, arrival) AS product_name, arg_min(product_slug, arrival) AS product_slug,
    arg_min(folder_path, arrival) AS folder_path, arg_min(coalesce(category, ''), arrival) AS category0,
    arg_min(import_id, arrival) AS import_id, min(created_at) AS created_at,
    count(*) AS image_count, arg_min(image_id, position) AS primary_image_id,
    nullif(arg_min(coalesce(category, ''), arrival), '') AS category
  FROM b_images GROUP BY product_id""", ("b_images",))

cte("b_usable", """
  SELECT source_hash, shot_type, garment_type, overall_confidence, schema_version, stale FROM (
    SELECT h.source_hash,
      coalesce(c.source_hash IS NOT NULL, false) AS has_current,
      CASE WHEN c.source_hash IS NOT NULL THEN c.shot_type ELSE l.shot_type END AS shot_type,
      CASE WHEN c.source_hash IS NOT NULL THEN c.garment_type ELSE l.garment_type END AS garment_type,
      CASE WHEN c.source_hash IS NOT NULL THEN c.overall_confidence ELSE l.overall_confidence END
        AS overall_confidence,
      CASE WHEN c.source_hash IS NOT NULL THEN c.schema_version ELSE l.schema_version END AS schema_version,
      c.source_hash IS NULL AS stale,
      c.source_hash IS NOT NULL OR (l.status = 'ready' AND l.schema_version <> 0) AS ok
    FROM (SELECT DISTINCT source_hash FROM b_analyses) h
    LEFT JOIN (SELECT * FROM b_analyses WHERE engine_version = '2.0' AND status = 'ready' AND schema_version <> 0) c
      USING (source_hash)
    LEFT JOIN (SELECT * FROM b_analyses QUALIFY row_number() OVER (PARTITION BY source_hash
      ORDER BY created_at DESC, engine_version DESC) = 1) l USING (source_hash)) WHERE ok""", ("b_analyses",))

cte("b_jobs", """
  SELECT *, CASE WHEN status = 'failed' THEN 'error ' || k END AS error,
    CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN created_at + INTERVAL 1 DAY END AS completed_at
  FROM (SELECT o_orderkey AS k, 'job_' || o_orderkey AS job_id,
    (['vision','render','background_fill'])[(o_orderkey % 3)::int + 1] AS kind,
    CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'running'
         WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 1 THEN 'claimed'
         WHEN o_orderstatus = 'O' THEN 'pending'
         WHEN o_orderstatus = 'F' AND o_orderkey % 9 = 0 THEN 'cancelled'
         WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status,
    substr(o_orderpriority, 1, 1)::int * 10 AS priority, 'bat_' || (o_custkey % 50) AS batch_id,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'bgfill:' || (o_orderkey % 500) END AS dedupe_key,
    (o_orderkey % 4)::int AS attempts, 3 AS max_attempts,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS heartbeat_at,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS available_at,
    o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders)""")

cte("b_batches", """
  SELECT 'bat_' || c_custkey AS batch_id, 'Batch ' || c_mktsegment AS name,
    CASE c_custkey % 10 WHEN 3 THEN 'cancelled' WHEN 4 THEN 'running' ELSE 'queued' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' END AS started_at
  FROM customer""")

cte("b_creative_events", """
  SELECT 'crt_' || l_orderkey || '_' || l_linenumber AS creative_id, 'img_' || l_partkey AS image_id,
    'tpl_' || (l_suppkey % 8) AS template_id, 'prd_' || (l_partkey % 300) AS product_id,
    'bat_' || (l_orderkey % 50) AS batch_id,
    'bat_' || (l_orderkey % 50) || '/img_' || l_partkey || '_tpl_' || (l_suppkey % 8) || '.jpg' AS storage_key,
    CASE WHEN l_linestatus = 'O' THEN 'image/png' ELSE 'image/jpeg' END AS mime_type,
    (800 + l_quantity * 10)::int AS width, floor(l_extendedprice)::bigint AS byte_size,
    (['head_to_feet','head_to_knees','subject_fit'])[l_linenumber % 3 + 1] AS strategy_id,
    l_linenumber % 3 <> 0 AS used_fallback,
    CASE l_returnflag WHEN 'A' THEN ['max_upscale_clamped'] WHEN 'R' THEN ['keep_inside_violated','fallback_used']
      ELSE [] END AS violations,
    l_shipdate AS created_at, l_orderkey AS seq, l_linenumber AS sub_seq FROM lineitem""")

cte("b_creatives", """
  SELECT * FROM b_creative_events QUALIFY row_number() OVER (PARTITION BY image_id, template_id
    ORDER BY created_at DESC, seq DESC, sub_seq DESC) = 1""", ("b_creative_events",))

cte("b_media", """
  SELECT 'assets' AS root, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS key, length(html)::bigint AS size
    FROM pages
  UNION ALL SELECT DISTINCT 'originals', substr(h,1,2) || '/' || substr(h,3,2) || '/' || h ||
    CASE WHEN doc_id % 9 = 0 THEN '.png' ELSE '.jpg' END, n_chars FROM (SELECT *, sha256(text) h FROM documents)
  UNION ALL SELECT DISTINCT 'derived', substr(h,1,2) || '/' || substr(h,3,2) || '/' ||
    CASE WHEN doc_id % 6 = 0 THEN reverse(h) ELSE h END || '/person_mask.png', n_chars + 1
    FROM (SELECT *, sha256(text) h FROM documents)
  UNION ALL SELECT DISTINCT 'creatives', 'bat_' || (l_orderkey % 50) || '/img_' || l_partkey || '_tpl_' ||
    (l_suppkey % 8) || '.jpg', l_partkey + 100 FROM lineitem""")


def e(i: int) -> str:
    return f"embedding[{i}]::double"


cte("b_subjects", "SELECT 'v' || vec_id AS source_hash, 1000.0::double AS iw, 1500.0::double AS ih,"
    f"({SHOTS})[label % 9 + 1] AS shot_type,"
    + ",".join(
        f"CASE WHEN least(1.0, abs({e(i)}) * 4.0) >= 0.05 THEN {{'x': 500.0::double + {e(i)} * 800.0, 'y': "
        f"{80.0 * i}::double + {e(i + 20)} * 300.0, 'c': least(1.0::double, abs({e(i)}) * 4.0)}} END AS a_{name}"
        for i, name in enumerate(vocab.ANCHOR_NAMES, 1)
    )
    + f", vec_id % 4 <> 0 AS has_box, 250.0::double + {e(41)} * 300.0 AS bl, 120.0::double + {e(42)} * 300.0 AS bt,"
    f"750.0::double + {e(43)} * 300.0 AS br, 1380.0::double + {e(44)} * 300.0 AS bb FROM embeddings")
