"""Queries over layers, padding edges, fills, validation and stored payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framejobs import vocab
from framejobs.functions import geometry as G, text as X
from framejobs.operators import hygiene, layout, validate
from framejobs.plans import framing as PF, settings, shared_sql as S
from framejobs.plans.registry import cte, query
from framejobs.session import checkpoint_dir, stored
from framejobs.sources import bridge as B, keyed, media, tables

_LAYERS = [
    (t["template_id"], i, l) for t in settings.TEMPLATES for i, l in enumerate(
        sorted((l for l in t["layers"] if l["visible"]), key=lambda l: l["z_index"]))
]
cte("b_layers", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {i}, '{l['id']}', {l['x']}::double, {l['y']}::double, {l['width']}::double, {l['height']}::double, "
    f"{settings.sql_value(l['anchor_to'])}, {l['z_index']})" for t, i, l in _LAYERS
) + ") l(template_id, draw_order, layer_id, lx, ly, lw, lh, anchor_to, z)")
_TEXT = """CASE layer_id WHEN 'title' THEN 'Look ' || vec || ' / {{ category }} ' || (vec % 5 + 1) WHEN 'tag' THEN 'NEW IN'
  WHEN 'caption' THEN 'shots/{{index}}: ' || shot_type || ' {{missing}}' END"""


@query("layer_layout", uses=("framed", "b_layers"), sql=f"""
  SELECT source_hash, template_id, draw_order, layer_id, CASE WHEN z < 0 THEN 'below' ELSE 'above' END AS side, pinned,
    {S.r('coalesce(px * 2, 0.0) + lx / 100.0 * (cw * 2)', 3)} AS x, {S.r('coalesce(py * 2, 0.0) + ly / 100.0 * (ch * 2)', 3)} AS y,
    {S.r('lw / 100.0 * (cw * 2)')} AS width, {S.r('lh / 100.0 * (ch * 2)')} AS height, {_TEXT} AS text
  FROM (SELECT *, CASE WHEN pinned THEN (anchors[anchor_to].x - fx) * (cw / greatest(8.0, fw)) END AS px,
      CASE WHEN pinned THEN (anchors[anchor_to].y - fy) * (ch / greatest(8.0, fh)) END AS py FROM (
    SELECT f.*, l.* EXCLUDE (template_id), substr(source_hash, 2)::int AS vec, anchor_to IS NOT NULL AND
      list_contains(referenced, anchor_to) AND anchors[anchor_to] IS NOT NULL AS pinned
    FROM framed f JOIN b_layers l USING (template_id)))""")
def layer_layout(spark, sf_dir):
    framed = PF.framed_all(spark, sf_dir)
    n = F.col("vec_id")
    details = B.framing_subjects(spark, sf_dir).select("source_hash", "shot_type").join(
        B.table(spark, sf_dir, "embeddings").select(
            n, F.concat(F.lit("v"), n.cast("string")).alias("source_hash")), "source_hash"
    ).select(
        "source_hash", F.concat(F.lit("Look "), n.cast("string")).alias("product_name"), F.lit("c").alias("category"),
        # A value that looks like a variable must not be substituted again.
        F.lit("shots/{{index}}").alias("folder"), F.lit("f.jpg").alias("file_name"), "shot_type",
        F.lit("unknown").alias("garment_type"), (n % 5 + 1).alias("index"),
    )
    rows = layout.layer_layout(layout.with_variables(framed, details), None, vocab.SUPERSAMPLE)
    return rows.select(
        "source_hash", "template_id", "draw_order", "layer_id", "side", "pinned",
        G.round_to(F.col("rect.x"), 3).alias("x"), G.round_to(F.col("rect.y"), 3).alias("y"),
        G.round_to(F.col("rect.width")).alias("width"), G.round_to(F.col("rect.height")).alias("height"), "text",
    )


@query("fitted_assets", sql=f"""
  SELECT p_partkey, {S.r("CASE WHEN nw = 0 THEN 10.0 ELSE 10.0 + (300 - nw * k) / 2 END")} AS x,
    {S.r("CASE WHEN nw = 0 THEN 300.0 ELSE nw * k END")} AS width, {S.r("CASE WHEN nw = 0 THEN 200.0 ELSE nh * k END")} AS height
  FROM (SELECT p_partkey, (p_size - 1)::double AS nw, 40.0::double AS nh, CASE WHEN p_partkey % 2 = 0
    THEN greatest(300.0 / nullif(p_size - 1, 0), 200.0 / 40.0) ELSE least(300.0 / nullif(p_size - 1, 0), 200.0 / 40.0) END AS k
  FROM part)""")
def fitted_assets(spark, sf_dir):
    rect = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(300.0).alias("width"), F.lit(200.0).alias("height"))
    fit = F.when(F.col("p_partkey") % 2 == 0, "cover").otherwise("contain")
    fitted = G.fit_rect((F.col("p_size") - 1).cast("double"), F.lit(40.0), rect, fit)
    part = B.table(spark, sf_dir, "part").withColumn("f", fitted)
    return part.select("p_partkey", *[G.round_to(F.col(f"f.{c}")).alias(c) for c in ("x", "width", "height")])


@query("fit_within", sql="""
  SELECT p_partkey, CASE WHEN greatest(w, h) <= 2048 THEN w ELSE floor(w * (2048.0::double / greatest(w, h)) + 0.5)::bigint END AS width,
    CASE WHEN greatest(w, h) <= 2048 THEN h ELSE floor(h * (2048.0::double / greatest(w, h)) + 0.5)::bigint END AS height
  FROM (SELECT p_partkey, p_size * 100 AS w, 1500 + p_partkey AS h FROM part)""")
def fit_within(spark, sf_dir):
    size = G.fit_within(F.col("p_size") * 100, F.col("p_partkey") + 1500, 2048)
    return B.table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


def both_masks(spark, sf_dir):
    """A person mask and a garment mask (the raster reversed) for every image."""
    one = B.masks(spark, sf_dir).withColumn("kind", F.lit("person_mask"))
    return one.unionByName(one.withColumn("kind", F.lit("garment_mask")).withColumn("data", F.reverse("data")))


cte("b_grids", """
  SELECT 'v' || vec_id AS source_hash, list_transform(embedding, lambda q: greatest(0.0, least(255.0,
    floor((q::double * 3.0 + 1.0) * 127.5))) >= 127.5) AS p FROM embeddings""")
cte("e_bands", """
  SELECT f.source_hash, f.template_id, e.edge, sx, sy, sw, sh,
    CASE e.edge WHEN 'left' THEN sx WHEN 'right' THEN sx + sw - th ELSE sx END AS bx,
    CASE e.edge WHEN 'bottom' THEN sy + sh - tv ELSE sy END AS by_,
    CASE WHEN e.edge IN ('left', 'right') THEN th ELSE sw END AS bw,
    CASE WHEN e.edge IN ('top', 'bottom') THEN tv ELSE sh END AS bh
  FROM (SELECT *, least(sh, greatest(24.0, least(260.0, floor(sh * 0.06 + 0.5)))) AS tv,
      least(sw, greatest(24.0, least(260.0, floor(sw * 0.06 + 0.5)))) AS th FROM (
    SELECT source_hash, template_id, o_left, o_top, o_right, o_bottom, greatest(0.0, fx) AS sx, greatest(0.0, fy) AS sy,
      least(iw, fx + fw) - greatest(0.0, fx) AS sw, least(ih, fy + fh) - greatest(0.0, fy) AS sh FROM framed)
    WHERE sw > 0 AND sh > 0) f, (VALUES ('top'), ('bottom'), ('left'), ('right')) e(edge)
  WHERE CASE e.edge WHEN 'top' THEN o_top WHEN 'bottom' THEN o_bottom WHEN 'left' THEN o_left ELSE o_right END > 0.5""",
    ("framed",))
cte("e_content", """
  SELECT source_hash, template_id, edge, CASE WHEN gf >= 0.3 AND sf < 0.12 THEN 'garment' WHEN sf >= 0.12 THEN 'skin'
    ELSE 'background' END AS content
  FROM (SELECT source_hash, template_id, edge, count(*) FILTER (g) / count(*)::double AS gf,
      count(*) FILTER (NOT g AND q) / count(*)::double AS sf
    FROM (SELECT b.source_hash, b.template_id, b.edge, m.p[cell + 1] AS q, m.p[64 - cell] AS g FROM (
        SELECT b.*, (least(7, greatest(0, floor((by_ + ((j.j + 0.5::double) / nr) * bh) / 187.5 + 0.5))) * 8 +
          least(7, greatest(0, floor((bx + ((i.i + 0.5::double) / nc) * bw) / 125.0 + 0.5))))::int AS cell
        FROM (SELECT *, greatest(6, least(48, floor(bw + 0.5)))::int AS nc, greatest(6, least(48, floor(bh + 0.5)))::int AS nr
          FROM e_bands) b, range(48) i(i), range(48) j(j) WHERE i.i < nc AND j.j < nr) b
      JOIN b_grids m USING (source_hash)) GROUP BY ALL)""", ("e_bands", "b_grids"))


@query("edge_content", uses=("e_content",), sql="SELECT * FROM e_content")
def edge_content(spark, sf_dir):
    return layout.edge_content(PF.framed_all(spark, sf_dir), both_masks(spark, sf_dir))


_CLAUSE = vocab.GARMENT_FILL_CLAUSE.replace("'", "''")
cte("e_prompts", f"""
  SELECT f.*, CASE WHEN trim(prompt) = '' THEN '{vocab.DEFAULT_FILL_PROMPT.replace("'", "''")}' ELSE trim(prompt) END ||
    CASE WHEN c.n IS NULL THEN '' WHEN c.n = 1 THEN ' except at the ' || c.names[1] || ' edge {_CLAUSE}'
      ELSE ' except at the ' || array_to_string(c.names[1:c.n - 1], ' ') || ' and ' || c.names[c.n] || ' edges {_CLAUSE}' END AS full_prompt
  FROM framed f LEFT JOIN (SELECT source_hash, template_id, count(*) AS n, list(edge ORDER BY
      CASE edge WHEN 'top' THEN 1 WHEN 'bottom' THEN 2 WHEN 'left' THEN 3 ELSE 4 END) AS names
    FROM e_content WHERE content = 'garment' GROUP BY ALL) c USING (source_hash, template_id)
  WHERE background = 'ai_extend' AND greatest(o_left, o_top, o_right, o_bottom) > 0.5""", ("framed", "e_content"))


@query("fill_plan", uses=("e_prompts",), sql="""
  SELECT source_hash, min(template_id) AS template_id, kind, arg_min(regexp_replace(regexp_replace(full_prompt, '[,;:/|.()\\[\\]{}]',
      ' ', 'g'), '\\s+', ' ', 'g'), template_id) AS prompt, arg_min(ox, template_id) AS offset_x
  FROM (SELECT *, 'aiextend_' || concat_ws('_', floor(o_left + 0.5)::bigint, floor(o_top + 0.5)::bigint,
      floor(o_right + 0.5)::bigint, floor(o_bottom + 0.5)::bigint, substr(sha256(full_prompt), 1, 12)) AS kind,
      floor((greatest(0.0, fx) - fx) * (cw * 2 / fw) + 0.5)::bigint AS ox FROM e_prompts)
  WHERE substr(source_hash, 2)::int % 3 <> 0 GROUP BY source_hash, kind""")
def fill_plan(spark, sf_dir):
    framed = stored(PF.framed_all(spark, sf_dir))
    edges = stored(layout.edge_content(framed, both_masks(spark, sf_dir)))
    # Every third image was filled before: its plans are what the store of derived assets holds.
    third = F.substring("source_hash", 2, 20).cast("long") % 3 == 0
    nothing = spark.createDataFrame([], "source_hash string, kind string")
    filled = stored(layout.fill_plan(framed.where(third), edges, nothing).select("source_hash", "kind"))
    return layout.fill_plan(framed, edges, filled).select("source_hash", "template_id", "kind", "prompt", "offset_x")


@query("validate_rules", sql="""
  SELECT p_partkey AS rule_id, problem FROM (SELECT *, trim(split_part(p_name, ' ', 2)) AS v FROM part), (VALUES
    ('match_type'), ('operator'), ('template_unknown'), ('value_required')) t(problem)
  WHERE CASE problem WHEN 'match_type' THEN p_size % 8 = 7 WHEN 'operator' THEN p_size % 7 = 6
    WHEN 'template_unknown' THEN p_partkey % 10 >= 8
    WHEN 'value_required' THEN p_size % 8 <> 6 AND p_size % 7 <> 5 AND p_partkey % 4 = 0 END""")
def validate_rules(spark, sf_dir):
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rules = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("rule_name"),
        pick((*vocab.MATCH_TYPES, "colour"), F.col("p_size") % 8).alias("match_type"),
        pick((*vocab.OPERATORS, "like"), F.col("p_size") % 7).alias("operator"),
        F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.col("p_name")).alias("value"),
        F.concat(F.lit("tpl_"), (F.col("p_partkey") % 10).cast("string")).alias("template_id"),
    )
    return validate.validate_rules(rules, settings.templates(spark))


@query("validate_templates", sql="""
  SELECT p_partkey AS template_id, problem FROM part, (VALUES ('schema_version'), ('canvas_missing'), ('canvas_too_small'),
    ('canvas_too_large'), ('strategies_empty'), ('last_strategy_requires_anchors'), ('too_many_layers')) t(problem)
  WHERE CASE problem WHEN 'schema_version' THEN p_partkey % 20 = 0 WHEN 'canvas_missing' THEN p_size % 20 = 0
    WHEN 'canvas_too_small' THEN p_size % 20 > 0 AND p_size < 10 WHEN 'canvas_too_large' THEN p_size % 20 > 0 AND p_size > 48
    WHEN 'strategies_empty' THEN p_partkey % 9 = 0 WHEN 'last_strategy_requires_anchors' THEN p_partkey % 9 = 1
    WHEN 'too_many_layers' THEN p_partkey % 50 = 7 END""")
def validate_templates(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    needs = F.when(k % 9 == 1, F.array(F.lit("feet"))).otherwise(F.array().cast("array<string>"))
    strategies = F.when(k % 9 == 0, F.array().cast("array<struct<requires:array<string>>>")).otherwise(
        F.array(F.struct(needs.alias("requires"))))
    edge = F.when(size % 20 == 0, F.lit(None)).when(size < 10, 32).when(size > 48, 9000).otherwise(1080)
    docs = B.table(spark, sf_dir, "part").select(
        k.alias("template_id"), F.when(k % 20 == 0, 2).otherwise(1).alias("schema_version"),
        edge.alias("canvas_width"), edge.alias("canvas_height"), strategies.alias("strategies"),
        F.array_repeat(F.lit("layer"), F.when(k % 50 == 7, 101).otherwise(3)).alias("layers"),
    )
    return validate.validate_templates(docs)


@query("validate_enums", sql="""
  SELECT o_orderkey, problem FROM orders, (VALUES ('o_orderstatus'), ('o_orderpriority')) t(problem)
  WHERE (problem = 'o_orderstatus' AND o_orderstatus = 'P') OR (problem = 'o_orderpriority' AND o_orderpriority = '5-LOW')""")
def validate_enums(spark, sf_dir):
    return validate.validate_enums(B.table(spark, sf_dir, "orders"), ["o_orderkey"], {
        "o_orderstatus": ("O", "F"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"),
    })


@query("parse_payload", sql="""
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 3 = 1 THEN -1
    ELSE regexp_extract(props, '"k": ([0-9]+)', 1)::int END AS k FROM events""")
def parse_payload(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "{broken").when(F.col("event_id") % 3 == 1, "").otherwise(F.col("props"))
    default = F.struct(F.lit(-1).alias("k"))
    return B.table(spark, sf_dir, "events").select(
        "event_id", tables.parse_payload(raw, "k int", default)["k"].alias("k")
    )


@query("audit_blobs", sql="""
  SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'empty' WHEN doc_id % 10 = 1 THEN 'truncated'
    WHEN doc_id % 10 = 2 THEN 'not_jpeg' WHEN doc_id % 10 = 3 THEN 'incomplete' WHEN doc_id % 10 = 4 THEN 'wrong_size' END AS reason
  FROM documents WHERE doc_id % 10 <= 4""")
def audit_blobs(spark, sf_dir):
    docs, n = B.table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.encode("text", "UTF-8")
    soi, eoi = F.unhex(F.lit("FFD8")), F.unhex(F.lit("FFD9"))
    content = (
        F.when(n % 10 == 0, F.unhex(F.lit(""))).when(n % 10 == 2, F.concat(body, eoi)).when(n % 10 == 3, F.concat(soi, body))
        .otherwise(F.concat(soi, body, eoi))
    )
    blobs = docs.select(n.alias("key"), content.alias("content"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    expected = blobs.select(
        "key", F.when(F.col("key") % 10 == 1, F.length("content") + 7).alias("length"),
        F.when(F.col("key") % 10 == 4, 801).otherwise(800).alias("width"), F.lit(600).alias("height"),
    )
    return media.audit_blobs(blobs, expected)


@query("content_addressed_store", sql="""
  SELECT sha256(text) AS source_hash, max(CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS last_writer FROM documents
  GROUP BY 1""")
def content_addressed_store(spark, sf_dir):
    """Two writes of content-addressed rows, then an overwrite on key of their derived rows."""
    base = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    keyed.append_new(docs.filter("doc_id % 2 = 0").select("source_hash"), f"{base}/originals", ["source_hash"])
    keyed.append_new(docs.select("source_hash"), f"{base}/originals", ["source_hash"])
    odd = docs.filter("doc_id % 2 = 1")
    keyed.upsert(odd.filter("doc_id % 4 = 1"), f"{base}/derived", ["source_hash"], F.col("doc_id"))
    known = keyed.read(spark, f"{base}/derived")
    late = odd.filter("doc_id % 4 = 3").join(known.withColumnRenamed("doc_id", "old"), "source_hash", "left").select(
        F.greatest("doc_id", "old").alias("doc_id"), "source_hash")
    keyed.upsert(late, f"{base}/derived", ["source_hash"], F.col("doc_id"))
    originals = keyed.read(spark, f"{base}/originals")
    return originals.join(keyed.read(spark, f"{base}/derived"), "source_hash", "left").select(
        "source_hash", F.col("doc_id").alias("last_writer")
    )


@query("storage_cells", uses=("b_media",), sql="""
  SELECT root, CASE WHEN b < 1048576 THEN floor(b / 1024.0 + 0.5)::bigint || ' KB'
      WHEN b < 1073741824 THEN (floor(b * 10 / 1048576.0 + 0.5)::bigint // 10) || '.' || (floor(b * 10 / 1048576.0 + 0.5)::bigint % 10) || ' MB'
      ELSE (floor(b * 100 / 1073741824.0 + 0.5)::bigint // 100) || '.' || lpad((floor(b * 100 / 1073741824.0 + 0.5)::bigint % 100)::varchar, 2, '0') || ' GB'
      END AS size_text
  FROM (SELECT coalesce(root, 'total') AS root, sum(size)::bigint AS b FROM b_media GROUP BY ROLLUP (root))""")
def storage_cells(spark, sf_dir):
    usage = hygiene.storage_usage(B.media_listing(spark, sf_dir))
    return usage.select("root", X.format_bytes(F.col("bytes")).alias("size_text"))
