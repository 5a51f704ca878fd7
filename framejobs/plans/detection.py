"""Queries over detections, rasters and image analysis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framejobs import vocab
from framejobs.functions import geometry as G
from framejobs.operators import analyze, detect, hooks, raster, reports
from framejobs.plans import shared_sql as S
from framejobs.plans.registry import cte, query
from framejobs.session import stored
from framejobs.sources import bridge as B

_SX, _SY = "(1000.0::double / 853.0::double)", "(1500.0::double / 1280.0::double)"


def _ux(v: str) -> str:
    return f"((({v}) - 106.0) / 0.5 * {_SX})"


def _uy(v: str) -> str:
    return f"((({v}) - 0.0) / 0.5 * {_SY})"


def _fx(v: str) -> str:
    return f"((({v}) - 0.0) / 0.5 * {_SX})"


cte("b_pose", f"""
  SELECT *, (br - bl) * (bb - bt) AS area, least(1.0, (br - bl) * (bb - bt) / 1500000.0) AS area_ratio,
    len(list_filter(kps, lambda k: k.v)) AS visible,
    coalesce(list_avg(list_transform(list_filter(kps, lambda k: k.v), lambda k: k.s)), 0.0) AS kconf
  FROM (SELECT vec_id, label, score, least(1000.0, greatest(0.0, {_ux('c0 - c2 / 2')})) AS bl,
      least(1500.0, greatest(0.0, {_uy('c1 - c3 / 2')})) AS bt, least(1000.0, greatest(0.0, {_ux('c0 + c2 / 2')})) AS br,
      least(1500.0, greatest(0.0, {_uy('c1 + c3 / 2')})) AS bb,
      list_transform(pts, lambda p: {{'x': p.x, 'y': p.y, 's': p.s,
        'v': p.s >= 0.3 AND p.x >= 0 AND p.y >= 0 AND p.x <= 1000 AND p.y <= 1500}}) AS kps
    FROM (SELECT vec_id, label, 320.0 + {S.e(1)} * 600.0 AS c0, 320.0 + {S.e(2)} * 600.0 AS c1,
        40.0 + abs({S.e(3)}) * 400.0 AS c2, 80.0 + abs({S.e(4)}) * 900.0 AS c3,
        least(1.0, 0.2::double + abs({S.e(5)}) * 4.0) AS score,
        list_transform(range(17), lambda k: {{'x': {_ux('320.0 + embedding[6 + 3 * k]::double * 700.0')},
          'y': {_uy('30.0 * (k + 1) + embedding[7 + 3 * k]::double * 700.0')},
          's': least(1.0::double, abs(embedding[8 + 3 * k]::double) * 4.0)}}) AS pts FROM embeddings))
  WHERE score >= 0.35 AND br > bl AND bb > bt""")

cte("b_face", f"""
  SELECT * FROM (SELECT vec_id, label, score, least(1000.0, greatest(0.0, {_fx('cx - d0')})) AS bl,
    least(1500.0, greatest(0.0, {_uy('cy - d1')})) AS bt, least(1000.0, greatest(0.0, {_fx('cx + d2')})) AS br,
    least(1500.0, greatest(0.0, {_uy('cy + d3')})) AS bb, {_fx('cx + o0')} AS lx, {_uy('cy + o1')} AS ly,
    {_fx('cx + o2')} AS rx, {_uy('cy + o3')} AS ry
  FROM (SELECT *, ((cell // 2) % cells) * stride AS cx, ((cell // 2) // cells) * stride AS cy,
      """ + ", ".join(f"abs({S.e(20 + i)}) * 12.0 * stride AS d{i}" for i in range(4)) + ", "
    + ", ".join(f"{S.e(30 + i)} * 10.0 * stride AS o{i}" for i in range(4)) + f"""
    FROM (SELECT *, (vec_id * 37) % (cells * cells * 2) AS cell, least(1.0::double, abs({S.e(60)}) * 6.0) AS score
      FROM (SELECT *, ([8, 16, 32])[(vec_id % 3)::int + 1] AS stride, ([80, 40, 20])[(vec_id % 3)::int + 1] AS cells
        FROM embeddings)))) WHERE score >= 0.5 AND br - bl > 1 AND bb - bt > 1""")


def _nms_sql(source: str, limit: float) -> str:
    return f"""
  WITH RECURSIVE ranked AS (SELECT label, vec_id, bl, bt, br, bb, row_number() OVER (PARTITION BY label
      ORDER BY score DESC, vec_id) AS i FROM {source}),
  walk AS (
    SELECT label, i, [{{'id': vec_id, 'bl': bl, 'bt': bt, 'br': br, 'bb': bb}}] AS kept FROM ranked WHERE i = 1
    UNION ALL
    SELECT w.label, r.i, CASE WHEN len(kept) >= 20 OR len(list_filter(kept, lambda k:
        greatest(0.0, least(k.br, r.br) - greatest(k.bl, r.bl)) * greatest(0.0, least(k.bb, r.bb) - greatest(k.bt, r.bt))
        / ((k.br - k.bl) * (k.bb - k.bt) + (r.br - r.bl) * (r.bb - r.bt) - greatest(0.0, least(k.br, r.br) -
          greatest(k.bl, r.bl)) * greatest(0.0, least(k.bb, r.bb) - greatest(k.bt, r.bt))) > {limit})) > 0 THEN kept
      ELSE list_append(kept, {{'id': r.vec_id, 'bl': r.bl, 'bt': r.bt, 'br': r.br, 'bb': r.bb}}) END
    FROM walk w JOIN ranked r ON r.label = w.label AND r.i = w.i + 1),
  final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)
  SELECT label, u.id AS vec_id, pos - 1 AS detection_index FROM (
    SELECT label, unnest(kept) AS u, unnest(range(1, len(kept) + 1)) AS pos FROM final)"""


cte("b_persons", _nms_sql("b_pose", 0.45), ("b_pose",))
cte("b_faces", _nms_sql("b_face", 0.4), ("b_face",))


@query("decode_pose", uses=("b_pose",), sql=f"""
  SELECT 'v' || label AS source_hash, vec_id AS anchor_index, {S.r('score')} AS score, {S.r('bl')} AS box_left,
    {S.r('bt')} AS box_top, {S.r('br')} AS box_right, {S.r('bb')} AS box_bottom, {S.r('kconf')} AS keypoint_confidence,
    visible AS visible_keypoints, {S.r('area_ratio')} AS area_ratio, {S.r('kps[1].x')} AS nose_x, kps[1].v AS nose_visible,
    {S.r('kps[17].y')} AS ankle_y FROM b_pose""")
def decode_pose(spark, sf_dir):
    d, r = detect.decode_pose(B.pose_candidates(spark, sf_dir)), G.round_to
    kp = F.col("keypoints")
    return d.select(
        "source_hash", "anchor_index", r(F.col("score")).alias("score"),
        *[r(F.col(f"box.{s}")).alias(f"box_{s}") for s in ("left", "top", "right", "bottom")],
        r(F.col("keypoint_confidence")).alias("keypoint_confidence"),
        F.col("visible_keypoint_count").alias("visible_keypoints"), r(F.col("area_ratio")).alias("area_ratio"),
        r(kp["nose"]["x"]).alias("nose_x"), kp["nose"]["visible"].alias("nose_visible"),
        r(kp["right_ankle"]["y"]).alias("ankle_y"),
    )


@query("decode_faces", uses=("b_face",), sql=f"""
  SELECT 'v' || label AS source_hash, vec_id AS anchor_index, {S.r('score')} AS score, {S.r('bl')} AS box_left,
    {S.r('bt')} AS box_top, {S.r('br')} AS box_right, {S.r('bb')} AS box_bottom, {S.r('lx')} AS eye_x,
    {S.r('degrees(atan2(ry - ly, rx - lx))')} AS roll FROM b_face""")
def decode_faces(spark, sf_dir):
    d, r = detect.decode_faces(B.face_candidates(spark, sf_dir)), G.round_to
    return d.select(
        "source_hash", "anchor_index", r(F.col("score")).alias("score"),
        *[r(F.col(f"box.{s}")).alias(f"box_{s}") for s in ("left", "top", "right", "bottom")],
        r(F.col("landmarks.left_eye.x")).alias("eye_x"), r(F.col("roll")).alias("roll"),
    )


def persons_by_label(spark, sf_dir):
    return detect.nms(detect.decode_pose(B.pose_candidates(spark, sf_dir)), vocab.THRESHOLDS["person_nms_iou"])


def faces_by_label(spark, sf_dir):
    return detect.nms(detect.decode_faces(B.face_candidates(spark, sf_dir)), vocab.THRESHOLDS["face_nms_iou"])


@query("suppress_persons", uses=("b_persons",), sql="SELECT 'v' || label AS source_hash, vec_id AS anchor_index, detection_index FROM b_persons")
def suppress_persons(spark, sf_dir):
    return persons_by_label(spark, sf_dir).select("source_hash", "anchor_index", "detection_index")


@query("suppress_faces", uses=("b_faces",), sql="SELECT 'v' || label AS source_hash, vec_id AS anchor_index, detection_index FROM b_faces")
def suppress_faces(spark, sf_dir):
    return faces_by_label(spark, sf_dir).select("source_hash", "anchor_index", "detection_index")


cte("b_primary", """
  SELECT label, detection_index AS person_index, bl, bt, br, bb FROM (
    SELECT k.label, k.detection_index, p.*, p.area_ratio * 0.45 + p.score * 0.20 + p.visible / 17.0::double * 0.20 +
      (1.0 - least(1.0, abs((bl + br) / 2 - 500.0) / 500.0)) * 0.15 AS value
    FROM b_persons k JOIN (SELECT * EXCLUDE (label) FROM b_pose) p USING (vec_id))
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, detection_index) = 1""", ("b_persons", "b_pose"))


@query("primary_subject", uses=("b_primary", "b_faces", "b_face"), sql="""
  WITH f AS (SELECT k.label, k.detection_index, g.score, g.bl, g.bt, g.br, g.bb, p.bl AS pl, p.bt AS pt, p.br AS pr,
      p.bb AS pb, (g.br - g.bl) * (g.bb - g.bt) AS fa,
      greatest(0.0, least(g.br, p.br) - greatest(g.bl, p.bl)) * greatest(0.0, least(g.bb, p.bb) - greatest(g.bt, p.bt))
        / ((g.br - g.bl) * (g.bb - g.bt)) AS inside
    FROM b_faces k JOIN (SELECT * EXCLUDE (label) FROM b_face) g USING (vec_id) JOIN b_primary p USING (label)),
  best AS (SELECT label, detection_index AS face_index FROM f WHERE inside >= 0.5 QUALIFY row_number() OVER (PARTITION BY
    label ORDER BY inside * 0.5 + score * 0.3 + least(1.0, fa / ((pr - pl) * (pb - pt) * 0.15)) * 0.2 DESC,
    detection_index) = 1)
  SELECT 'v' || label AS source_hash, person_index, face_index FROM b_primary LEFT JOIN best USING (label)
  """.replace("WITH f AS", "SELECT * FROM (WITH f AS") + ")")
def primary_subject(spark, sf_dir):
    persons = detect.gather(persons_by_label(spark, sf_dir), "persons")
    faces = detect.gather(faces_by_label(spark, sf_dir), "faces")
    images = persons.join(faces, "source_hash", "left").withColumn("image_width", F.lit(1000.0))
    return detect.with_primary_subject(images).select(
        "source_hash", F.col("primary_person_index").alias("person_index"), F.col("primary_face_index").alias("face_index")
    )


cte("b_masks", """
  SELECT vec_id, 'v' || vec_id AS source_hash, CASE WHEN vec_id % 2 = 0 THEN 'person_mask' ELSE 'garment_mask' END AS kind,
    i - 1 AS i, (i - 1) % 8 AS x, (i - 1) // 8 AS y,
    greatest(0.0, least(255.0, floor((embedding[i]::double * 3.0 + 1.0) * 127.5))) AS v
  FROM embeddings, range(1, 65) r(i)""")
cte("b_mask_stats", """
  SELECT vec_id, source_hash, kind, count(*) AS n, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b,
    count(*) / 64.0::double AS coverage, sum(v) / count(*) / 255 AS mean_p, sum(x) / count(*)::double AS cx,
    sum(y) / count(*)::double AS cy, min(x) FILTER (y = ty) AS tl, max(x) FILTER (y = ty) + 1 AS tr,
    min(x) FILTER (y = by_) AS bl, max(x) FILTER (y = by_) + 1 AS br_
  FROM (SELECT *, min(y) OVER w AS ty, max(y) OVER w AS by_ FROM b_masks WHERE v >= 128
    WINDOW w AS (PARTITION BY source_hash)) GROUP BY ALL""", ("b_masks",))


@query("mask_features", uses=("b_mask_stats",), sql=f"""
  SELECT source_hash, kind, n AS set_pixels, l AS "left", t AS top, r AS "right", b AS bottom,
    {S.r('coverage')} AS coverage, {S.r('mean_p')} AS mean_probability, {S.r('cx')} AS centroid_x,
    {S.r('cy')} AS centroid_y, tl AS top_left, tr AS top_right, bl AS bottom_left, br_ AS bottom_right FROM b_mask_stats""")
def mask_features(spark, sf_dir):
    m, r = raster.mask_features(B.masks(spark, sf_dir)), G.round_to
    return m.select(
        "source_hash", "kind", "set_pixels", "left", "top", "right", "bottom",
        *[r(F.col(c)).alias(c) for c in ("coverage", "mean_probability", "centroid_x", "centroid_y")],
        "top_left", "top_right", "bottom_left", "bottom_right",
    )


def raster_hook(batch):
    """A stand-in for a segmentation model: vectors as 8 x 8 probability rasters."""
    values = np.clip(np.floor((batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 3.0 + 1.0) * 127.5), 0.0, 255.0)
    rows = batch.num_rows
    numbers = batch.column("vec_id").to_pylist()
    return pa.RecordBatch.from_arrays([
        batch.column("source_hash"), pa.array(["garment_mask" if n % 2 else "person_mask" for n in numbers], pa.string()),
        pa.array([8] * rows, pa.int32()), pa.array([8] * rows, pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 64), pa.array(values.astype(np.int16))),
    ], names=["source_hash", "kind", "width", "height", "data"])


@query("scored_masks", uses=("b_mask_stats",), sql=f"""
  SELECT source_hash, kind, n AS set_pixels, {S.r('coverage')} AS coverage, {S.r('mean_p')} AS mean_probability FROM b_mask_stats""")
def scored_masks(spark, sf_dir):
    """Mask features of rasters that a user's scorer makes, in place of the raw table."""
    images = B.table(spark, sf_dir, "embeddings").withColumn("source_hash", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    masks = hooks.score(images, raster_hook, hooks.Contract(("source_hash", "vec_id", "embedding"), hooks.GIVES["mask"]))
    m, r = raster.mask_features(masks), G.round_to
    return m.select("source_hash", "kind", "set_pixels", r(F.col("coverage")).alias("coverage"), r(F.col("mean_probability")).alias("mean_probability"))


@query("row_profile", uses=("b_masks",), sql="""
  SELECT source_hash, kind, y, count(*) FILTER (v >= 128) AS set_pixels FROM b_masks GROUP BY ALL""")
def row_profile(spark, sf_dir):
    return raster.row_profile(B.masks(spark, sf_dir))


def _in(s: str) -> str:
    return "(" + ", ".join(str(c) for c in vocab.CLASS_SETS[s]) + ")"


_RANGED = ("garment", "upper_garment", "lower_garment", "head", "feet")
_SINGLE = ("dress", "upper_clothes", "skirt", "pants", "scarf", "bag")
cte("b_cells", """
  SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, ((floor(embedding[i]::double * 1000.0)::bigint % 18) + 18) % 18 AS cls,
    least(1.0::double, abs(embedding[i]::double) * 5.0) AS conf FROM embeddings, range(1, 65) r(i)""")
cte("b_lines", "SELECT vec_id, y, " + ", ".join(
    f"count(*) FILTER (cls IN {_in(s)}) AS n_{s}" for s in (*_RANGED, "body")
) + ", " + ", ".join(f"count(*) FILTER (cls = {vocab.ATR[c]}) AS c_{c}" for c in _SINGLE) + f""",
    min(x) FILTER (cls IN {_in('garment')}) AS lo, max(x) FILTER (cls IN {_in('garment')}) AS hi,
    sum(x) FILTER (cls IN {_in('garment')}) AS sx, sum(conf) FILTER (cls IN {_in('garment')}) AS sc
  FROM b_cells WHERE cls <> 0 GROUP BY ALL""", ("b_cells",))
cte("b_parse", "SELECT vec_id, sum(n_garment)::bigint AS garment_pixels, sum(n_body)::bigint AS body_pixels, " + ", ".join(
    f"sum(c_{c})::bigint AS {c}_pixels" for c in _SINGLE
) + """, min(lo) AS g_left, min(y) FILTER (n_garment > 0) AS g_top, max(hi) + 1 AS g_right,
    max(y) FILTER (n_garment > 0) + 1 AS g_bottom, coalesce(sum(sc) / nullif(sum(n_garment), 0), 0.0) AS g_conf, """ + ", ".join(
    f"min(y) FILTER (n_{s} >= 2) AS {s}_first, max(y) FILTER (n_{s} >= 2) AS {s}_last" for s in _RANGED
) + ", arg_max(sx / nullif(n_garment, 0)::double, n_garment * 8 + 7 - y) FILTER (n_garment > 0) AS widest FROM b_lines GROUP BY 1",
    ("b_lines",))


@query("parse_features", uses=("b_parse",), sql="SELECT 'v' || vec_id AS source_hash, garment_pixels, body_pixels, " + ", ".join(
    f"{c}_pixels" for c in _SINGLE) + ", g_left AS garment_left, g_top AS garment_top, g_right AS garment_right, "
    f"g_bottom AS garment_bottom, {S.r('g_conf')} AS garment_confidence, " + ", ".join(
    f"{s}_first AS {s}_first_row, {s}_last AS {s}_last_row" for s in _RANGED) + f", {S.r('widest')} AS widest_row_center FROM b_parse")
def parse_features(spark, sf_dir):
    p = raster.parse_features(B.parses(spark, sf_dir))
    return p.drop("width", "height", "scale_x", "scale_y").withColumns({
        c: G.round_to(F.col(c)) for c in ("garment_confidence", "widest_row_center")
    })


@query("argmax_classes", sql=f"""
  WITH l AS (SELECT vec_id, (i - 1) % 8 AS cell, (i - 1) // 8 AS class_id, embedding[i]::double AS logit
    FROM embeddings, range(1, 65) r(i)),
  m AS (SELECT vec_id, cell, max(logit) AS mx FROM l GROUP BY ALL)
  SELECT 'v' || vec_id AS source_hash, cell, min(class_id) FILTER (logit = mx) AS class_id,
    {S.r('1 / sum(exp(logit - mx))')} AS confidence FROM l JOIN m USING (vec_id, cell) GROUP BY vec_id, cell""")
def argmax_classes(spark, sf_dir):
    return raster.argmax_classes(B.logits(spark, sf_dir)).withColumn("confidence", G.round_to(F.col("confidence")))


# The whole analysis: one image per embedding, so each part is present, absent or odd on its own.


def analysed(spark, sf_dir):
    images = B.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("source_hash"),
        F.lit(1000.0).alias("image_width"), F.lit(1500.0).alias("image_height"),
    )
    pose = detect.decode_pose(B.pose_candidates(spark, sf_dir, "vec_id"))
    face = detect.decode_faces(B.face_candidates(spark, sf_dir, "vec_id"))
    persons = detect.gather(detect.nms(pose, vocab.THRESHOLDS["person_nms_iou"]), "persons")
    faces = detect.gather(detect.nms(face, vocab.THRESHOLDS["face_nms_iou"]), "faces")
    return analyze.analyse(stored(analyze.assemble(images, persons, faces, B.masks(spark, sf_dir), B.parses(spark, sf_dir))))


_K = {n: i + 1 for i, n in enumerate(vocab.KEYPOINT_NAMES)}


def _kp(name: str, part: str) -> str:
    return f"kps[{_K[name]}].{part}"


def _v(name: str) -> str:
    return f"coalesce({_kp(name, 'v')}, false)"


cte("a0", f"""
  SELECT e.vec_id, p.vec_id IS NOT NULL AS has_p, f.vec_id IS NOT NULL AS has_f, m.vec_id IS NOT NULL AS has_m,
    p.score AS ps, p.bl AS pl, p.bt AS pt, p.br AS pr, p.bb AS pb, p.kps, p.visible, p.kconf, f.score AS fs, f.bl AS fl,
    f.bt AS ft, f.br AS fr, f.bb AS fb, f.lx, f.ly, f.rx, f.ry, m.l AS ml, m.t AS mt, m.r AS mr, m.b AS mb, m.coverage,
    m.mean_p, m.cx AS mcx, m.cy AS mcy, m.tl, m.tr, m.bl AS mbl, m.br_ AS mbr, q.* EXCLUDE (vec_id)
  FROM embeddings e LEFT JOIN b_pose p USING (vec_id) LEFT JOIN b_face f USING (vec_id)
  LEFT JOIN (SELECT * FROM b_mask_stats WHERE kind = 'person_mask') m USING (vec_id)
  LEFT JOIN b_parse q USING (vec_id)""",
    ("b_pose", "b_face", "b_mask_stats", "b_parse"))
# A face only counts when it lies at least half inside the person.
cte("a1", """
  SELECT * REPLACE (has_f AND (NOT has_p OR greatest(0.0, least(fr, pr) - greatest(fl, pl)) * greatest(0.0, least(fb, pb)
    - greatest(ft, pt)) / ((fr - fl) * (fb - ft)) >= 0.5) AS has_f) FROM a0""", ("a0",))
_POINTS = []
for _side in ("left", "right"):
    for _joint in ("shoulder", "elbow", "wrist"):
        _POINTS.append((f"{_side}_{_joint}", _kp(f"{_side}_{_joint}", "x"), _kp(f"{_side}_{_joint}", "y")))
    _s, _e = f"{_side}_shoulder", f"{_side}_elbow"
    _POINTS.append((
        f"{_side}_mid", f"{_kp(_s, 'x')} + ({_kp(_e, 'x')} - {_kp(_s, 'x')}) * 0.35",
        f"{_kp(_s, 'y')} + ({_kp(_e, 'y')} - {_kp(_s, 'y')}) * 0.35",
    ))
cte("a_points", " UNION ALL ".join(
    f"SELECT vec_id, '{n}' AS point, floor(({x}) / 125.0 + 0.5) AS gx, floor(({y}) / 187.5 + 0.5) AS gy FROM a1 "
    "WHERE has_p" for n, x, y in _POINTS), ("a1",))
cte("a_frac", f"""
  SELECT p.vec_id, p.point, count(*) FILTER (c.cls IN {_in('upper_garment')}) / count(*)::double AS cloth,
    count(*) FILTER (c.cls IN {_in('arms')}) / count(*)::double AS skin
  FROM a_points p JOIN b_cells c ON c.vec_id = p.vec_id AND (c.x - p.gx) ** 2 + (c.y - p.gy) ** 2 <= 4 GROUP BY ALL""",
    ("a_points", "b_cells"))
cte("a_near", "SELECT vec_id, " + ", ".join(
    f"coalesce(max(cloth) FILTER (point = '{n}'), 0) > 0.35 AND coalesce(max(cloth) FILTER (point = '{n}'), 0) > "
    f"coalesce(max(skin) FILTER (point = '{n}'), 0) AS cov_{n}" for n, _, _ in _POINTS
) + ", greatest(coalesce(max(skin) FILTER (point = 'left_shoulder'), 0), coalesce(max(skin) FILTER (point = "
    "'right_shoulder'), 0)) AS shoulder_skin FROM a_frac GROUP BY 1", ("a_frac",))


def _rank(side: str) -> str:
    return (
        f"CASE WHEN NOT {_v(side + '_shoulder')} THEN NULL WHEN {_v(side + '_wrist')} AND coalesce(cov_{side}_wrist, false) THEN 3 "
        f"WHEN {_v(side + '_elbow')} AND coalesce(cov_{side}_elbow, false) THEN 2 WHEN {_v(side + '_elbow')} THEN "
        f"CASE WHEN coalesce(cov_{side}_mid, false) THEN 1 ELSE 0 END END"
    )


cte("a2", f"""
  SELECT *, coalesce(garment_pixels >= 4, false) AS found, g_left * 125.0::double AS gl, g_top * 187.5::double AS gt,
    g_right * 125.0::double AS gr, g_bottom * 187.5::double AS gb,
    coalesce(garment_first * 187.5::double, g_top * 187.5::double) AS g_topy,
    coalesce((garment_last + 1) * 187.5::double, g_bottom * 187.5::double) AS g_hemy,
    coalesce(garment_pixels >= 4 AND garment_last >= 6, false) AS hem_cropped,
    coalesce(g_conf, 0.0) AS gconf,
    dress_pixels + upper_clothes_pixels + skirt_pixels + pants_pixels + scarf_pixels AS gtotal,
    skirt_pixels + pants_pixels AS glower,
    coalesce((['sleeveless', 'short', 'three_quarter', 'long'])[greatest({_rank('left')}, {_rank('right')}) + 1], 'unknown')
      AS sleeve0,
    CASE WHEN NOT ({_v('left_shoulder')} AND {_v('right_shoulder')}) OR abs({_kp('left_shoulder', 'x')} -
        {_kp('right_shoulder', 'x')}) < 1 OR upper_garment_first IS NULL THEN NULL ELSE
      (upper_garment_first * 187.5::double - ({_kp('left_shoulder', 'y')} + {_kp('right_shoulder', 'y')}) / 2) /
        abs({_kp('left_shoulder', 'x')} - {_kp('right_shoulder', 'x')}) END AS drop_
  FROM a1 LEFT JOIN a_near USING (vec_id)""", ("a1", "a_near"))
cte("a3", """
  SELECT *, CASE WHEN NOT found THEN 'unknown'
      WHEN gtotal < 4 THEN CASE WHEN bag_pixels > 0 THEN 'accessory' ELSE 'unknown' END
      WHEN dress_pixels > upper_clothes_pixels AND dress_pixels > glower THEN 'full_outfit'
      WHEN upper_clothes_pixels > gtotal * 0.15 AND glower > gtotal * 0.15 THEN 'full_outfit'
      WHEN upper_clothes_pixels > gtotal * 0.15 THEN 'upper_body' WHEN glower > gtotal * 0.15 THEN 'lower_body'
      WHEN scarf_pixels > gtotal * 0.4 OR bag_pixels > 0 THEN 'accessory' ELSE 'unknown' END AS gtype,
    CASE WHEN found THEN sleeve0 ELSE 'unknown' END AS sleeve,
    CASE WHEN NOT found OR drop_ IS NULL THEN 'unknown' WHEN drop_ > -0.02 AND coalesce(shoulder_skin, 0) > 0.4
      THEN 'off_shoulder' WHEN drop_ < -0.15 THEN 'high' WHEN drop_ < 0.06 THEN 'crew' ELSE 'v_or_scoop' END AS neck_
  FROM a2""", ("a2",))


@query("garment_analysis", uses=("a3",), sql=f"""
  SELECT 'v' || vec_id AS source_hash, gtype AS garment_type, CASE WHEN found THEN {S.r('gl')} END AS box_left,
    CASE WHEN found THEN {S.r('gb')} END AS box_bottom, CASE WHEN found THEN {S.r('g_topy')} END AS top_y,
    CASE WHEN found THEN {S.r('g_hemy')} END AS hem_y, sleeve AS sleeve_length, neck_ AS neckline,
    CASE WHEN found THEN {S.r('least(1.0, garment_pixels / body_pixels::double)')} ELSE 0.0 END AS body_coverage,
    hem_cropped, {S.r('gconf')} AS confidence FROM a3""")
def garment_analysis(spark, sf_dir):
    a, r = analysed(spark, sf_dir), G.round_to
    return a.select(
        "source_hash", F.col("garment.type").alias("garment_type"), r(F.col("garment.box.left")).alias("box_left"),
        r(F.col("garment.box.bottom")).alias("box_bottom"), r(F.col("garment.top_y")).alias("top_y"),
        r(F.col("garment.hem_y")).alias("hem_y"), "garment.sleeve_length", "garment.neckline",
        r(F.col("garment.body_coverage")).alias("body_coverage"), "garment.hem_cropped",
        r(F.col("garment.confidence")).alias("confidence"),
    )


# Head estimate: 1 face, 2 facial keypoints, 3 person box.
cte("a4", f"""
  SELECT *, fb - ft AS fh, (fl + fr) / 2 AS fmid, pb - pt AS ph, (pl + pr) / 2 AS pmid,
    {_v('left_ear')} AND {_v('right_ear')} AS ears, {_v('left_eye')} AND {_v('right_eye')} AS eyes FROM a3""", ("a3",))
cte("a5", f"""
  SELECT *, CASE WHEN ears THEN sqrt(({_kp('left_ear', 'x')} - {_kp('right_ear', 'x')}) ** 2 + ({_kp('left_ear', 'y')} -
      {_kp('right_ear', 'y')}) ** 2) * 1.5 WHEN eyes THEN sqrt(({_kp('left_eye', 'x')} - {_kp('right_eye', 'x')}) ** 2 +
      ({_kp('left_eye', 'y')} - {_kp('right_eye', 'y')}) ** 2) * 2.4 END AS hsize,
    CASE WHEN ears THEN ({_kp('left_ear', 's')} + {_kp('right_ear', 's')}) / 2
      WHEN eyes THEN ({_kp('left_eye', 's')} + {_kp('right_eye', 's')}) / 2 END AS hsure FROM a4""", ("a4",))
cte("a6", f"""
  SELECT *, CASE WHEN has_f THEN 1 WHEN hsize > 0 AND (eyes OR {_v('nose')}) THEN 2 WHEN has_p AND ph > 0 THEN 3 END AS how,
    CASE WHEN eyes THEN ({_kp('left_eye', 'x')} + {_kp('right_eye', 'x')}) / 2 ELSE {_kp('nose', 'x')} END AS kx,
    CASE WHEN eyes THEN ({_kp('left_eye', 'y')} + {_kp('right_eye', 'y')}) / 2 ELSE {_kp('nose', 'y')} - hsize * 0.12 END AS ky
  FROM a5""", ("a5",))
cte("a7", """
  SELECT *, CASE how WHEN 1 THEN fmid WHEN 2 THEN kx WHEN 3 THEN pmid END AS hx,
    CASE how WHEN 1 THEN ft - fh * 0.43 WHEN 2 THEN ky - hsize * 0.5 WHEN 3 THEN pt END AS crown,
    CASE how WHEN 1 THEN fb WHEN 2 THEN ky - hsize * 0.5 + hsize WHEN 3 THEN pt + ph * 0.13 END AS chin_y,
    CASE how WHEN 1 THEN (lx + rx) / 2 WHEN 2 THEN kx WHEN 3 THEN pmid END AS ex,
    CASE how WHEN 1 THEN (ly + ry) / 2 WHEN 2 THEN ky WHEN 3 THEN pt + ph * 0.13 * 0.5 END AS ey,
    CASE how WHEN 1 THEN fh * 1.43 WHEN 2 THEN hsize WHEN 3 THEN ph * 0.13 END AS hh,
    CASE how WHEN 1 THEN fs WHEN 2 THEN hsure WHEN 3 THEN ps END AS hconf,
    CASE how WHEN 1 THEN 'face_landmarks' WHEN 2 THEN 'keypoints' WHEN 3 THEN 'person_box' END AS hsrc,
    CASE how WHEN 1 THEN 'face_box' WHEN 2 THEN 'keypoints' WHEN 3 THEN 'person_box' END AS hsrc_box,
    CASE how WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.5 END AS hw,
    CASE how WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.5 END AS hw_box, coalesce(ps, 0.8) AS sure FROM a6""", ("a6",))


def _pair(joint: str, axis: str, out: str, single: float, source: str) -> str:
    l, r = f"left_{joint}", f"right_{joint}"
    both, any_ = f"({_v(l)} AND {_v(r)})", f"({_v(l)} OR {_v(r)})"
    pick = lambda part: f"CASE WHEN {_v(l)} THEN {_kp(l, part)} ELSE {_kp(r, part)} END"
    axis_x = f"coalesce({axis}, {pick('x')})" if axis else pick("x")
    return f"""
    CASE WHEN {both} THEN ({_kp(l, 'x')} + {_kp(r, 'x')}) / 2 WHEN {any_} THEN {axis_x} END AS {out}x,
    CASE WHEN {both} THEN ({_kp(l, 'y')} + {_kp(r, 'y')}) / 2 WHEN {any_} THEN {pick('y')} END AS {out}y,
    CASE WHEN {both} THEN ({_kp(l, 's')} + {_kp(r, 's')}) / 2 * 0.85::double WHEN {any_} THEN ({pick('s')}) * {single}::double END AS {out}c,
    CASE WHEN {both} THEN 'keypoints' ELSE '{source}' END AS {out}s"""


cte("a8", "SELECT *, " + _pair("shoulder", "hx", "sh_", 0.45, "extrapolated") + ", "
    + _pair("ankle", "", "an_", 0.8 * 0.85, "keypoints") + ", " + _pair("knee", "", "kn_", 0.8 * 0.85, "keypoints")
    + " FROM a7", ("a7",))
cte("a9", "SELECT *, " + _pair("hip", "sh_x", "hi_", 0.45, "extrapolated") + " FROM a8", ("a8",))


def _rows(name: str, x: str, y: str, c: str, s: str, where: str = "true") -> str:
    return (
        f"SELECT vec_id, '{name}' AS anchor, ({x})::double AS x, ({y})::double AS y, least(1.0, greatest(0.0, ({c})::double)) AS c, "
        f"{s} AS source FROM a9 WHERE ({where}) AND ({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    )


_REACH = "greatest(hh, 30.0)"
_P_TOP, _M_TOP = "(head_first * 187.5::double)", "(mt * 187.5::double)"
_USE_P = f"coalesce(abs({_P_TOP} - crown) <= {_REACH}, false)"
_USE_M = f"coalesce(abs({_M_TOP} - crown) <= {_REACH}, false)"
_FEET_P = "feet_last IS NOT NULL"
_WX = "coalesce(widest * 125.0::double, (gl + gr) / 2)"
cte("a_anchors", " UNION ALL ".join([
    _rows("head_top", f"CASE WHEN {_USE_P} THEN hx WHEN {_USE_M} THEN (tl + tr) / 2.0::double * 125.0::double ELSE hx END",
          f"CASE WHEN {_USE_P} THEN {_P_TOP} WHEN {_USE_M} THEN {_M_TOP} ELSE crown END",
          f"hconf * CASE WHEN {_USE_P} OR {_USE_M} THEN 0.9 ELSE hw_box END",
          f"CASE WHEN {_USE_P} OR {_USE_M} THEN 'person_mask' ELSE hsrc_box END", "how IS NOT NULL"),
    _rows("eye_line", "ex", "ey", "hconf * hw", "hsrc"),
    _rows("chin", "hx", "chin_y", "hconf * hw_box", "hsrc_box"),
    _rows("neck", "hx + (sh_x - hx) * 0.55", "chin_y + (sh_y - chin_y) * 0.55", "least(hconf, sh_c) * 0.7", "'interpolated'"),
    *[_rows(f"shoulder_{s}", _kp(f"{s}_shoulder", "x"), _kp(f"{s}_shoulder", "y"), _kp(f"{s}_shoulder", "s") + " * 0.85",
            "'keypoints'", _v(f"{s}_shoulder")) for s in ("left", "right")],
    _rows("shoulder_center", "sh_x", "sh_y", "sh_c", "sh_s"),
    *[_rows(n, f"sh_x + (hi_x - sh_x) * {t}", f"sh_y + (hi_y - sh_y) * {t}", "least(sh_c, hi_c) * 0.7", "'interpolated'")
      for n, t in (("chest", 0.3), ("waist", 0.8))],
    _rows("hip_center", "hi_x", "hi_y", "hi_c", "hi_s"),
    _rows("knee_center", "kn_x", "kn_y", "kn_c", "kn_s"),
    _rows("ankle_center", "an_x", "an_y", "an_c", "an_s"),
    _rows("feet", "coalesce(an_x, 500.0)", "(feet_last + 1) * 187.5::double", "sure * 0.8", "'garment_mask'", _FEET_P),
    _rows("feet", "(mbl + mbr) / 2.0::double * 125.0::double", "mb * 187.5::double", "sure * 0.9", "'person_mask'",
          f"NOT ({_FEET_P}) AND has_m"),
    _rows("feet", "an_x", "an_y + hh * 0.35", "an_c * 0.45", "'extrapolated'", f"NOT ({_FEET_P}) AND NOT has_m"),
    _rows("subject_center", "mcx * 125.0::double", "mcy * 187.5::double", "sure * 0.9", "'person_mask'", "has_m"),
    _rows("subject_top", "(ml + mr) / 2.0::double * 125.0::double", "mt * 187.5::double", "sure * 0.9", "'person_mask'", "has_m"),
    _rows("subject_bottom", "(ml + mr) / 2.0::double * 125.0::double", "mb * 187.5::double", "sure * 0.9", "'person_mask'", "has_m"),
    _rows("subject_center", "pmid", "(pt + pb) / 2", "ps * 0.5", "'person_box'", "NOT has_m AND has_p"),
    _rows("subject_top", "pmid", "pt", "ps * 0.5", "'person_box'", "NOT has_m AND has_p"),
    _rows("subject_bottom", "pmid", "pb", "ps * 0.5", "'person_box'", "NOT has_m AND has_p"),
    _rows("garment_top", _WX, "g_topy", "gconf * 0.8", "'garment_mask'", "found"),
    _rows("garment_hem", _WX, "g_hemy", "gconf * 0.8", "'garment_mask'", "found"),
]), ("a9",))


@query("derive_anchors", uses=("a_anchors",), sql=f"""
  SELECT 'v' || vec_id AS source_hash, anchor, {S.r('x', 3)} AS x, {S.r('y', 3)} AS y, {S.r('c')} AS confidence, source
  FROM a_anchors""")
def derive_anchors(spark, sf_dir):
    long = analysed(spark, sf_dir).select("source_hash", F.explode("anchors").alias("anchor", "a"))
    return long.select(
        "source_hash", "anchor", G.round_to(F.col("a.x"), 3).alias("x"), G.round_to(F.col("a.y"), 3).alias("y"),
        G.round_to(F.col("a.confidence")).alias("confidence"), "a.source",
    )


@query("anchor_bounds", uses=("a_anchors",), sql=f"""
  SELECT 'v' || vec_id AS source_hash, {S.r('min(x)', 3)} AS "left", {S.r('min(y)', 3)} AS top, {S.r('max(x)', 3)} AS "right",
    {S.r('max(y)', 3)} AS bottom FROM a_anchors WHERE c >= 0.2 GROUP BY vec_id""")
def anchor_bounds(spark, sf_dir):
    b = analysed(spark, sf_dir).withColumn("b", analyze.anchor_bounds(F.col("anchors"))).filter("b IS NOT NULL")
    return b.select("source_hash", *[G.round_to(F.col(f"b.{s}"), 3).alias(s) for s in ("left", "top", "right", "bottom")])


_HAS = ("shoulder_center", "shoulder_left", "shoulder_right", "hip_center", "knee_center", "ankle_center", "feet")
_HEADK = " OR ".join([f"({_v(n)} AND {_kp(n, 's')} >= 0.7)" for n in analyze.HEAD_KEYPOINTS] + ["ears", "eyes"])
cte("a_has", "SELECT vec_id, " + ", ".join(
    f"coalesce(bool_or(anchor = '{n}' AND c >= 0.25 AND x >= 0 AND y >= 0 AND x <= 1000 AND y <= 1500), false) AS h_{n}" for n in _HAS
) + ", " + ", ".join(f"coalesce(max(c) FILTER (anchor = '{n}'), 0) AS c_{n}" for n in analyze.KEY_ANCHORS) + """,
    max(y) FILTER (anchor = 'head_top') AS head_y, max(y) FILTER (anchor = 'feet') AS feet_y,
    max(x) FILTER (anchor = 'subject_center') AS subject_x FROM a_anchors GROUP BY 1""", ("a_anchors",))
cte("a_signals", f"""
  SELECT *, has_f OR ({_HEADK}) AS head_visible,
    coalesce(h_shoulder_center OR h_shoulder_left OR h_shoulder_right, false) AS shoulders,
    coalesce(h_hip_center, false) AS hips, coalesce(h_knee_center, false) AS knees,
    coalesce(h_ankle_center OR (h_feet AND h_knee_center), false) AS ankles,
    CASE WHEN has_f THEN fh / 1500.0 ELSE 0.0 END AS face_ratio, coalesce(ph / 1500.0, 0.0) AS person_ratio,
    coalesce(coverage, 0.0) AS cover,
    CASE WHEN has_m THEN ml * 125.0::double WHEN has_p THEN pl WHEN found THEN gl END AS sl,
    CASE WHEN has_m THEN mt * 187.5::double WHEN has_p THEN pt WHEN found THEN gt END AS st,
    CASE WHEN has_m THEN mr * 125.0::double WHEN has_p THEN pr WHEN found THEN gr END AS sr,
    CASE WHEN has_m THEN mb * 187.5::double WHEN has_p THEN pb WHEN found THEN gb END AS sb
  FROM a9 LEFT JOIN a_has USING (vec_id)""", ("a9", "a_has"))
cte("a_shot", """
  SELECT *, CASE WHEN NOT has_p THEN CASE WHEN gtype = 'accessory' THEN 'product_only' WHEN cover > 0.45 THEN 'flat_lay'
        WHEN cover > 0.02 THEN 'product_only' ELSE 'detail' END
      WHEN has_f AND face_ratio > 0.42 THEN 'close_up' WHEN ankles AND head_visible THEN 'full_body'
      WHEN ankles THEN 'product_only' WHEN knees AND head_visible THEN 'three_quarter'
      WHEN hips AND head_visible THEN 'half_body'
      WHEN shoulders AND head_visible THEN CASE WHEN face_ratio > 0.25 THEN 'close_up' ELSE 'portrait' END
      WHEN head_visible THEN 'close_up' WHEN shoulders OR hips OR person_ratio > 0.5 THEN 'product_only'
      ELSE 'unknown' END AS shot_type,
    CASE WHEN NOT has_p THEN CASE WHEN gtype = 'accessory' OR cover > 0.45 THEN 0.7 WHEN cover > 0.02 THEN 0.6 ELSE 0.5 END
      WHEN has_f AND face_ratio > 0.42 THEN 0.9 WHEN ankles AND head_visible THEN 0.92 WHEN ankles THEN 0.75
      WHEN (knees OR hips) AND head_visible THEN 0.85
      WHEN shoulders AND head_visible THEN CASE WHEN face_ratio > 0.25 THEN 0.75 ELSE 0.85 END
      WHEN head_visible THEN 0.7 WHEN shoulders OR hips OR person_ratio > 0.5 THEN 0.8 ELSE 0.3 END::double AS shot_conf,
    CASE WHEN NOT has_p THEN CASE WHEN gtype = 'accessory' THEN 'isolated_product' WHEN cover > 0.45 THEN 'fills_frame'
        WHEN cover > 0.02 THEN 'covers_part' ELSE 'no_silhouette' END
      WHEN has_f AND face_ratio > 0.42 THEN 'large_face' WHEN ankles THEN CASE WHEN head_visible THEN 'head_to_ankles' ELSE 'legs_only' END
      WHEN head_visible THEN CASE WHEN knees THEN 'head_to_knees' WHEN hips THEN 'head_to_hips' WHEN NOT shoulders THEN 'head_only'
        WHEN face_ratio > 0.25 THEN 'near_head_and_shoulders' ELSE 'head_and_shoulders' END
      WHEN shoulders OR hips OR person_ratio > 0.5 THEN 'body_without_head' ELSE 'few_landmarks' END AS shot_reason
  FROM a_signals""", ("a_signals",))


@query("classify_shot", uses=("a_shot",), sql=f"""
  SELECT 'v' || vec_id AS source_hash, shot_type, shot_conf AS confidence, shot_reason AS reason,
    CASE WHEN shot_reason IN ('fills_frame', 'covers_part') THEN {S.r('cover')}
      WHEN shot_reason IN ('large_face', 'near_head_and_shoulders') THEN {S.r('face_ratio')} END AS share, head_visible, shoulders AS shoulders_visible,
    hips AS hips_visible, knees AS knees_visible, ankles AS ankles_visible, {S.r('face_ratio')} AS face_height_ratio,
    {S.r('person_ratio')} AS person_height_ratio, {S.r('cover')} AS person_coverage,
    {S.r('CASE WHEN sr > sl THEN (sb - st) / (sr - sl) ELSE 0.0 END')} AS subject_aspect,
    coalesce(st <= 10, false) AS touches_top, coalesce(sb >= 1490, false) AS touches_bottom,
    coalesce(sl <= 10, false) AS touches_left, coalesce(sr >= 990, false) AS touches_right FROM a_shot""")
def classify_shot(spark, sf_dir):
    a, r = analysed(spark, sf_dir), G.round_to
    flags = ("head_visible", "shoulders_visible", "hips_visible", "knees_visible", "ankles_visible", "touches_top",
             "touches_bottom", "touches_left", "touches_right")
    return a.select(
        "source_hash", F.col("shot.type").alias("shot_type"), "shot.confidence", "shot.reason", r(F.col("shot.share")).alias("share"), *[f"signals.{f}" for f in flags],
        *[r(F.col(f"signals.{c}")).alias(c) for c in ("face_height_ratio", "person_height_ratio", "person_coverage", "subject_aspect")],
    )


_LAND = "least(1.0, (" + " + ".join(f"coalesce(c_{n}, 0.0) * {w}" for n, w in analyze.KEY_ANCHORS.items()) + ") / 13.0)"
cte("a_quality", f"""
  SELECT *, CASE WHEN NOT has_p THEN CASE WHEN found THEN 0.6 ELSE 0.25 END
      ELSE least(1.0, ps * 0.7 + CASE WHEN has_f THEN fs * 0.3 ELSE 0.0 END) END::double AS q_det,
    coalesce({_LAND}, 0.0) AS q_land,
    CASE WHEN NOT has_m THEN 0.0 WHEN coverage < 0.01 THEN 0.2 WHEN coverage > 0.97 THEN 0.3
      ELSE least(1.0, mean_p * 0.6 + 0.4) END::double AS q_seg FROM a_shot""", ("a_shot",))


@query("assess_quality", uses=("a_quality",), sql=f"""
  SELECT 'v' || vec_id AS source_hash, {S.r('least(1.0, q_det * 0.3 + q_land * 0.45 + q_seg * 0.25)')} AS overall,
    {S.r('q_det')} AS detection, {S.r('q_land')} AS landmarks, {S.r('q_seg')} AS segmentation, concat_ws(',',
    CASE WHEN NOT has_p THEN 'no_person_detected:' || CASE WHEN shot_type IN ('flat_lay', 'product_only', 'detail')
      THEN 'info' ELSE 'warning' END END, CASE WHEN has_p AND NOT has_f THEN 'no_face_detected:info' END,
    CASE WHEN has_p AND visible / 17.0 < 0.35 AND kconf < 0.5 THEN 'low_keypoint_confidence:warning' END,
    CASE WHEN NOT has_m THEN 'mask_unavailable:warning' END,
    CASE WHEN coverage < 0.01 OR coverage > 0.97 THEN 'mask_implausible:warning' END,
    CASE WHEN head_y < 0 THEN 'head_cropped:warning' END,
    CASE WHEN coalesce(feet_y > 1500, false) OR hem_cropped THEN 'feet_cropped:info' END,
    CASE WHEN abs(subject_x - 500.0) / 500.0 > 0.3 THEN 'subject_off_center:info' END) AS warnings FROM a_quality""")
def assess_quality(spark, sf_dir):
    a, r = analysed(spark, sf_dir), G.round_to
    texts = F.transform("quality.warnings", lambda w: F.concat(w["code"], F.lit(":"), w["severity"]))
    return a.select(
        "source_hash", *[r(F.col(f"quality.{c}")).alias(c) for c in ("overall", "detection", "landmarks", "segmentation")],
        F.array_join(texts, ",").alias("warnings"),
    )


@query("threshold_calibration", uses=("b_pose", "b_face"), sql=f"""
  SELECT has_face, count(*) AS n, {S.r('min(best)')} AS min, """ + ", ".join(
    f"{S.r(f'quantile_cont(best, {q})')} AS p{int(q * 100)}" for q in (0.05, 0.5, 0.75, 0.9)) + """
  FROM (SELECT p.vec_id, f.vec_id IS NOT NULL AS has_face, list_max(list_transform(kps[1:5], lambda k: k.s)) AS best
    FROM b_pose p LEFT JOIN b_face f USING (vec_id)) GROUP BY 1""")
def threshold_calibration(spark, sf_dir):
    pose = detect.decode_pose(B.pose_candidates(spark, sf_dir, "vec_id"))
    face = detect.decode_faces(B.face_candidates(spark, sf_dir, "vec_id")).select("source_hash", F.lit(True).alias("f"))
    best = F.greatest(*[F.col("keypoints")[n]["score"] for n in analyze.HEAD_KEYPOINTS])
    scores = pose.join(face, "source_hash", "left").select(
        F.coalesce("f", F.lit(False)).alias("has_face"), best.alias("best_head_score")
    )
    out = reports.threshold_calibration(scores)
    return out.select("has_face", "n", *[G.round_to(F.col(c)).alias(c) for c in ("min", "p5", "p50", "p75", "p90")])


@query("timing_report", sql=f"""
  SELECT stage, count(*) AS n, {S.r('avg(ms)')} AS mean_ms, (list_sort(list(ms)))[ceil(0.5 * count(*))::int] AS p50_ms,
    (list_sort(list(ms)))[ceil(0.95 * count(*))::int] AS p95_ms, max(ms) AS max_ms FROM (
    SELECT unnest(['decode', 'pose']) AS stage, unnest([floor(value * 10)::bigint, event_id % 400]) AS ms FROM events) GROUP BY 1""")
def timing_report(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events").select(F.create_map(
        F.lit("decode"), F.floor(F.col("value") * 10), F.lit("pose"), F.col("event_id") % 400
    ).alias("timings"))
    return reports.timing_report(ev).withColumn("mean_ms", G.round_to(F.col("mean_ms")))
