"""Queries over framing: crops, violations, placements, ranges, layers, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from framejobs import vocab
from framejobs.functions import geometry as G
from framejobs.operators import framing
from framejobs.plans import settings, shared_sql as S
from framejobs.plans.registry import cte, query
from framejobs.sources import bridge as B

cte("b_templates", settings.templates_sql())
_MAP = "MAP {" + ", ".join(f"'{n}': a_{n}" for n in vocab.ANCHOR_NAMES) + "}"
cte("f0", f"SELECT s.*, t.*, {_MAP} AS anchors FROM b_subjects s, b_templates t", ("b_subjects", "b_templates"))
_NEED = (
    "list_concat(st.requires, list_filter([st.v_anchor, st.h_anchor, CASE WHEN st.mode = 'span' THEN st.s_from END, "
    "CASE WHEN st.mode = 'span' THEN st.s_to END], lambda q: q IS NOT NULL))"
)
cte("f1", f"""
  SELECT *, list_transform(strategies, lambda st: len(st.shots) = 0 OR list_contains(st.shots, shot_type)) AS shot_ok,
    list_transform(strategies, lambda st: len(list_filter({_NEED}, lambda n:
      NOT coalesce(anchors[n].c >= st.min_confidence, false)))) AS lacking
  FROM f0""", ("f0",))
cte("f2", """
  SELECT *, coalesce(list_min(list_filter(range(1, len(strategies) + 1), lambda i: shot_ok[i] AND lacking[i] = 0)),
    len(strategies)) AS idx, shot_ok[1] AND lacking[1] > 0 AS first_missing FROM f1""", ("f1",))
cte("f3", """
  SELECT *, anchors[st.h_anchor].x AS pin_x, anchors[st.v_anchor].y AS pin_y,
    coalesce(st.overflow, t_overflow) AS policy,
    abs(anchors[st.s_to].y - anchors[st.s_from].y) AS span,
    greatest(8.0, CASE WHEN has_box THEN bb - bt ELSE ih END) AS subject_h,
    coalesce(a_subject_center.x, CASE WHEN has_box THEN (bl + br) / 2 END, iw / 2) AS cx0,
    coalesce(a_subject_center.y, CASE WHEN has_box THEN (bt + bb) / 2 END, ih / 2) AS cy0,
    list_filter(list_transform(keep_inside, lambda n: anchors[n].y), lambda v: v IS NOT NULL) AS kys,
    list_filter(list_transform(keep_inside, lambda n: anchors[n].x), lambda v: v IS NOT NULL) AS kxs
  FROM (SELECT *, strategies[idx] AS st FROM f2)""", ("f2",))
cte("f4", """
  SELECT *, st.mode = 'span' AND NOT coalesce(span > 0, false) AS span_lost,
    greatest(8.0, CASE WHEN st.mode = 'span' AND coalesce(span > 0, false)
        THEN span / least(1.0, greatest(0.01, st.span / 100.0))
      WHEN st.mode = 'fixed' THEN ch * greatest(0.01, st.ratio)
      WHEN st.mode = 'subject' THEN subject_h / least(1.0, greatest(0.01, st.height / 100.0))
      ELSE subject_h / 0.85::double END) AS h0 FROM f3""", ("f3",))
cte("f5", """
  SELECT *, h0 < ch / max_up AS too_close, h0 >= ch / max_up AND h0 > ch / greatest(1e-6, min_up) AS too_far,
    CASE WHEN h0 < ch / max_up THEN ch / max_up WHEN h0 > ch / greatest(1e-6, min_up)
      THEN ch / greatest(1e-6, min_up) ELSE h0 END AS h1 FROM f4""", ("f4",))
_PX = "coalesce(pin_x - least(1.0, greatest(0.0, st.h_pct / 100.0)) * ({w}), cx0 - ({w}) / 2)"
_PY = "coalesce(pin_y - least(1.0, greatest(0.0, st.v_pct / 100.0)) * ({h}), cy0 - ({h}) / 2)"
cte("f6", f"""
  SELECT *, {_PX.format(w='w1')} AS x1, {_PY.format(h='h1')} AS y1,
    pad_pct / 100.0 * h1 AS pady, pad_pct / 100.0 * w1 AS padx,
    list_min(kys) AS ylo, list_max(kys) AS yhi, list_min(kxs) AS xlo, list_max(kxs) AS xhi
  FROM (SELECT *, h1 * (cw / ch) AS w1 FROM f5)""", ("f5",))


def _pass(i: int) -> str:
    x, y, w, h, g = f"x{i}", f"y{i}", f"w{i}", f"h{i}", f"g{i}"
    n = i + 1
    return f"""
  SELECT *, CASE WHEN {g} IS NOT NULL THEN (xlo + xhi) / 2 - w{n} / 2
      WHEN xlo - padx < {x} THEN {x} + (xlo - padx - {x})
      WHEN xhi + padx > {x} + {w} THEN {x} + (xhi + padx - ({x} + {w})) ELSE {x} END AS x{n},
    CASE WHEN {g} IS NOT NULL THEN (ylo + yhi) / 2 - h{n} / 2
      WHEN ylo - pady < {y} THEN {y} + (ylo - pady - {y})
      WHEN yhi + pady > {y} + {h} THEN {y} + (yhi + pady - ({y} + {h})) ELSE {y} END AS y{n}
  FROM (SELECT *, coalesce({w} * {g}, {w}) AS w{n}, coalesce({h} * {g}, {h}) AS h{n} FROM (
    SELECT *, CASE WHEN yhi - ylo + pady * 2 > {h} OR xhi - xlo + padx * 2 > {w} THEN
      greatest((yhi - ylo + pady * 2) / {h}, (xhi - xlo + padx * 2) / {w}) END AS {g} FROM f{5 + i}))"""


cte("f7", _pass(1), ("f6",))
cte("f8", _pass(2), ("f7",))
_OVER = "greatest(-({x}), -({y}), ({x}) + ({w}) - iw, ({y}) + ({h}) - ih) > 0.5"
cte("f9", f"""
  SELECT *, sw * 1.0 AS sw1, {_PX.format(w='sw')} AS sx1, {_PY.format(h='sh')} AS sy1 FROM (
    SELECT *, w3 * k1 AS sw, h3 * k1 AS sh FROM (
      SELECT *, {_OVER.format(x='x3', y='y3', w='w3', h='h3')} AS over,
        least(1.0, iw / w3, ih / h3) AS k1 FROM f8))""", ("f8",))
cte("f10", f"""
  SELECT *, CASE WHEN k2 IS NULL THEN sx1 ELSE {_PX.format(w='sw * k2')} END AS sx,
    CASE WHEN k2 IS NULL THEN sy1 ELSE {_PY.format(h='sh * k2')} END AS sy,
    sw * coalesce(k2, 1.0) AS swf, sh * coalesce(k2, 1.0) AS shf, k1 * coalesce(k2, 1.0) AS total
  FROM (SELECT *, CASE WHEN {_OVER.format(x='sx1', y='sy1', w='sw', h='sh')}
      AND least(1.0, iw / sw, ih / sh) < 0.999 THEN least(1.0, iw / sw, ih / sh) END AS k2 FROM f9)""", ("f9",))
cte("f11", """
  SELECT *, CASE WHEN over AND policy = 'shrink' THEN least(greatest(sx, 0.0), greatest(0.0, iw - swf))
      WHEN over AND policy = 'clamp' AND w3 < iw THEN least(greatest(x3, 0.0), iw - w3) ELSE x3 END AS fx,
    CASE WHEN over AND policy = 'shrink' THEN least(greatest(sy, 0.0), greatest(0.0, ih - shf))
      WHEN over AND policy = 'clamp' AND h3 < ih THEN least(greatest(y3, 0.0), ih - h3) ELSE y3 END AS fy,
    CASE WHEN over AND policy = 'shrink' THEN swf ELSE w3 END AS fw,
    CASE WHEN over AND policy = 'shrink' THEN shf ELSE h3 END AS fh FROM f10""", ("f10",))
cte("framed", """
  SELECT *, greatest(0.0, -fx) AS o_left, greatest(0.0, -fy) AS o_top, greatest(0.0, fx + fw - iw) AS o_right,
    greatest(0.0, fy + fh - ih) AS o_bottom,
    CASE WHEN over AND policy = 'shrink' THEN abs(fx - sx) ELSE abs(fx - x3) END AS mx,
    CASE WHEN over AND policy = 'shrink' THEN abs(fy - sy) ELSE abs(fy - y3) END AS my,
    list_distinct(list_concat(st.requires, list_filter([st.v_anchor, st.h_anchor,
      CASE WHEN st.mode = 'span' THEN st.s_from END, CASE WHEN st.mode = 'span' THEN st.s_to END],
      lambda q: q IS NOT NULL))) AS referenced
  FROM f11""", ("f11",))


def framed_all(spark, sf_dir):
    return framing.frame_catalog(B.framing_subjects(spark, sf_dir), settings.TEMPLATES)


@query("frame_catalog", uses=("framed",), sql=f"""
  SELECT source_hash, template_id, st.id AS strategy_id, idx > 1 AS used_fallback, policy AS overflow_policy,
    {S.r('fx')} AS crop_x, {S.r('fy')} AS crop_y, {S.r('fw')} AS crop_width, {S.r('fh')} AS crop_height,
    {S.r('ch / greatest(8.0, fh)')} AS upscale, {S.r('o_left')} AS over_left, {S.r('o_top')} AS over_top,
    {S.r('o_right')} AS over_right, {S.r('o_bottom')} AS over_bottom FROM framed""")
def frame_catalog(spark, sf_dir):
    f = framed_all(spark, sf_dir)
    r = G.round_to
    return f.select(
        "source_hash", "template_id", "strategy_id", "used_fallback", "overflow_policy",
        r(F.col("crop.x")).alias("crop_x"), r(F.col("crop.y")).alias("crop_y"),
        r(F.col("crop.width")).alias("crop_width"), r(F.col("crop.height")).alias("crop_height"),
        r(F.col("upscale")).alias("upscale"),
        *[r(F.col(f"overflow.{s}")).alias(f"over_{s}") for s in ("left", "top", "right", "bottom")],
    )


_VIOLATION_CASES = (
    ("first_missing", "anchor_missing", "info", None),
    ("idx > 1", "fallback_used", "info", None),
    ("span_lost", "anchor_missing", "warning", None),
    ("too_close", "max_upscale_clamped", "warning", "ch / h0 / max_up"),
    ("too_far", "min_upscale_clamped", "info", None),
    ("g1 IS NOT NULL OR g2 IS NOT NULL", "keep_inside_violated", "warning", "coalesce(g1, 1.0) * coalesce(g2, 1.0)"),
    ("over AND policy = 'allow'", "crop_overflows_source", "info", None),
    ("over AND policy = 'clamp' AND (w3 >= iw OR h3 >= ih)", "crop_overflows_source", "warning", None),
    ("over AND policy = 'shrink' AND total < 0.999", "crop_shrunk_to_fit", "warning", "total"),
    ("over AND policy = 'shrink' AND greatest(mx, my) > 0.5", "crop_clamped_to_source", "warning", None),
    ("over AND policy = 'clamp' AND greatest(mx, my) > 0.5", "crop_clamped_to_source", "warning",
     "greatest(my / fh * ch, mx / fw * cw)"),
)
_VIOLATIONS = " UNION ALL ".join(
    f"SELECT source_hash, template_id, '{code}' AS code, '{severity}' AS severity, "
    f"{S.r(amount) if amount else 'NULL::double'} AS magnitude FROM framed WHERE {condition}"
    for condition, code, severity, amount in _VIOLATION_CASES
)


@query("framing_violations", uses=("framed",), sql=_VIOLATIONS)
def framing_violations(spark, sf_dir):
    v = framed_all(spark, sf_dir).select("source_hash", "template_id", F.explode("violations").alias("v"))
    return v.select(
        "source_hash", "template_id", "v.code", "v.severity", G.round_to(F.col("v.magnitude")).alias("magnitude")
    )


@query("strategy_report", uses=("framed",), sql="""
  SELECT template_id, st.id AS strategy_id, count(*) AS images, count(*) FILTER (idx > 1) AS fallbacks
  FROM framed GROUP BY ALL""")
def strategy_report(spark, sf_dir):
    return framed_all(spark, sf_dir).groupBy("template_id", "strategy_id").agg(
        F.count(F.lit(1)).alias("images"), F.count_if("used_fallback").alias("fallbacks")
    )


@query("framing_placements", uses=("framed",), sql=f"""
  SELECT source_hash, template_id, n AS anchor, {S.r('px')} AS canvas_x, {S.r('py')} AS canvas_y,
    CASE WHEN on_h OR on_v THEN {S.r("CASE WHEN on_h THEN st.h_pct / 100.0 * cw ELSE px END - px", 3)} END AS error_x,
    CASE WHEN on_h OR on_v THEN {S.r("CASE WHEN on_v THEN st.v_pct / 100.0 * ch ELSE py END - py", 3)} END AS error_y
  FROM (SELECT *, (anchors[n].x - fx) * (cw / greatest(8.0, fw)) AS px,
      (anchors[n].y - fy) * (ch / greatest(8.0, fh)) AS py,
      coalesce(st.h_anchor = n, false) AS on_h, coalesce(st.v_anchor = n, false) AS on_v
    FROM (SELECT *, unnest(referenced) AS n FROM framed)) WHERE anchors[n] IS NOT NULL""")
def framing_placements(spark, sf_dir):
    p = framed_all(spark, sf_dir).select("source_hash", "template_id", F.explode("placements").alias("p"))
    return p.select(
        "source_hash", "template_id", "p.anchor",
        G.round_to(F.col("p.canvas_x")).alias("canvas_x"), G.round_to(F.col("p.canvas_y")).alias("canvas_y"),
        G.round_to(F.col("p.error_x"), 3).alias("error_x"), G.round_to(F.col("p.error_y"), 3).alias("error_y"),
    )


@query("vertical_range", uses=("framed",), sql=f"""
  SELECT source_hash, template_id,
    CASE WHEN ok THEN {S.r('least(100.0, greatest(0.0, (pin_y - (ih - fh)) / fh * 100.0))')} END AS min_pct,
    CASE WHEN ok THEN {S.r('least(100.0, greatest(0.0, pin_y / fh * 100.0))')} END AS max_pct
  FROM (SELECT *, policy = 'clamp' AND fh < ih AND fh > 0 AND pin_y IS NOT NULL AS ok FROM framed)""")
def vertical_range(spark, sf_dir):
    v = framing.vertical_range(framed_all(spark, sf_dir))
    return v.select(
        "source_hash", "template_id", G.round_to(F.col("min_pct")).alias("min_pct"),
        G.round_to(F.col("max_pct")).alias("max_pct"),
    )


@query("placed_rectangles", uses=("framed",), sql=f"""
  SELECT source_hash, template_id, {S.r('(sx0 - fx) * kx')} AS x, {S.r('(sy0 - fy) * ky')} AS y,
    {S.r('sw0 * kx')} AS width, {S.r('sh0 * ky')} AS height, {S.r('sx0')} AS source_x, {S.r('sw0')} AS source_width
  FROM (SELECT *, greatest(0.0, fx) AS sx0, greatest(0.0, fy) AS sy0,
      least(iw, fx + fw) - greatest(0.0, fx) AS sw0, least(ih, fy + fh) - greatest(0.0, fy) AS sh0,
      cw * 2 / fw AS kx, ch * 2 / fh AS ky FROM framed) WHERE sw0 > 0 AND sh0 > 0""")
def placed_rectangles(spark, sf_dir):
    f = framed_all(spark, sf_dir).withColumn("p", framing.placed_rect(vocab.SUPERSAMPLE)).filter("p IS NOT NULL")
    return f.select(
        "source_hash", "template_id",
        *[G.round_to(F.col(f"p.{c}")).alias(c) for c in ("x", "y", "width", "height", "source_x", "source_width")],
    )


@query("canvas_round_trip", uses=("framed",), sql=f"""
  SELECT source_hash, template_id, {S.r('(a_chin.x - fx) / fw * cw')} AS canvas_x,
    {S.r('(a_chin.y - fy) / fh * ch')} AS canvas_y, {S.r('a_chin.x', 3)} AS source_x, {S.r('a_chin.y', 3)} AS source_y
  FROM framed WHERE a_chin IS NOT NULL""")
def canvas_round_trip(spark, sf_dir):
    chin, crop = F.col("anchors")["chin"], F.col("crop")
    w, h = F.col("t.canvas_width"), F.col("t.canvas_height")
    f = framed_all(spark, sf_dir).filter(chin.isNotNull()).withColumns({
        "cx": G.to_canvas(chin["x"], crop["x"], crop["width"], w),
        "cy": G.to_canvas(chin["y"], crop["y"], crop["height"], h),
    })
    return f.select(
        "source_hash", "template_id", G.round_to(F.col("cx")).alias("canvas_x"), G.round_to(F.col("cy")).alias("canvas_y"),
        G.round_to(G.to_source(F.col("cx"), crop["x"], crop["width"], w), 3).alias("source_x"),
        G.round_to(G.to_source(F.col("cy"), crop["y"], crop["height"], h), 3).alias("source_y"),
    )
