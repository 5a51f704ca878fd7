"""Framing: the crop rectangle of every image under every template.

A template states a result (an anchor at a height, a span of a size); the crop follows from three
equations and is then adjusted by the template's constraints. Everything is column arithmetic on one
row per (image, template): no shuffle beyond the join that pairs them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from framejobs.functions import geometry as G
from framejobs.operators.ranking import bounded
from framejobs.operators.staging import sealed
from framejobs.sources import templates as T

MIN_CROP = 8.0
EDGE = 0.5
# Templates handled as one constant; a longer list is worked off in slices of this size.
TEMPLATES_PER_PASS = 500

_IMPLICIT_FIT = {
    "id": "implicit_fit", "label": "Fit subject", "requires": [], "min_confidence": 0.0, "shot_types": [],
    "vertical": None, "horizontal": {"anchor": "subject_center", "target_pct": 50.0},
    "scale": {"mode": "subject", "height_pct": 90.0}, "overflow": None,
}


def framing_subjects(analysed: DataFrame) -> DataFrame:
    """The solver's view of an analysis; no analysis means no anchors and an unknown shot."""
    return analysed.select(
        "source_hash", "image_width", "image_height",
        F.coalesce("anchors", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(
            "array<struct<x:double,y:double,confidence:double>>"))).alias("anchors"),
        F.coalesce("shot_type", F.lit("unknown")).alias("shot_type"),
        "subject_box",
    )


def pair_all(subjects: DataFrame, templates: DataFrame | list[dict]) -> DataFrame:
    """Every subject under every template: the template list is a constant of the plan."""
    rows = templates if isinstance(templates, list) else [
        row.asDict(recursive=True) for row in templates.orderBy("template_id").collect()
    ]
    passes = [
        subjects.select("*", F.explode(T.template_literal(rows[i:i + TEMPLATES_PER_PASS])).alias("t"))
        for i in range(0, len(rows), TEMPLATES_PER_PASS)
    ]
    out = passes[0] if passes else subjects.select("*", F.explode(T.template_literal([])).alias("t"))
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def pair_planned(subjects: DataFrame, templates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Only the planned (source_hash, template_id) pairs."""
    packed = templates.select("template_id", F.struct(*templates.columns).alias("t"))
    extra = [c for c in pairs.columns if c in ("source_hash", "template_id") or c not in subjects.columns]
    return (
        pairs.select(*extra).join(subjects, "source_hash").join(bounded(packed), "template_id").drop("template_id")
    )


def _anchor(name: Column) -> Column:
    return F.element_at("anchors", name)


def implicit_anchors(strategy: Column) -> Column:
    """Anchors a strategy places or measures, in order, without repeats."""
    span = strategy["scale"]["mode"] == "span"
    names = F.array(
        strategy["vertical"]["anchor"], strategy["horizontal"]["anchor"],
        F.when(span, strategy["scale"]["from"]), F.when(span, strategy["scale"]["to"]),
    )
    return F.array_distinct(F.array_compact(names))


def _missing(strategy: Column) -> Column:
    needed = F.array_union(strategy["requires"], implicit_anchors(strategy))
    return F.filter(needed, lambda name: ~G.has_anchor(F.col("anchors"), name, strategy["min_confidence"]))


def _shot_fits(strategy: Column) -> Column:
    return (F.size(strategy["shot_types"]) == 0) | F.array_contains(strategy["shot_types"], F.col("shot_type"))


def select_strategy(paired: DataFrame) -> DataFrame:
    """First strategy whose shot types and anchors fit, else the last one."""
    strategies = F.col("t.strategies")
    usable = F.transform(
        strategies, lambda s, i: F.when(_shot_fits(s) & (F.size(_missing(s)) == 0), i)
    )
    first = F.get(strategies, F.lit(0))
    implicit = F.get(F.from_json(F.lit(json.dumps([_IMPLICIT_FIT])), f"array<{T.STRATEGY}>"), F.lit(0))
    return (
        paired.withColumn("_index", F.coalesce(F.array_min(F.array_compact(usable)), F.size(strategies) - 1, F.lit(0)))
        .withColumn("_index", F.greatest("_index", F.lit(0)))
        .withColumn("_first_missing", F.coalesce(_shot_fits(first) & (F.size(_missing(first)) > 0), F.lit(False)))
        .withColumn("_s", F.when(F.size(strategies) == 0, implicit).otherwise(F.get(strategies, F.col("_index"))))
    )


def _pct(value: Column, low: float) -> Column:
    return G.clamp(value / 100.0, F.lit(low), F.lit(1.0))


def _place(axis: str, target: str, size: Column) -> Column:
    """Crop start on one axis: the pinned anchor, else the subject centre, else the image centre."""
    placed = F.col(f"_s.{target}")
    low, high, extent = ("left", "right", "image_width") if axis == "x" else ("top", "bottom", "image_height")
    pinned = F.col(f"_pin_{axis}")
    centre = F.coalesce(
        F.col(f"_mid_{axis}"),
        (F.col(f"subject_box.{low}") + F.col(f"subject_box.{high}")) / 2,
        F.col(extent) / 2,
    )
    return F.when(
        pinned.isNotNull(), pinned - G.clamp(placed["target_pct"] / 100.0, F.lit(0.0), F.lit(1.0)) * size
    ).otherwise(centre - size / 2)


def _overflow(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "left": F.greatest(zero, -x), "top": F.greatest(zero, -y),
        "right": F.greatest(zero, x + w - F.col("image_width")),
        "bottom": F.greatest(zero, y + h - F.col("image_height")),
    }


def _any_over(over: dict[str, Column]) -> Column:
    return F.greatest(*over.values()) > EDGE


def solve(paired: DataFrame) -> DataFrame:
    """Solve every paired row; adds crop, overflow, strategy, violations and placements."""
    df = select_strategy(paired)
    canvas_w, canvas_h = F.col("t.canvas_width"), F.col("t.canvas_height")
    df = df.withColumns({
        "_pin_x": _anchor(F.col("_s.horizontal.anchor"))["x"],
        "_pin_y": _anchor(F.col("_s.vertical.anchor"))["y"],
        "_mid_x": _anchor(F.lit("subject_center"))["x"],
        "_mid_y": _anchor(F.lit("subject_center"))["y"],
        "_policy": F.coalesce("_s.overflow", "t.overflow"),
        "_span": F.abs(_anchor(F.col("_s.scale.to"))["y"] - _anchor(F.col("_s.scale.from"))["y"]),
        "_subject_h": F.greatest(
            F.lit(MIN_CROP),
            F.when(F.col("subject_box").isNotNull(), F.col("subject_box.bottom") - F.col("subject_box.top"))
            .otherwise(F.col("image_height")),
        ),
        "_points": F.filter(
            F.transform("t.keep_inside", lambda name: _anchor(name)), lambda a: a.isNotNull()
        ),
    })

    # Scale: the span, the subject box or a fixed ratio; an unmeasurable span falls back to the subject.
    mode = F.col("_s.scale.mode")
    span_ok = (mode == "span") & F.coalesce(F.col("_span") > 0, F.lit(False))
    df = df.withColumn("_span_lost", (mode == "span") & ~span_ok).withColumn(
        "_h0",
        F.greatest(
            F.lit(MIN_CROP),
            F.when(span_ok, F.col("_span") / _pct(F.col("_s.scale.span_pct"), 0.01))
            .when(mode == "fixed", canvas_h * F.greatest(F.lit(0.01), F.col("_s.scale.source_per_canvas_pixel")))
            .when(mode == "subject", F.col("_subject_h") / _pct(F.col("_s.scale.height_pct"), 0.01))
            .otherwise(F.col("_subject_h") / F.lit(0.85)),
        ),
    )

    # Magnification limits bound the crop height from both sides.
    low = canvas_h / F.col("t.max_upscale")
    high = canvas_h / F.greatest(F.lit(1e-6), F.col("t.min_upscale"))
    df = df.withColumns({
        "_too_close": F.col("_h0") < low,
        "_too_far": (F.col("_h0") >= low) & (F.col("_h0") > high),
    })
    df = df.withColumn("_h", F.when(F.col("_too_close"), low).when(F.col("_too_far"), high).otherwise(F.col("_h0")))
    df = df.withColumn("_w", F.col("_h") * (canvas_w / canvas_h))
    df = df.withColumns({"_x": _place("x", "horizontal", F.col("_w")), "_y": _place("y", "vertical", F.col("_h"))})

    df = _keep_inside(df)
    df = _apply_overflow(df)
    return _report(df)


def _keep_inside(df: DataFrame) -> DataFrame:
    """Shift the crop, or grow it about the anchor group, so that named anchors stay in frame."""
    pad = F.col("t.keep_inside_padding_pct") / 100.0
    ys, xs = F.transform("_points", lambda a: a["y"]), F.transform("_points", lambda a: a["x"])
    df = df.withColumns({
        "_pad_y": pad * F.col("_h"), "_pad_x": pad * F.col("_w"),
        "_y_lo": F.array_min(ys), "_y_hi": F.array_max(ys), "_x_lo": F.array_min(xs), "_x_hi": F.array_max(xs),
    })
    df = df.withColumns({
        "_need_h": F.col("_y_hi") - F.col("_y_lo") + F.col("_pad_y") * 2,
        "_need_w": F.col("_x_hi") - F.col("_x_lo") + F.col("_pad_x") * 2,
    })
    # The second pass re-tests the result of the first; a pass that changes nothing is idempotent.
    for i in (1, 2):
        df = df.withColumn(
            f"_grow{i}",
            F.when(
                (F.col("_need_h") > F.col("_h")) | (F.col("_need_w") > F.col("_w")),
                F.greatest(F.col("_need_h") / F.col("_h"), F.col("_need_w") / F.col("_w")),
            ),
        )
        grow = F.col(f"_grow{i}")
        df = df.withColumns({"_w1": F.col("_w") * grow, "_h1": F.col("_h") * grow})
        df = df.withColumns({
            "_x": F.when(grow.isNotNull(), (F.col("_x_lo") + F.col("_x_hi")) / 2 - F.col("_w1") / 2)
            .otherwise(F.col("_x") + _shift("x", "_w")),
            "_y": F.when(grow.isNotNull(), (F.col("_y_lo") + F.col("_y_hi")) / 2 - F.col("_h1") / 2)
            .otherwise(F.col("_y") + _shift("y", "_h")),
            "_w": F.coalesce("_w1", "_w"),
            "_h": F.coalesce("_h1", "_h"),
        })
    return df


def _shift(axis: str, size: str) -> Column:
    start, pad = F.col(f"_{axis}"), F.col(f"_pad_{axis}")
    lo, hi = F.col(f"_{axis}_lo") - pad, F.col(f"_{axis}_hi") + pad
    end = start + F.col(size)
    return F.when(lo < start, lo - start).when(hi > end, hi - end).otherwise(F.lit(0.0))


def _apply_overflow(df: DataFrame) -> DataFrame:
    """Let the crop leave the photo, shrink it, or slide it back, by the policy in force."""
    iw, ih = F.col("image_width"), F.col("image_height")
    x, y, w, h = (F.col(c) for c in ("_x", "_y", "_w", "_h"))
    df = df.withColumn("_over", _any_over(_overflow(x, y, w, h)))
    df = df.withColumns({
        "_shrink": F.col("_over") & (F.col("_policy") == "shrink"),
        "_clamp": F.col("_over") & (F.col("_policy") == "clamp"),
    })

    # Shrink: fit the size, place again at the new size, and repeat once if that still overhangs.
    df = df.withColumn("_f1", F.when(F.col("_shrink"), F.least(F.lit(1.0), iw / w, ih / h)))
    df = df.withColumns({"_sw": w * F.col("_f1"), "_sh": h * F.col("_f1")})
    df = df.withColumns({
        "_sx": _place("x", "horizontal", F.col("_sw")), "_sy": _place("y", "vertical", F.col("_sh")),
    })
    still = _any_over(_overflow(F.col("_sx"), F.col("_sy"), F.col("_sw"), F.col("_sh")))
    fit = F.least(F.lit(1.0), iw / F.col("_sw"), ih / F.col("_sh"))
    df = df.withColumn("_f2", F.when(still & (fit < 0.999), fit))
    df = df.withColumns({"_sw2": F.col("_sw") * F.col("_f2"), "_sh2": F.col("_sh") * F.col("_f2")})
    df = df.withColumns({
        "_sx": F.when(F.col("_f2").isNotNull(), _place("x", "horizontal", F.col("_sw2"))).otherwise(F.col("_sx")),
        "_sy": F.when(F.col("_f2").isNotNull(), _place("y", "vertical", F.col("_sh2"))).otherwise(F.col("_sy")),
        "_sw": F.coalesce("_sw2", "_sw"), "_sh": F.coalesce("_sh2", "_sh"),
        "_total": F.col("_f1") * F.coalesce("_f2", F.lit(1.0)),
    })

    zero = F.lit(0.0)
    w_fits, h_fits = w < iw, h < ih
    df = df.withColumns({
        "_fx": F.when(F.col("_shrink"), G.clamp(F.col("_sx"), zero, F.greatest(zero, iw - F.col("_sw"))))
        .when(F.col("_clamp") & w_fits, G.clamp(x, zero, iw - w)).otherwise(x),
        "_fy": F.when(F.col("_shrink"), G.clamp(F.col("_sy"), zero, F.greatest(zero, ih - F.col("_sh"))))
        .when(F.col("_clamp") & h_fits, G.clamp(y, zero, ih - h)).otherwise(y),
        "_fw": F.when(F.col("_shrink"), F.col("_sw")).otherwise(w),
        "_fh": F.when(F.col("_shrink"), F.col("_sh")).otherwise(h),
        "_spill": F.col("_over") & (
            (F.col("_policy") == "allow") | (F.col("_clamp") & (~w_fits | ~h_fits))
        ),
    })
    return df.withColumns({
        "_move_x": F.abs(F.col("_fx") - F.when(F.col("_shrink"), F.col("_sx")).otherwise(x)),
        "_move_y": F.abs(F.col("_fy") - F.when(F.col("_shrink"), F.col("_sy")).otherwise(y)),
    })


def _violation(when: Column, code: str, severity, magnitude: Column | None = None) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    amount = F.lit(None).cast("double") if magnitude is None else magnitude
    return F.when(
        when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), amount.alias("magnitude"))
    )


def _report(df: DataFrame) -> DataFrame:
    canvas_w, canvas_h = F.col("t.canvas_width"), F.col("t.canvas_height")
    moved = F.greatest("_move_x", "_move_y") > EDGE
    slid = F.greatest(F.col("_move_y") / F.col("_fh") * canvas_h, F.col("_move_x") / F.col("_fw") * canvas_w)
    shrunk = F.coalesce(F.col("_total") < 0.999, F.lit(False))
    violations = F.array_compact(F.array(
        _violation(F.col("_first_missing"), "anchor_missing", "info"),
        _violation(F.col("_index") > 0, "fallback_used", "info"),
        _violation(F.col("_span_lost"), "anchor_missing", "warning"),
        _violation(F.col("_too_close"), "max_upscale_clamped", "warning", canvas_h / F.col("_h0") / F.col("t.max_upscale")),
        _violation(F.col("_too_far"), "min_upscale_clamped", "info"),
        # Both passes of growth make one entry.
        _violation(
            F.coalesce("_grow1", "_grow2").isNotNull(), "keep_inside_violated", "warning",
            F.coalesce("_grow1", F.lit(1.0)) * F.coalesce("_grow2", F.lit(1.0)),
        ),
        _violation(
            F.col("_spill"), "crop_overflows_source",
            F.when(F.col("_clamp"), "warning").otherwise("info"),
        ),
        _violation(shrunk, "crop_shrunk_to_fit", "warning", F.col("_total")),
        _violation(F.col("_shrink") & moved, "crop_clamped_to_source", "warning"),
        _violation(F.col("_clamp") & moved, "crop_clamped_to_source", "warning", slid),
    ))
    over = _overflow(F.col("_fx"), F.col("_fy"), F.col("_fw"), F.col("_fh"))
    crop = F.struct(
        F.col("_fx").alias("x"), F.col("_fy").alias("y"), F.col("_fw").alias("width"), F.col("_fh").alias("height")
    )
    done = sealed(df, [c for c in df.columns if not c.startswith("_")], {
        "template_id": F.col("t.template_id"),
        "strategy": F.col("_s"),
        "strategy_id": F.col("_s.id"),
        "strategy_label": F.col("_s.label"),
        "used_fallback": F.col("_index") > 0,
        "overflow_policy": F.col("_policy"),
        "crop": crop,
        "upscale": canvas_h / F.greatest(F.lit(MIN_CROP), F.col("_fh")),
        "overflow": F.struct(*[c.alias(n) for n, c in over.items()]),
        "violations": violations,
    })
    return done.withColumn("placements", placements())


def placements() -> Column:
    """Where each referenced anchor landed, with its target and the signed error where it has one."""
    s, crop = F.col("strategy"), F.col("crop")
    names = F.array_sort(F.array_union(implicit_anchors(s), s["requires"]))
    canvas_w, canvas_h = F.col("t.canvas_width"), F.col("t.canvas_height")
    scale_x = canvas_w / F.greatest(F.lit(MIN_CROP), crop["width"])
    scale_y = canvas_h / F.greatest(F.lit(MIN_CROP), crop["height"])

    def describe(name: Column) -> Column:
        a = _anchor(name)
        cx, cy = (a["x"] - crop["x"]) * scale_x, (a["y"] - crop["y"]) * scale_y
        on_x = F.coalesce(s["horizontal"]["anchor"] == name, F.lit(False))
        on_y = F.coalesce(s["vertical"]["anchor"] == name, F.lit(False))
        tx = F.when(on_x, s["horizontal"]["target_pct"] / 100.0 * canvas_w).when(on_y, cx)
        ty = F.when(on_y, s["vertical"]["target_pct"] / 100.0 * canvas_h).when(on_x, cy)
        return F.struct(
            name.alias("anchor"), a["x"].alias("source_x"), a["y"].alias("source_y"),
            cx.alias("canvas_x"), cy.alias("canvas_y"), tx.alias("target_x"), ty.alias("target_y"),
            (tx - cx).alias("error_x"), (ty - cy).alias("error_y"), a["confidence"].alias("confidence"),
        )

    present = F.filter(names, lambda name: _anchor(name).isNotNull())
    return F.transform(present, describe)


def frame_catalog(subjects: DataFrame, templates: DataFrame | list[dict], pairs: DataFrame | None = None) -> DataFrame:
    """Framing of all pairs, or of the planned ones when ``pairs`` is given. Keeps the template as ``t``."""
    paired = pair_all(subjects, templates) if pairs is None else pair_planned(subjects, templates, pairs)
    return solve(paired)


def vertical_range(framed: DataFrame) -> DataFrame:
    """Vertical targets (percent) that still move the crop; null when any target can be met."""
    pin = F.element_at("anchors", F.col("strategy.vertical.anchor"))["y"]
    ch, ih = F.col("crop.height"), F.col("image_height")
    bounded_axis = (F.col("overflow_policy") == "clamp") & (ch < ih) & (ch > 0) & pin.isNotNull()
    return framed.select(
        "source_hash", "template_id",
        F.when(bounded_axis, G.clamp((pin - (ih - ch)) / ch * 100.0, F.lit(0.0), F.lit(100.0))).alias("min_pct"),
        F.when(bounded_axis, G.clamp(pin / ch * 100.0, F.lit(0.0), F.lit(100.0))).alias("max_pct"),
    )


def has_overflow(framed_overflow: Column) -> Column:
    return F.greatest(*[framed_overflow[side] for side in ("left", "top", "right", "bottom")]) > EDGE


def placed_rect(scale: float = 1.0) -> Column:
    """The crop's part of the photo: its canvas rectangle and its source rectangle, null when empty."""
    crop = F.col("crop")
    sx, sy = F.greatest(F.lit(0.0), crop["x"]), F.greatest(F.lit(0.0), crop["y"])
    sw = F.least(F.col("image_width"), crop["x"] + crop["width"]) - sx
    sh = F.least(F.col("image_height"), crop["y"] + crop["height"]) - sy
    kx = G.js_round(F.col("t.canvas_width") * scale) / crop["width"]
    ky = G.js_round(F.col("t.canvas_height") * scale) / crop["height"]
    return F.when(
        (sw > 0) & (sh > 0),
        F.struct(
            ((sx - crop["x"]) * kx).alias("x"), ((sy - crop["y"]) * ky).alias("y"),
            (sw * kx).alias("width"), (sh * ky).alias("height"),
            sx.alias("source_x"), sy.alias("source_y"), sw.alias("source_width"), sh.alias("source_height"),
        ),
    )
