"""Column expressions over points, boxes and canvases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(value: Column, low, high) -> Column:
    """``low`` wins over ``high`` when the range is empty, as in a chained comparison."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def clamp01(value: Column) -> Column:
    return clamp(value, F.lit(0.0), F.lit(1.0))


def js_round(value: Column) -> Column:
    """Halves go up, also for negative numbers."""
    return F.floor(value + F.lit(0.5))


def round_to(value: Column, digits: int = 4) -> Column:
    """Reporting round built from multiply and floor, so that every engine agrees to the bit."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def mean(values: Column) -> Column:
    """Mean of an array of doubles, 0 when it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def midpoint(a: Column, b: Column) -> Column:
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def lerp(a: Column, b: Column, t) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(
        left.cast("double").alias("left"), top.cast("double").alias("top"),
        right.cast("double").alias("right"), bottom.cast("double").alias("bottom"),
    )


def box_width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["right"] - b["left"])


def box_height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["bottom"] - b["top"])


def box_center(b: Column) -> Column:
    return point((b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2)


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def center_to_box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def unletterbox(value: Column, pad: Column, scale: Column, to_source: Column) -> Column:
    """Model-input coordinate to source pixels."""
    return (value - pad) / scale * to_source


def clamp_to(value: Column, size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(size, value))


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    return box(
        clamp_to(b["left"], width), clamp_to(b["top"], height),
        clamp_to(b["right"], width), clamp_to(b["bottom"], height),
    )


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def has_anchor(anchors: Column, name, min_confidence) -> Column:
    found = F.element_at(anchors, name if isinstance(name, Column) else F.lit(name))
    return F.coalesce(found["confidence"] >= min_confidence, F.lit(False))


def to_canvas(x: Column, crop_start: Column, crop_size: Column, canvas_size: Column) -> Column:
    return (x - crop_start) / crop_size * canvas_size


def to_source(x: Column, crop_start: Column, crop_size: Column, canvas_size: Column) -> Column:
    return crop_start + x / canvas_size * crop_size


def fit_within(width: Column, height: Column, max_dimension: int) -> Column:
    longest = F.greatest(width, height)
    scale = F.lit(float(max_dimension)) / longest
    small = longest <= max_dimension
    return F.struct(
        F.when(small, width.cast("long")).otherwise(js_round(width * scale)).alias("width"),
        F.when(small, height.cast("long")).otherwise(js_round(height * scale)).alias("height"),
    )


def fit_rect(natural_w: Column, natural_h: Column, rect: Column, fit: Column) -> Column:
    """Place an asset inside a rectangle by contain, cover or fill."""
    by_w = F.try_divide(rect["width"], natural_w)
    by_h = F.try_divide(rect["height"], natural_h)
    scale = F.when(fit == "cover", F.greatest(by_w, by_h)).otherwise(F.least(by_w, by_h))
    w, h = natural_w * scale, natural_h * scale
    as_is = (fit == "fill") | (natural_w == 0) | (natural_h == 0)
    return F.when(as_is, rect).otherwise(
        F.struct(
            (rect["x"] + (rect["width"] - w) / 2).alias("x"),
            (rect["y"] + (rect["height"] - h) / 2).alias("y"),
            w.alias("width"), h.alias("height"),
        )
    )
