"""Raster statistics: masks and class maps reduced to a few numbers per image.

Cells are exploded inside generated code and combined before the shuffle, so what travels is a row
(or a raster line) per image, not its pixels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from framejobs import vocab
from framejobs.functions.geometry import js_round


def _cells(rasters: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    cells = rasters.select(*keys, "width", "height", *extra, F.posexplode("data").alias("i", "v"))
    return cells.withColumns({"x": F.col("i") % F.col("width"), "y": F.floor(F.col("i") / F.col("width")).cast("int")})


def cutoff(threshold: float) -> int:
    return int(threshold * 255 + 0.5)


def mask_features(masks: DataFrame, threshold: float = vocab.THRESHOLDS["mask_binary"]) -> DataFrame:
    """Box, coverage, certainty, centroid and outer rows of each mask; a mask without set cells is absent."""
    w, x, y = F.col("width"), F.col("x"), F.col("y")
    mirrored = y * w + (w - 1 - x)
    cells = _cells(masks, ["source_hash", "kind"]).filter(F.col("v") >= cutoff(threshold))
    stats = cells.groupBy("source_hash", "kind", "width", "height").agg(
        F.count(F.lit(1)).alias("set_pixels"), F.sum("v").alias("__sum"),
        F.min("x").alias("__l"), F.max("x").alias("__r"), F.min("y").alias("__t"), F.max("y").alias("__b"),
        F.sum("x").alias("__sx"), F.sum("y").alias("__sy"),
        # The smallest cell number is the top row's left end, and so on for the other three ends.
        F.min("i").alias("__tl"), F.max("i").alias("__br"),
        F.min(mirrored).alias("__tr"), F.max(mirrored).alias("__bl"),
    )
    n = F.col("set_pixels")
    return stats.select(
        "source_hash", "kind", "width", "height", "set_pixels",
        F.col("__l").cast("double").alias("left"), F.col("__t").cast("double").alias("top"),
        (F.col("__r") + 1).cast("double").alias("right"), (F.col("__b") + 1).cast("double").alias("bottom"),
        (n / (w * F.col("height"))).alias("coverage"),
        (F.col("__sum") / n / 255).alias("mean_probability"),
        (F.col("__sx") / n).alias("centroid_x"), (F.col("__sy") / n).alias("centroid_y"),
        F.col("__t").alias("top_row"), (F.col("__tl") % w).alias("top_left"),
        (w - F.col("__tr") % w).alias("top_right"),
        F.col("__b").alias("bottom_row"), (w - 1 - F.col("__bl") % w).alias("bottom_left"),
        (F.col("__br") % w + 1).alias("bottom_right"),
    )


def row_profile(masks: DataFrame, threshold: float = vocab.THRESHOLDS["mask_binary"]) -> DataFrame:
    """Set cells per raster row."""
    cells = _cells(masks, ["source_hash", "kind"])
    return cells.groupBy("source_hash", "kind", "y").agg(F.count_if(F.col("v") >= cutoff(threshold)).alias("set_pixels"))


def quantise(alpha: Column) -> Column:
    """Probability array to bytes."""
    return F.transform(
        alpha, lambda v: F.when(v <= 0, 0).when(v >= 1, 255).otherwise(F.floor(v * 255 + 0.5)).cast("smallint")
    )


def parse_features(parses: DataFrame, min_pixels: int = 2) -> DataFrame:
    """Class-set regions of each parse: counts, clothing box and confidence, outer rows, widest row.

    First per raster line, then per image; background cells are dropped before the shuffle.
    """
    sets = vocab.CLASS_SETS
    cells = parses.select(
        "source_hash", "width", "height", "scale_x", "scale_y",
        F.posexplode(F.arrays_zip("data", "confidence")).alias("i", "cell"),
    ).select(
        "source_hash", "width", "height", "scale_x", "scale_y", (F.col("i") % F.col("width")).alias("x"),
        F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
        F.col("cell.data").cast("int").alias("cls"), F.col("cell.confidence").cast("double").alias("conf"),
    ).filter(F.col("cls") != vocab.ATR["background"])
    garment = F.col("cls").isin(*sets["garment"])
    single = ("dress", "upper_clothes", "skirt", "pants", "scarf", "bag")
    ranged = ("garment", "upper_garment", "lower_garment", "head", "feet")
    keys = ["source_hash", "width", "height", "scale_x", "scale_y"]
    lines = cells.groupBy(*keys, "y").agg(
        *[F.count_if(F.col("cls").isin(*sets[s])).alias(f"n_{s}") for s in (*ranged, "body")],
        *[F.count_if(F.col("cls") == vocab.ATR[c]).alias(f"c_{c}") for c in single],
        F.min(F.when(garment, F.col("x"))).alias("lo"), F.max(F.when(garment, F.col("x"))).alias("hi"),
        F.sum(F.when(garment, F.col("x"))).alias("sx"), F.sum(F.when(garment, F.col("conf"))).alias("sc"),
    )
    enough = lambda s: F.when(F.col(f"n_{s}") >= min_pixels, F.col("y"))
    any_garment = F.when(F.col("n_garment") > 0, F.col("y"))
    widest = F.when(
        F.col("n_garment") > 0, F.col("n_garment") * F.col("height") + (F.col("height") - 1 - F.col("y"))
    )
    return lines.groupBy(*keys).agg(
        F.sum("n_garment").alias("garment_pixels"), F.sum("n_body").alias("body_pixels"),
        *[F.sum(f"c_{c}").alias(f"{c}_pixels") for c in single],
        F.min("lo").cast("double").alias("garment_left"), F.min(any_garment).cast("double").alias("garment_top"),
        (F.max("hi") + 1).cast("double").alias("garment_right"), (F.max(any_garment) + 1).cast("double").alias("garment_bottom"),
        F.coalesce(F.try_divide(F.sum("sc"), F.sum("n_garment")), F.lit(0.0)).alias("garment_confidence"),
        *[F.min(enough(s)).alias(f"{s}_first_row") for s in ranged],
        *[F.max(enough(s)).alias(f"{s}_last_row") for s in ranged],
        F.max_by(F.try_divide(F.col("sx"), F.col("n_garment")), widest).alias("widest_row_center"),
    )


_DISC = json.dumps([
    {"dx": dx, "dy": dy} for dy in range(-2, 3) for dx in range(-2, 3) if dx * dx + dy * dy <= 4
])


def classes_near(parse: Column, x: Column, y: Column) -> Column:
    """Classes of the cells in a radius-2 disc around a source point, without those off the map.

    ``parse`` is a struct with data, width, height, scale_x and scale_y.
    """
    cx, cy = js_round(x / parse["scale_x"]).cast("int"), js_round(y / parse["scale_y"]).cast("int")
    offsets = F.from_json(F.lit(_DISC), "array<struct<dx:int,dy:int>>")
    inside = F.filter(offsets, lambda o: (
        (cx + o["dx"] >= 0) & (cy + o["dy"] >= 0) & (cx + o["dx"] < parse["width"]) & (cy + o["dy"] < parse["height"])
    ))
    return F.transform(
        inside, lambda o: F.get(parse["data"], (cy + o["dy"]) * parse["width"] + cx + o["dx"]).cast("int")
    )


def class_fraction(near: Column, classes: tuple[int, ...]) -> Column:
    """Share of the cells in ``near`` that belong to ``classes``, 0 when there is no cell."""
    return F.coalesce(F.try_divide(F.size(F.filter(near, lambda c: c.isin(*classes))), F.size(near)), F.lit(0.0))


def class_fraction_near(parse: Column, x: Column, y: Column, classes: tuple[int, ...]) -> Column:
    return class_fraction(classes_near(parse, x, y), classes)


def class_at(parse: Column, x: Column, y: Column) -> Column:
    """Class at a source point, null outside the map."""
    cx, cy = js_round(x / parse["scale_x"]), js_round(y / parse["scale_y"])
    ok = (cx >= 0) & (cy >= 0) & (cx < parse["width"]) & (cy < parse["height"])
    return F.when(ok, F.get(parse["data"], (cy * parse["width"] + cx).cast("int")))


def argmax_classes(logits: DataFrame) -> DataFrame:
    """Winning class and its softmax probability per cell; the lowest class wins ties."""
    keys = ["source_hash", "cell"]
    top = logits.groupBy(*keys).agg(
        F.max_by("class_id", F.struct("logit", -F.col("class_id"))).alias("class_id"), F.max("logit").alias("__max"),
        F.collect_list("logit").alias("__all"),
    )
    spread = F.aggregate("__all", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("__max")))
    return top.select(*keys, "class_id", (F.lit(1.0) / spread).alias("confidence"))
