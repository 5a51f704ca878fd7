"""Layers, padding edges and background fills of framed images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from framejobs import vocab
from framejobs.functions import geometry as G, paths as P, text as X
from framejobs.operators.framing import EDGE, has_overflow, placed_rect
from framejobs.operators.ranking import bounded, first_by

EDGES = ("top", "bottom", "left", "right")
# Share of fabric and skin that decides what an edge cuts through, and the sampled band.
GARMENT_DOMINANT = 0.3
SKIN_PRESENT = 0.12
MASK_LEVEL = 0.5 * 255
BAND_FRACTION, BAND_MIN, BAND_MAX = 0.06, 24.0, 260.0
SAMPLES_MIN, SAMPLES_MAX = 6, 48


def with_variables(framed: DataFrame, details: DataFrame) -> DataFrame:
    """Join the text values of each image: product, category, folder, file, findings, shot number."""
    values = details.select(
        "source_hash",
        F.create_map(*[x for key in vocab.TEMPLATE_VARIABLES for x in (F.lit(key), F.col(key).cast("string"))]).alias("variables"),
    )
    return framed.join(values, "source_hash", "left")


def layer_layout(framed: DataFrame, assets: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """One row per visible layer: pixel rectangle, side of the subject, resolved text, fitted asset.

    A layer pinned to an anchor is offset from where that anchor landed. ``framed`` may carry a
    ``variables`` map; ``assets`` holds asset_key, asset_width and asset_height.
    """
    width, height = F.col("t.canvas_width") * scale, F.col("t.canvas_height") * scale
    ordered = F.array_sort(F.filter(
        F.transform("t.layers", lambda l, i: F.struct(l["z_index"].alias("z"), i.alias("i"), l.alias("layer"))),
        lambda e: e["layer"]["visible"],
    ))
    rows = framed.select(
        "source_hash", "template_id", "t", "placements",
        (F.col("variables") if "variables" in framed.columns else F.lit(None).cast("map<string,string>")).alias("variables"),
        F.posexplode(ordered).alias("draw_order", "e"),
    )
    layer = F.col("e.layer")
    pin = F.get(F.filter("placements", lambda p: p["anchor"] == layer["anchor_to"]), F.lit(0))
    rect = F.struct(
        (F.coalesce(pin["canvas_x"] * scale, F.lit(0.0)) + layer["x"] / 100.0 * width).alias("x"),
        (F.coalesce(pin["canvas_y"] * scale, F.lit(0.0)) + layer["y"] / 100.0 * height).alias("y"),
        (layer["width"] / 100.0 * width).alias("width"), (layer["height"] / 100.0 * height).alias("height"),
    )
    out = rows.select(
        "source_hash", "template_id", "draw_order", layer["id"].alias("layer_id"), layer["type"].alias("layer_type"),
        F.when(layer["z_index"] < F.col("t.subject_z_index"), "below").otherwise("above").alias("side"),
        pin.isNotNull().alias("pinned"), rect.alias("rect"), layer["asset_key"].alias("asset_key"), layer["fit"].alias("fit"),
        F.when(layer["content"].isNotNull(), F.when(
            F.col("variables").isNotNull(), X.substitute(layer["content"], F.col("variables"))
        ).otherwise(layer["content"])).alias("text"),
    )
    if assets is None:
        return out
    sized = out.join(bounded(assets), "asset_key", "left")
    fitted = G.fit_rect(F.col("asset_width").cast("double"), F.col("asset_height").cast("double"), F.col("rect"), F.col("fit"))
    return sized.withColumn("fitted", F.when(F.col("asset_width").isNotNull(), fitted))


def packed_masks(masks: DataFrame) -> DataFrame:
    """Rasters as one bit a pixel, on or off at half probability, packed where they are read: a sixteenth of their size."""
    def run(batches):
        for pdf in batches:
            bits = [np.packbits(np.asarray(d) >= MASK_LEVEL).tobytes() for d in pdf["data"]]
            yield pdf[["source_hash", "kind", "width", "height"]].assign(bits=np.array(bits, dtype=object))

    return masks.where("source_hash is not null and data is not null").select("source_hash", "kind", "width", "height", "data").mapInPandas(
        run, StructType([masks.schema["source_hash"], masks.schema["kind"], masks.schema["width"], masks.schema["height"], StructField("bits", BinaryType())]))


def _grid(width: int, height: int, bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=width * height).reshape(height, width).astype(bool)


def _sampled(band, grids: dict[str, np.ndarray]) -> str:
    """What a band cuts through, by evenly spread points looked up in the rasters."""
    found = {}
    if band.w <= 0 or band.h <= 0 or not grids:
        return "background"
    xs = band.x + (np.arange(band.cols) + 0.5) / band.cols * band.w
    ys = band.y + (np.arange(band.rows) + 0.5) / band.rows * band.h
    for kind, grid in grids.items():
        height, width = grid.shape
        column = np.clip(np.floor(xs / (band.image_width / width) + 0.5), 0, width - 1).astype(int)
        row = np.clip(np.floor(ys / (band.image_height / height) + 0.5), 0, height - 1).astype(int)
        found[kind] = grid[np.ix_(row, column)]
    none = np.zeros((band.rows, band.cols), dtype=bool)
    fabric = found.get("garment_mask", none)
    garment, skin = fabric.mean(), (found.get("person_mask", none) & ~fabric).mean()
    if skin >= SKIN_PRESENT:
        return "skin"
    return "garment" if garment >= GARMENT_DOMINANT else "background"


def edge_content(framed: DataFrame, masks: DataFrame, scale: float = vocab.SUPERSAMPLE) -> DataFrame:
    """What each overflowing edge cuts through: garment, skin or background; null without overflow.

    ``masks``: source_hash, kind (person_mask, garment_mask), width, height, data. Each raster is read once and packed to bits
    there. Bands and packed rasters meet by image in one sorted stream, rasters first, so a band is looked up in the rasters
    at hand: none is copied to bands or templates, and no image's bands are gathered. A band has at most 48 x 48 samples.
    """
    placed = framed.withColumn("placed", placed_rect(scale)).filter(has_overflow(F.col("overflow")) & F.col("placed").isNotNull())
    rows = placed.select("source_hash", "template_id", "image_width", "image_height", "overflow", "placed")
    x, y = F.col("placed.source_x"), F.col("placed.source_y")
    w, h = F.col("placed.source_width"), F.col("placed.source_height")
    thick = lambda cross: F.least(cross, F.greatest(F.lit(BAND_MIN), F.least(F.lit(BAND_MAX), G.js_round(cross * BAND_FRACTION).cast("double"))))
    rows = rows.withColumns({"_tv": thick(h), "_th": thick(w)})
    tv, th = F.col("_tv"), F.col("_th")

    def band(edge: str, bx, by, bw, bh) -> Column:
        return F.when(F.col(f"overflow.{edge}") > EDGE, F.struct(
            F.lit(edge).alias("edge"), bx.alias("x"), by.alias("y"), bw.alias("w"), bh.alias("h"),
            F.greatest(F.lit(SAMPLES_MIN), F.least(F.lit(SAMPLES_MAX), G.js_round(bw))).cast("int").alias("cols"),
            F.greatest(F.lit(SAMPLES_MIN), F.least(F.lit(SAMPLES_MAX), G.js_round(bh))).cast("int").alias("rows"),
        ))

    bands = F.array_compact(F.array(
        band("top", x, y, w, tv), band("bottom", x, y + h - tv, w, tv),
        band("left", x, y, th, h), band("right", x + w - th, y, th, h),
    ))
    asked = rows.select("source_hash", "template_id", "image_width", "image_height", F.explode(bands).alias("b")).select(
        "source_hash", F.lit(1).alias("turn"), "template_id", "image_width", "image_height", "b.*")
    both = packed_masks(masks).withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)

    def run(batches):
        image, grids = None, {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.source_hash != image:
                    image, grids = row.source_hash, {}
                if row.turn == 0:
                    grids[row.kind] = _grid(int(row.width), int(row.height), row.bits)
                else:
                    out.append((row.source_hash, row.template_id, row.edge, _sampled(row._replace(cols=int(row.cols), rows=int(row.rows)), grids)))
            yield pd.DataFrame(out, columns=["source_hash", "template_id", "edge", "content"], dtype=object)

    kind = StructType([asked.schema["source_hash"], asked.schema["template_id"], StructField("edge", StringType()), StructField("content", StringType())])
    parts = int(framed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "source_hash").sortWithinPartitions("source_hash", "turn", "kind", "width", "height").mapInPandas(run, kind)


def garment_edges(edges: DataFrame) -> DataFrame:
    """Edges of each framed image that cut through fabric, in naming order. At most four per group."""
    cut = edges.filter(F.col("content") == "garment").groupBy("source_hash", "template_id").agg(
        F.collect_set("edge").alias("__set")
    )
    named = F.array_compact(F.array(*[F.when(F.array_contains("__set", e), F.lit(e)) for e in EDGES]))
    return cut.select("source_hash", "template_id", named.alias("garment_edges"))


def fill_plan(framed: DataFrame, edges: DataFrame, derived: DataFrame, scale: float = vocab.SUPERSAMPLE) -> DataFrame:
    """Distinct background fills to request: overflowing frames of generated-background templates,
    minus those whose result is stored already. ``derived``: source_hash, kind."""
    wanted = framed.filter((F.col("t.background_mode") == "ai_extend") & has_overflow(F.col("overflow")))
    rows = wanted.withColumn("placed", placed_rect(scale)).select(
        "source_hash", "template_id", "overflow", "placed", F.col("t.backdrop_prompt").alias("base"),
        G.js_round(F.col("t.canvas_width") * scale).alias("canvas_width"),
        G.js_round(F.col("t.canvas_height") * scale).alias("canvas_height"),
    )
    rows = rows.join(garment_edges(edges), ["source_hash", "template_id"], "left").withColumn(
        "prompt", X.fill_prompt(F.col("base"), F.coalesce("garment_edges", F.array().cast("array<string>")))
    )
    rows = rows.withColumn("kind", X.fill_key(F.col("overflow"), F.col("prompt"))).select(
        "source_hash", "template_id", "kind", "canvas_width", "canvas_height",
        X.sanitize_prompt(F.col("prompt")).alias("prompt"),
        P.derived_key(F.col("source_hash"), F.col("kind"), F.lit("jpg")).alias("storage_key"),
        G.js_round(F.col("placed.x")).alias("offset_x"), G.js_round(F.col("placed.y")).alias("offset_y"),
        F.greatest(F.lit(1).cast("long"), G.js_round(F.col("placed.width"))).alias("placed_width"),
        F.greatest(F.lit(1).cast("long"), G.js_round(F.col("placed.height"))).alias("placed_height"),
    )
    fresh = rows.join(derived.select("source_hash", "kind"), ["source_hash", "kind"], "left_anti")
    return first_by(fresh, ["source_hash", "kind"], F.col("template_id"))
