"""Template tables: canvas presets combined with framing presets."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from framejobs import vocab

STRATEGY = (
    "struct<id:string,label:string,requires:array<string>,min_confidence:double,shot_types:array<string>,"
    "vertical:struct<anchor:string,target_pct:double>,horizontal:struct<anchor:string,target_pct:double>,"
    "scale:struct<mode:string,from:string,to:string,span_pct:double,height_pct:double,"
    "source_per_canvas_pixel:double>,overflow:string>"
)
LAYER = (
    "struct<id:string,type:string,name:string,x:double,y:double,width:double,height:double,rotation:double,"
    "opacity:double,z_index:int,visible:boolean,anchor_to:string,content:string,asset_key:string,fit:string>"
)
TEMPLATE_SCHEMA = (
    "template_id string, name string, category string, schema_version int, aspect_ratio string, "
    "canvas_width double, canvas_height double, background_mode string, backdrop_prompt string, "
    "max_upscale double, min_upscale double, overflow string, keep_inside array<string>, "
    f"keep_inside_padding_pct double, strategies array<{STRATEGY}>, layers array<{LAYER}>, "
    "subject_z_index int, is_active boolean"
)

# Default constraints, background and the four framing presets.
DEFAULT_CONSTRAINTS = {
    "max_upscale": 1.5, "min_upscale": 0.05, "overflow": "allow", "keep_inside": [], "keep_inside_padding_pct": 0.0,
}
DEFAULT_BACKGROUND_MODE = "ai_extend"
DEFAULT_PRESET = "full_body_editorial"


def _span(start: str, end: str, pct: float) -> dict:
    return {"mode": "span", "from": start, "to": end, "span_pct": pct}


def _subject(pct: float) -> dict:
    return {"mode": "subject", "height_pct": pct}


def _at(anchor: str, pct: float) -> dict:
    return {"anchor": anchor, "target_pct": pct}


def _strategy(id, label, requires, confidence, shots, vertical, horizontal, scale) -> dict:
    return {
        "id": id, "label": label, "requires": requires, "min_confidence": confidence, "shot_types": shots,
        "vertical": vertical, "horizontal": horizontal, "scale": scale, "overflow": None,
    }


def _fit_subject(pct: float) -> dict:
    return _strategy(
        "subject_fit", "Fit subject", [], 0.0, [], None, _at("subject_center", 50.0), _subject(pct)
    )


_BODY = ["full_body", "three_quarter", "half_body"]
_CLOSE = ["portrait", "close_up", "half_body"]
PRESETS = {
    "full_body_editorial": {
        "constraints": {
            "max_upscale": 1.4, "keep_inside": ["head_top", "feet", "knee_center"], "keep_inside_padding_pct": 1.0,
        },
        "strategies": [
            _strategy("head_to_feet", "Head to feet", ["head_top", "feet"], 0.35, ["full_body"],
                      _at("head_top", 8.0), _at("subject_center", 50.0), _span("head_top", "feet", 84.0)),
            _strategy("head_to_knees", "Head to knees", ["head_top", "knee_center"], 0.35, _BODY,
                      _at("head_top", 10.0), _at("subject_center", 50.0), _span("head_top", "knee_center", 72.0)),
            _fit_subject(88.0),
        ],
    },
    "portrait_beauty": {
        "constraints": {"max_upscale": 2.0, "keep_inside": ["head_top", "chin"], "keep_inside_padding_pct": 2.0},
        "strategies": [
            _strategy("eye_line_third", "Eye line on upper third", ["eye_line", "chin"], 0.4, _CLOSE,
                      _at("eye_line", 36.0), _at("eye_line", 50.0), _span("head_top", "chin", 34.0)),
            _strategy("head_shoulders", "Head and shoulders", ["head_top", "shoulder_center"], 0.35, _CLOSE,
                      _at("head_top", 14.0), _at("shoulder_center", 50.0),
                      _span("head_top", "shoulder_center", 42.0)),
            _fit_subject(80.0),
        ],
    },
    "garment_focus": {
        "constraints": {
            "max_upscale": 1.6, "keep_inside": ["garment_top", "garment_hem"], "keep_inside_padding_pct": 2.0,
        },
        "strategies": [
            _strategy("neckline_to_hem", "Neckline to hem", ["garment_top", "garment_hem"], 0.3, [],
                      _at("garment_top", 10.0), _at("subject_center", 50.0),
                      _span("garment_top", "garment_hem", 80.0)),
            _strategy("shoulders_to_hips", "Shoulders to hips", ["shoulder_center", "hip_center"], 0.35, [],
                      _at("shoulder_center", 18.0), _at("shoulder_center", 50.0),
                      _span("shoulder_center", "hip_center", 55.0)),
            _fit_subject(90.0),
        ],
    },
    "flat_lay": {
        "constraints": {"max_upscale": 1.2, "overflow": "shrink", "keep_inside": [], "keep_inside_padding_pct": 0.0},
        "strategies": [
            _strategy("subject_centered", "Subject centred", [], 0.0, [], _at("subject_center", 50.0),
                      _at("subject_center", 50.0), _subject(82.0)),
        ],
    },
}


def template(
    template_id: str, preset: str = DEFAULT_PRESET, aspect_ratio: str = "4:5", name: str | None = None, **changes
) -> dict:
    """One template row: a canvas preset, a framing preset, and any changed fields."""
    spec = copy.deepcopy(PRESETS.get(preset, PRESETS[DEFAULT_PRESET]))
    width, height = vocab.ASPECT_RATIOS.get(aspect_ratio, vocab.ASPECT_RATIOS["4:5"])
    row = {
        "template_id": template_id, "name": name or f"{preset} {aspect_ratio}", "category": None,
        "schema_version": vocab.TEMPLATE_SCHEMA_VERSION, "aspect_ratio": aspect_ratio,
        "canvas_width": float(width), "canvas_height": float(height),
        "background_mode": DEFAULT_BACKGROUND_MODE, "backdrop_prompt": "",
        **DEFAULT_CONSTRAINTS, **spec["constraints"],
        "strategies": spec["strategies"], "layers": [], "subject_z_index": 0, "is_active": True,
    }
    return {**row, **changes}


def layer(id: str, type: str, **changes) -> dict:
    """One template layer with the usual defaults of its type."""
    base = {
        "id": id, "type": type, "name": type.capitalize(), "x": 10.0, "y": 10.0, "width": 40.0, "height": 12.0,
        "rotation": 0.0, "opacity": 1.0, "z_index": 0, "visible": True, "anchor_to": None, "content": None,
        "asset_key": None, "fit": None,
    }
    by_type = {
        "text": {"content": "{{product_name}}"},
        "image": {"asset_key": "", "fit": "contain"},
        "ellipse": {"width": 20.0, "height": 20.0},
        "badge": {"width": 22.0, "height": 7.0, "content": "NEW IN"},
    }
    return {**base, **by_type.get(type, {}), **changes}


def build_templates(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Template rows as a typed table."""
    return literal_table(spark, rows, TEMPLATE_SCHEMA)


def template_literal(rows: list[dict]) -> Column:
    """Template rows as one constant ``array<struct>`` column."""
    return literal_array(rows, TEMPLATE_SCHEMA)


def literal_array(rows: list[dict], schema: str) -> Column:
    fields = StructType.fromDDL(schema).simpleString()
    return F.from_json(F.lit(json.dumps(rows, default=str)), f"array<{fields}>")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Settings as a table that is a constant of the plan: one task, no Python serialisation."""
    return spark.range(1, numPartitions=1).select(F.inline(literal_array(rows, schema)))
