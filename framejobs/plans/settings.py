"""Rules and templates used by the registered queries: the operator-typed side of the catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from framejobs.sources import templates as T

# id, name, match type, operator, value, template, priority, active, minute of creation
RULES = [
    ("r01", "Close-ups", "shot_type", "equals", "close_up", "tpl_2", 90, True, 1),
    ("r02", "English sources", "folder", "matches", "en/src?", "tpl_0", 80, True, 2),
    ("r03", "English tree", "folder", "starts_with", " EN ", "tpl_1", 80, True, 3),
    ("r04", "Inactive catch-all", "default", "any", "", "tpl_7", 100, False, 4),
    ("r05", "Outfits", "garment_type", "equals", "full_outfit", "tpl_3", 70, True, 5),
    ("r06", "Sets", "name", "starts_with", "SET-", "tpl_4", 60, True, 6),
    ("r07", "Ends in one", "name", "ends_with", "1", "tpl_5", 60, True, 7),
    ("r08", "German", "category", "equals", "DE", "tpl_6", 60, True, 8),
    ("r09", "Any depth", "folder", "matches", "**/src1*", "tpl_0", 50, True, 9),
    ("r10", "Empty needle", "name", "contains", "", "tpl_7", 55, True, 10),
    ("r11", "Second import", "import", "equals", "imp_1", "tpl_1", 40, True, 12),
    ("r12", "Second import, older", "import", "equals", "imp_1", "tpl_2", 40, True, 11),
    ("r13", "Any category", "category", "any", "", "tpl_2", 10, True, 13),
    ("r14", "Looks in the nineties", "name", "contains", "look-9", "tpl_3", 5, True, 14),
]

TEMPLATES = [
    T.template("tpl_0", "full_body_editorial", "4:5", "Editorial"),
    T.template("tpl_1", "full_body_editorial", "1:1", "Editorial square", overflow="clamp"),
    T.template("tpl_2", "portrait_beauty", "4:5", "Beauty", backdrop_prompt=" soft grey (studio), wall: plain "),
    T.template("tpl_3", "portrait_beauty", "9:16", "Beauty story", overflow="clamp"),
    T.template("tpl_4", "garment_focus", "2:3", "Garment"),
    T.template("tpl_5", "garment_focus", "16:9", "Garment wide", overflow="shrink"),
    T.template("tpl_6", "flat_lay", "1:1", "Flat lay", background_mode="solid"),
    T.template("tpl_7", "flat_lay", "1.91:1", "Flat lay wide", background_mode="solid", overflow="clamp",
               min_upscale=0.6),
]
# One strategy of its own mind about overflow, and a last resort without any strategy at all.
TEMPLATES[0]["strategies"][2]["overflow"] = "shrink"
TEMPLATES[0]["layers"] = [
    T.layer("title", "text", x=6.0, y=86.0, width=60.0, height=8.0, z_index=2,
            content="{{product_name}} / {{ category }} {{index}}"),
    T.layer("tag", "badge", x=2.0, y=-3.0, anchor_to="shoulder_right", z_index=3),
    T.layer("wash", "rectangle", x=0.0, y=0.0, width=100.0, height=100.0, z_index=-1),
    T.layer("ghost", "ellipse", visible=False),
]
TEMPLATES[4]["layers"] = [
    T.layer("logo", "image", x=70.0, y=4.0, width=24.0, height=10.0, anchor_to="garment_top", fit="cover"),
    T.layer("caption", "text", content="{{folder}}: {{shot_type}} {{missing}}", z_index=1),
]
TEMPLATES[7]["strategies"] = [
    T._strategy("fixed", "Fixed scale", [], 0.0, [], None, None, {"mode": "fixed", "source_per_canvas_pixel": 2.0}),
]


RULE_SCHEMA = (
    "rule_id string, rule_name string, match_type string, operator string, value string, template_id string, "
    "priority int, is_active boolean, created_at timestamp"
)


def rules(spark: SparkSession) -> DataFrame:
    names = [field.split()[0] for field in RULE_SCHEMA.split(", ")]
    rows = [dict(zip(names, (*r[:8], datetime(2024, 1, 1, 0, r[8])))) for r in RULES]
    return T.literal_table(spark, rows, RULE_SCHEMA)


def templates(spark: SparkSession) -> DataFrame:
    return T.build_templates(spark, TEMPLATES)


def sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"{value}::double" if isinstance(value, float) else str(value)
    if isinstance(value, list):
        return "[" + ", ".join(sql_value(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {sql_value(v)}" for k, v in value.items()) + "}"
    return "'" + str(value).replace("'", "''") + "'"


def rules_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(sql_value(v) for v in r) + ")" for r in RULES
    ) + ") r(rule_id, rule_name, match_type, operator, value, template_id, priority, is_active, created)"


def templates_sql() -> str:
    """Templates as rows; every struct spells out all fields, so that the lists are uniform."""
    def strategy(s: dict) -> str:
        flat = {
            "id": s["id"], "label": s["label"], "requires": s["requires"], "min_confidence": s["min_confidence"],
            "shots": s["shot_types"],
            "v_anchor": (s["vertical"] or {}).get("anchor"), "v_pct": (s["vertical"] or {}).get("target_pct"),
            "h_anchor": (s["horizontal"] or {}).get("anchor"), "h_pct": (s["horizontal"] or {}).get("target_pct"),
            "mode": s["scale"]["mode"], "s_from": s["scale"].get("from"), "s_to": s["scale"].get("to"),
            "span": s["scale"].get("span_pct"), "height": s["scale"].get("height_pct"),
            "ratio": s["scale"].get("source_per_canvas_pixel"), "overflow": s["overflow"],
        }
        typed = {"requires": "VARCHAR[]", "shots": "VARCHAR[]"}
        texts = ("id", "label", "v_anchor", "h_anchor", "mode", "s_from", "s_to", "overflow")
        return "{" + ", ".join(
            f"'{k}': {sql_value(v)}::{typed.get(k) or ('VARCHAR' if k in texts else 'DOUBLE')}" for k, v in flat.items()
        ) + "}"

    rows = []
    for t in TEMPLATES:
        rows.append("(" + ", ".join([
            sql_value(t["template_id"]), sql_value(t["name"]), sql_value(t["canvas_width"]),
            sql_value(t["canvas_height"]), sql_value(t["background_mode"]), sql_value(t["backdrop_prompt"]),
            sql_value(t["max_upscale"]), sql_value(t["min_upscale"]), sql_value(t["overflow"]),
            sql_value(t["keep_inside"]) + "::VARCHAR[]", sql_value(t["keep_inside_padding_pct"]),
            "[" + ", ".join(strategy(s) for s in t["strategies"]) + "]",
        ]) + ")")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + (
        ") t(template_id, name, cw, ch, background, prompt, max_up, min_up, t_overflow, keep_inside, pad_pct, strategies)"
    )
