"""Validation reports: one row per broken rule, nothing dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framejobs import vocab
from framejobs.operators.ranking import bounded


def _report(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()]))
    return df.select(*keys, F.explode(codes).alias("problem"))


def validate_templates(templates: DataFrame) -> DataFrame:
    """Structural checks that would otherwise fail once per image inside a run."""
    n = F.size("strategies")
    last = F.get("strategies", n - 1)
    w, h = F.col("canvas_width"), F.col("canvas_height")
    return _report(templates, ["template_id"], {
        "schema_version": ~F.col("schema_version").eqNullSafe(vocab.TEMPLATE_SCHEMA_VERSION),
        "canvas_missing": w.isNull() | h.isNull(),
        "canvas_too_small": (w < 64) | (h < 64),
        "canvas_too_large": (w > 8192) | (h > 8192),
        "strategies_missing": F.col("strategies").isNull(),
        "strategies_empty": F.col("strategies").isNotNull() & (n == 0),
        "last_strategy_requires_anchors": (n > 0) & (F.size(last["requires"]) > 0),
        "layers_missing": F.col("layers").isNull(),
        "too_many_layers": F.col("layers").isNotNull() & (F.size("layers") > 100),
    })


def validate_rules(rules: DataFrame, templates: DataFrame) -> DataFrame:
    known = bounded(templates.select("template_id", F.lit(True).alias("__known")).distinct())
    joined = rules.join(known, "template_id", "left")
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    return _report(joined, ["rule_id"], {
        "name_required": F.trim(F.coalesce("rule_name", F.lit(""))) == "",
        "match_type": ~F.coalesce(F.col("match_type").isin(*vocab.MATCH_TYPES), F.lit(False)),
        "operator": ~F.coalesce(F.col("operator").isin(*vocab.OPERATORS), F.lit(False)),
        "template_unknown": F.col("__known").isNull(),
        "value_required": (F.col("match_type") != "default") & (F.col("operator") != "any") & blank,
    })


def validate_enums(df: DataFrame, keys: list[str], vocabularies: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside a column's vocabulary; null passes, as in a CHECK constraint."""
    return _report(df, keys, {c: ~F.col(c).isin(*allowed) for c, allowed in vocabularies.items()})
