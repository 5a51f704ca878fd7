"""Rule routing: which template each product gets, and why."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from framejobs import vocab
from framejobs.functions import rules as R
from framejobs.operators.ranking import bounded

# Branches per CASE expression; longer rule lists continue in the next expression.
RULES_PER_CASE = 200
UNMATCHED = "no_rule"

_RULE_SCHEMA = (
    "array<struct<rule_id:string,rule_name:string,match_type:string,operator:string,value:string,"
    "template_id:string,priority:int,skipped:string>>"
)


def rule_order(rules: DataFrame) -> DataFrame:
    """Rules with specificity and evaluation rank: priority, specificity, age, id."""
    from pyspark.sql import Window

    scored = rules.withColumn(
        "specificity", R.specificity(F.col("match_type"), F.col("operator"), F.col("value"))
    )
    order = Window.orderBy(
        F.desc("priority"), F.desc("specificity"), F.asc("created_at"), F.asc("rule_id")
    )
    return scored.withColumn("evaluation_rank", F.row_number().over(order))


def load_rules(rules: DataFrame) -> list[dict]:
    """Rules in evaluation order on the driver: typed in by operators, so there are few and they are short.

    Needles and glob expressions are prepared by Spark, so that routing compiles them once.
    """
    prepared = (
        rule_order(rules)
        .withColumn("needle", F.lower(F.trim("value")))
        .withColumn("pattern", R.glob_regex(F.col("needle")))
        .orderBy("evaluation_rank")
    )
    return [row.asDict() for row in prepared.collect()]


def _lowered(subjects: DataFrame) -> DataFrame:
    return subjects.select(
        "*",
        *[F.lower(F.col(column)).alias(f"__{kind}") for kind, column in R.SUBJECT_FIELDS.items()],
        (F.col("shot_type").isNotNull() | F.col("garment_type").isNotNull()).alias("__vision"),
    )


def _condition(rule: dict) -> Column:
    fields = {kind: F.col(f"__{kind}") for kind in R.SUBJECT_FIELDS}
    test = R.predicate(rule, fields)
    if rule["match_type"] in ("shot_type", "garment_type"):
        test = F.col("__vision") & test
    return test if rule["is_active"] else F.lit(False)


def _first_match(ordered: list[dict]) -> Column:
    """0-based place of the first matching rule: a CASE stops at its first true branch."""
    cases = []
    for start in range(0, len(ordered), RULES_PER_CASE):
        case = None
        for i, rule in enumerate(ordered[start:start + RULES_PER_CASE], start):
            if not rule["is_active"]:
                continue
            branch = F.when if case is None else case.when
            case = branch(_condition(rule), F.lit(i))
        if case is not None:
            cases.append(case)
    return F.coalesce(*cases) if cases else F.lit(None).cast("int")


def _literal_rules(ordered: list[dict]) -> Column:
    rows = [
        {k: rule[k] for k in ("rule_id", "rule_name", "match_type", "operator", "value", "template_id", "priority")}
        | {"skipped": None if rule["is_active"] else "inactive"}
        for rule in ordered
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE_SCHEMA)


def explain_rule(rule: Column) -> Column:
    """Which rule won and on what it matched; the subject's columns are in scope."""
    kind = rule["match_type"]
    field = F.lit("")
    for match_type, column in R.SUBJECT_FIELDS.items():
        field = F.when(kind == match_type, F.col(column)).otherwise(field)
    label = F.element_at(F.create_map(*[F.lit(x) for p in vocab.MATCH_TYPE_LABELS.items() for x in p]), kind)
    verb = F.element_at(F.create_map(*[F.lit(x) for p in vocab.OPERATOR_LABELS.items() for x in p]), rule["operator"])
    source = F.concat(F.lit("["), rule["priority"].cast("string"), F.lit("] "), rule["rule_name"], F.lit(": "))
    test = F.concat(label, F.lit(" "), verb, F.lit(" <"), rule["value"], F.lit(">, found <"), F.coalesce(field, F.lit("")), F.lit(">"))
    return F.concat(source, F.when(kind == "default", "every product").otherwise(test))


def route(subjects: DataFrame, rules: DataFrame, unmatched: str = UNMATCHED) -> DataFrame:
    """Template, rule and explanation of every subject. A narrow job: no shuffle, no join."""
    ordered = load_rules(rules)
    keep = subjects.columns
    staged = _lowered(subjects).withColumn("__place", _first_match(ordered))
    staged = staged.withColumn("__rule", F.get(_literal_rules(ordered), F.col("__place")))
    return staged.select(
        *keep,
        F.col("__rule.template_id").alias("template_id"),
        F.col("__rule.rule_id").alias("rule_id"),
        F.coalesce(explain_rule(F.col("__rule")), F.lit(unmatched)).alias("explanation"),
    )


def rule_trace(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule looked at for each subject, up to and with the match, with skip reasons."""
    ordered = load_rules(rules)
    keep = subjects.columns
    staged = _lowered(subjects).withColumn("__place", _first_match(ordered))
    last = F.coalesce(F.col("__place") + 1, F.lit(len(ordered)))
    seen = F.slice(_literal_rules(ordered), F.lit(1), last)
    vision_kinds = ("shot_type", "garment_type")
    return staged.select(*keep, "__place", "__vision", F.posexplode(seen).alias("step", "__rule")).select(
        *keep,
        "step",
        F.col("__rule.rule_id").alias("rule_id"),
        F.col("__rule.rule_name").alias("rule_name"),
        F.coalesce(F.col("step") == F.col("__place"), F.lit(False)).alias("matched"),
        F.when(F.col("__rule.skipped").isNotNull(), F.col("__rule.skipped"))
        .when(F.col("__rule.match_type").isin(*vision_kinds) & ~F.col("__vision"), F.lit("no_vision_data"))
        .alias("skipped"),
    )


def matched_per_template(routed: DataFrame) -> DataFrame:
    return (
        routed.filter(F.col("template_id").isNotNull())
        .groupBy("template_id")
        .agg(F.count(F.lit(1)).alias("matched"))
    )


def with_template_names(df: DataFrame, templates: DataFrame) -> DataFrame:
    names = templates.select("template_id", F.col("name").alias("template_name"))
    return df.join(bounded(names), "template_id", "left")
