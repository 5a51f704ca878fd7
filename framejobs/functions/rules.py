"""Rule predicates and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framejobs import vocab

SUBJECT_FIELDS = {
    "folder": "folder_path", "category": "category", "import": "import_id", "name": "product_name",
    "shot_type": "shot_type", "garment_type": "garment_type",
}


def _weights(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def specificity(match_type: Column, operator: Column, value: Column) -> Column:
    """How narrow a rule is: type, then operator, then folder depth; a default rule is 0."""
    depth = F.when(
        match_type == "folder", F.size(F.filter(F.split(value, "/"), lambda part: part != ""))
    ).otherwise(0)
    score = _weights(vocab.TYPE_WEIGHT, match_type) * 100 + _weights(vocab.OPERATOR_WEIGHT, operator) * 10 + depth
    return F.when(match_type == "default", F.lit(0)).otherwise(score)


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a glob: ``*`` inside a segment, ``**`` across, ``?`` one char.

    Tokens are taken left to right, so ``***/`` reads as ``**`` then ``*`` then ``/``.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(r"(\*\*/|\*\*|\*|\?|[^*?]+)"), F.lit(0))
    body = F.transform(
        tokens,
        lambda t: F.when(t == "**/", "(?:.*/)?")
        .when(t == "**", ".*")
        .when(t == "*", "[^/]*")
        .when(t == "?", "[^/]")
        .otherwise(F.regexp_replace(t, r"([.+^${}()|\[\]\\])", r"\\$1")),
    )
    return F.concat(F.lit(r"\A"), F.array_join(body, ""), F.lit(r"\z"))


def glob_matches(value: Column, pattern: Column) -> Column:
    return (pattern != "") & F.rlike(value, glob_regex(pattern))


def predicate(rule: dict, lowered: dict[str, Column]) -> Column:
    """Match condition of one known rule over the lower-cased subject fields; never null."""
    kind, operator = rule["match_type"], rule["operator"]
    if kind == "default":
        return F.lit(True)
    field, needle = lowered[kind], rule["needle"]
    if operator == "any":
        test = F.lit(True)
    elif operator == "equals":
        test = field == needle
    elif operator == "contains":
        test = field.contains(needle) if needle else F.lit(False)
    elif operator == "starts_with" and kind == "folder":
        test = (field == needle) | field.startswith(needle + "/")
    elif operator == "starts_with":
        test = field.startswith(needle)
    elif operator == "ends_with":
        test = field.endswith(needle)
    elif operator == "matches":
        test = field.rlike(rule["pattern"]) if needle else F.lit(False)
    else:
        test = F.lit(False)
    return field.isNotNull() & F.coalesce(test, F.lit(False))


def shot_universe(strategies: Column) -> Column:
    """Union of the shot types a strategy chain names; empty when it names none."""
    return F.array_distinct(F.flatten(F.transform(strategies, lambda s: s["shot_types"])))


def shot_applicable(shot_type: Column, strategies: Column) -> Column:
    universe = shot_universe(strategies)
    return (F.size(universe) == 0) | F.array_contains(universe, shot_type)
