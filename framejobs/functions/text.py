"""Column expressions that build text: substitutions, prompts, keys, report cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framejobs import vocab
from framejobs.functions.geometry import js_round
from framejobs.functions.paths import SPACE


def substitute(content: Column, values: Column) -> Column:
    """Replace ``{{key}}`` by ``values[key]`` in one pass; an unknown key stays as written.

    One pass over tokens, so inserted text is never substituted again.
    """
    tokens = F.regexp_extract_all(content, F.lit(r"(\{\{\w+\}\}|\{|[^{]+)"), F.lit(0))

    def resolve(token: Column) -> Column:
        key = F.regexp_extract(token, r"\A\{\{(\w+)\}\}\z", 1)
        return F.when(key != "", F.coalesce(F.element_at(values, key), token)).otherwise(token)

    return F.array_join(F.transform(tokens, resolve), "")


def sanitize_prompt(text: Column) -> Column:
    """Drop the punctuation a transformation-string parser would split on."""
    cleaned = F.regexp_replace(text, r"[,;:/|.()\[\]{}]", " ")
    return F.trim(F.regexp_replace(cleaned, SPACE + "+", " "))


def fill_prompt(base: Column, garment_edges: Column) -> Column:
    """Base prompt, plus one clause naming the edges that cut through fabric.

    ``garment_edges`` is an array of edge names in the order top, bottom, left, right.
    """
    text = F.trim(base)
    start = F.when(text.isNull() | (text == ""), F.lit(vocab.DEFAULT_FILL_PROMPT)).otherwise(text)
    count = F.size(garment_edges)
    leading = F.array_join(F.slice(garment_edges, F.lit(1), F.greatest(count - 1, F.lit(0))), " ")
    edges = F.when(count == 1, F.get(garment_edges, F.lit(0))).otherwise(
        F.concat(leading, F.lit(" and "), F.get(garment_edges, count - 1))
    )
    noun = F.when(count > 1, F.lit(" edges ")).otherwise(F.lit(" edge "))
    clause = F.concat(F.lit(" except at the "), edges, noun, F.lit(vocab.GARMENT_FILL_CLAUSE))
    return F.when(count == 0, start).otherwise(F.concat(start, clause))


def fill_key(overflow: Column, prompt: Column) -> Column:
    """Cache kind of a generated background: whole-pixel padding plus a prompt fingerprint."""
    sides = [
        F.greatest(F.lit(0).cast("long"), js_round(overflow[side])).cast("string")
        for side in ("left", "top", "right", "bottom")
    ]
    finger = F.substring(F.sha2(F.coalesce(prompt, F.lit("")), 256), 1, 12)
    return F.concat_ws("_", F.lit("aiextend"), *sides, finger)


def dedupe_key(prefix: str, *parts: Column) -> Column:
    """``prefix:part:part``; null when a part is null, and a null key is never deduplicated."""
    pieces = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit(":"), part]
    return F.concat(*pieces)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Deterministic row id, so that a replayed job writes the same rows."""
    text = F.concat_ws("\x1f", *[F.coalesce(part, F.lit("\x00")) for part in parts])
    return F.concat(F.lit(prefix + "_"), F.sha2(text, 256))


def to_payload(**columns: Column) -> Column:
    return F.to_json(F.struct(*[column.alias(name) for name, column in columns.items()]))


def _fixed(value: Column, digits: int) -> Column:
    """``digits`` decimals of a value of at least zero, halves up by the exact binary value.

    The part below one is scaled by a power of two, which is exact, so the rest is whole-number arithmetic.
    """
    number = value.cast("double")
    part = F.floor((number - F.floor(number)) * 2.0**52).cast("bigint")
    count = F.floor(number) * 10**digits + F.shiftright(part * (2 * 10**digits) + F.lit(2**52), 53)
    if digits == 0:
        return count.cast("string")
    return F.concat(
        F.floor(count / 10**digits).cast("string"), F.lit("."), F.lpad((count % 10**digits).cast("string"), digits, "0"))


def format_bytes(size: Column) -> Column:
    kib, mib, gib = 1024, 1024**2, 1024**3
    return (
        F.when(size.isNull() | (size <= 0), "0 KB")
        .when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(js_round(size / kib).cast("string"), F.lit(" KB")))
        .when(size < gib, F.concat(_fixed(size / mib, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(size / gib, 2), F.lit(" GB")))
    )


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(js_round(ms).cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(_fixed(ms / 1000, 1), F.lit("s")))
        .otherwise(
            F.concat(
                F.floor(ms / 60_000).cast("string"), F.lit("m "),
                js_round((ms % 60_000) / 1000).cast("string"), F.lit("s"),
            )
        )
    )


def format_seconds(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 60, F.concat(js_round(seconds).cast("string"), F.lit("s")))
        .when(
            minutes < 60,
            F.concat(minutes.cast("string"), F.lit("m "), js_round(seconds % 60).cast("string"), F.lit("s")),
        )
        .otherwise(
            F.concat(
                F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")
            )
        )
    )


def percent(fraction: Column, digits: int = 0) -> Column:
    return F.concat(_fixed(fraction * 100, digits), F.lit("%"))


def humanize(value: Column) -> Column:
    spaced = F.translate(value, "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))


def elapsed_ms(start: Column, as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.unix_millis(start)


def time_ago(start: Column, as_of: Column) -> Column:
    """Relative age for report cells; older than a month shows the date."""
    seconds = F.greatest(F.lit(0).cast("long"), js_round(elapsed_ms(start, as_of) / 1000))
    minutes = js_round(seconds / 60)
    hours = js_round(minutes / 60)
    days = js_round(hours / 24)

    def plural(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(seconds < 45, "just now")
        .when(seconds < 90, "a minute ago")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours < 24, plural(hours, "hour"))
        .when(days < 30, plural(days, "day"))
        .otherwise(F.date_format(start, "yyyy-MM-dd"))
    )
