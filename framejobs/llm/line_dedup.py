"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: lines part by their number of tokens, then by their leading tokens. Runs of digits are a
variable field from the start. Within a leaf, a token stays in the template if enough of the leaf's distinct lines have
it at that position, and becomes a variable field otherwise; a line too few of whose tokens stay is a
template of its own. Templates that recur across documents of different text are dropped, but for the lines of the
document that has them first, so no content is lost. Copies of one text count as one document.

Everything is a grouping with partial aggregates over narrow rows: a common line, leaf or text is combined before it is
shuffled, and tokens are looked at only in leaves with two lines or more.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from framejobs.llm.common import WORD, release
from framejobs.session import stored

FIELD = "<*>"
BLANK = r"[\x20\x09-\x0D]"


def _masked_lines(text: Column) -> Column:
    """The lines of a text with their digits generalised, which is done once for the whole text."""
    return F.split(F.regexp_replace(text, "[0-9]+", FIELD), "\n")


#: Key columns of a line, a leaf of the tree, a template: 128 bits each, as two numbers.
LINE, LEAF, TEMPLATE = ["l1", "l2"], ["f1", "f2"], ["t1", "t2"]


def _key(names: list[str], *columns) -> list[Column]:
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(7), *columns).alias(names[1])]


def _line_rows(texts: DataFrame, depth: int) -> DataFrame:
    """One row per line with a word: text key, id, line number, tokens, line key and leaf. Only the leading tokens are taken
    apart here; a line of fewer is its own leaf. Where a text has single blanks alone between words, tokens are counted
    by their blanks, and by their pattern elsewhere."""
    odd = reduce(or_, [F.contains("text", F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    # Settled before the lines part, or every line would search its whole text.
    split = texts.select("text_key", "doc_id", odd.alias("odd"), _masked_lines(F.col("text")).alias("lines"))
    lines = split.select("text_key", "doc_id", "odd", F.posexplode_outer("lines").alias("line_no", "line"))  # a split has a part at least
    plain = ~F.col("odd") & ~F.startswith("line", F.lit(" ")) & ~F.endswith("line", F.lit(" ")) & (F.col("line") != "")
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    rows = lines.withColumn("plain", plain).withColumn(
        "n", F.when(F.col("plain"), blanks + 1).otherwise(F.regexp_count("line", F.lit(WORD)))).where("n > 0")
    lead = F.regexp_replace(F.regexp_extract("line", rf"^{BLANK}*({WORD}(?:{BLANK}+{WORD}){{0,{depth - 1}}})", 1), f"{BLANK}+", " ")
    lead = F.when(F.col("plain"), F.substring_index("line", " ", depth)).otherwise(lead)
    return rows.select("text_key", "doc_id", "line_no", "n", *_key(LINE, "line"), *_key(LEAF, "n", lead))


def line_templates(texts: DataFrame, lines: DataFrame, share: int, constant: float) -> DataFrame:
    """(line key, template) for the lines that share their leaf with others and keep enough tokens.

    ``share``: a token stays if at least two and one in ``share`` of the leaf's distinct lines have it there.
    """
    distinct = stored(lines.groupBy(*LINE, *LEAF).agg(F.min(F.struct("text_key", "doc_id", "line_no")).alias("at")))
    leaves = stored(distinct.groupBy(*LEAF).agg(F.count(F.lit(1)).alias("leaf_lines")).where("leaf_lines > 1"))
    wanted = stored(
        distinct.join(leaves, LEAF).select("at.text_key", "at.doc_id", F.struct("at.line_no", *LINE, *LEAF, "leaf_lines").alias("of"))
        .groupBy("text_key", "doc_id").agg(F.collect_list("of").alias("wanted"))  # at most the lines of one text
    )
    release(distinct)
    release(leaves)
    # The tokens of one occurrence of each such line, read again from its text: of copies, the one with the smallest id.
    once = texts.join(wanted, ["text_key", "doc_id"])
    if texts.groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        once = once.dropDuplicates(["text_key"])  # rows that repeat a document
    picked = F.transform("wanted", lambda of: F.struct(
        F.get(F.col("parts"), of["line_no"]).alias("line"), *[of[c].alias(c) for c in (*LINE, *LEAF, "leaf_lines")]))
    rows = stored(
        once.select(_masked_lines(F.col("text")).alias("parts"), "wanted").select(F.explode(picked).alias("of"))
        .select(*[f"of.{c}" for c in (*LINE, *LEAF, "leaf_lines")], F.posexplode(F.regexp_extract_all("of.line", F.lit(f"({WORD})"), 1)).alias("place", "token"))
    )
    release(wanted)
    support = stored(rows.groupBy(*LEAF, "place", "token").agg(F.count(F.lit(1)).alias("support")).where("support > 1"))
    stays = F.coalesce(F.col("support") * share >= F.col("leaf_lines"), F.lit(False))
    marked = rows.join(support, [*LEAF, "place", "token"], "left").select(
        *LINE, F.when(stays, F.col("token")).otherwise(F.lit(FIELD)).alias("token"), "place", stays.cast("int").alias("stays"))
    # A template is told by its tokens and their places, in whatever order they are met.
    whole = marked.groupBy(*LINE).agg(
        F.bit_xor(F.xxhash64("place", "token")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "place", "token")).alias("x2"),
        F.sum("stays").alias("stays"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("stays") >= F.col("n") * constant)
    found = stored(whole.select(*LINE, *_key(TEMPLATE, F.lit("template"), "n", "x1", "x2")))
    release(rows)
    release(support)
    return found


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least_documents: int = 3,
    long_line: int = 50, share: int = 20, constant: float = 0.75,
) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_lines``, ``n_dropped``.

    A line with a word goes if its template occurs in at least ``least_documents`` different texts, or in two if it has
    ``long_line`` tokens or more, and another text has it first (by smallest id, then text hash). Blank lines stay. A null text
    stays null with 0 lines; an empty one is one empty line. Rows of equal text are treated alike and all returned; a
    null id comes after every other. Columns ``n_lines`` and ``n_dropped`` of ``docs`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked = docs.withColumn("__key", F.unhex(F.md5(F.col(text_col))))
    texts = marked.where(F.col(text_col).isNotNull()).select(
        F.col("__key").alias("text_key"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.col(text_col).alias("text"))
    lines = stored(
        _line_rows(texts, depth)
        .groupBy("text_key", "line_no", *LINE, *LEAF, "n").agg(F.min("doc_id").alias("doc_id"))
    )
    templates = line_templates(texts, lines, share, constant)
    named = stored(lines.join(templates, LINE, "left").select(
        "text_key", "line_no", "doc_id", "n", *[F.coalesce(t, l).alias(t) for t, l in zip(TEMPLATE, LINE)]))
    release(lines)
    release(templates)
    per_text = named.groupBy(*TEMPLATE, "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    enough = (F.col("texts") >= least_documents) | ((F.col("texts") >= 2) & (F.col("n") >= long_line))
    recurring = stored(
        per_text.groupBy(*TEMPLATE).agg(
            F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("first"))
        .where(enough).select(*TEMPLATE, F.col("first.text_key").alias("owner"))
    )
    dropped = stored(
        named.join(recurring, TEMPLATE).where(F.col("text_key") != F.col("owner"))
        .groupBy("text_key").agg(F.collect_list("line_no").alias("lines"))  # at most the lines of one text
        .select(F.col("text_key").alias("__key"), F.col("lines").alias("__lines"))
    )
    release(named)
    release(recurring)
    split = F.split(F.col(text_col), "\n")
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    total = F.coalesce((breaks + 1).cast("int"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__lines"))
    clean = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda i: F.get(split, i))))
    return marked.join(dropped, "__key", "left").select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in columns],
        total.alias("n_lines"), F.coalesce(F.size("__lines"), F.lit(0)).alias("n_dropped"),
    )
