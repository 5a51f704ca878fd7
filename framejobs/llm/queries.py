"""Registered queries of the training-data operators and their SQL counterparts.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framejobs.llm import (
    line_dedup, mixing, packing, passages, preferences, quality_model, quality_rules, simhash, spelling, super_kmers, token_files,
    turn_repair, vector_dedup,
)
from framejobs.llm.common import prepare
from framejobs.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed collection."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


LINES_SQL = r"""
WITH t AS (
  SELECT md5(text) AS text_key, coalesce(doc_id, 9223372036854775807) AS doc_id, string_split(text, chr(10)) AS parts
  FROM documents WHERE text IS NOT NULL),
x AS (SELECT text_key, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM t),
k AS (SELECT text_key, doc_id, line_no, regexp_replace(line, '[0-9]+', '<*>', 'g') AS masked, regexp_extract_all(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS tokens FROM x),
l AS MATERIALIZED (
  SELECT text_key, line_no, min(doc_id) AS doc_id, any_value(tokens) AS tokens, any_value(masked) AS line_key,
         any_value(len(tokens) || ' ' || array_to_string(tokens[1:3], ' ')) AS leaf
  FROM k WHERE len(tokens) > 0 GROUP BY text_key, line_no),
d AS MATERIALIZED (SELECT line_key, leaf, any_value(tokens) AS tokens FROM l GROUP BY line_key, leaf),
f AS (SELECT leaf, count(*) AS leaf_lines FROM d GROUP BY leaf HAVING count(*) > 1),
r AS MATERIALIZED (
  SELECT line_key, leaf, leaf_lines, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM d JOIN f USING (leaf)),
s AS (SELECT leaf, place, token, count(*) AS support FROM r GROUP BY ALL),
m AS (SELECT line_key, place, token, support >= 2 AND support * 20 >= leaf_lines AS stays FROM r JOIN s USING (leaf, place, token)),
g AS (
  SELECT line_key, 'template ' || string_agg(CASE WHEN stays THEN token ELSE '<*>' END, ' ' ORDER BY place) AS template
  FROM m GROUP BY line_key HAVING count(*) FILTER (stays) >= count(*) * 0.75),
n AS MATERIALIZED (SELECT text_key, line_no, doc_id, len(tokens) AS n, coalesce(template, 'line ' || line_key) AS template FROM l LEFT JOIN g USING (line_key)),
o AS (
  SELECT template, min(ROW(doc_id, text_key)) AS first FROM (SELECT template, text_key, min(doc_id) AS doc_id, max(n) AS n FROM n GROUP BY template, text_key)
  GROUP BY template HAVING count(*) >= 3 OR (count(*) >= 2 AND max(n) >= 50)),
p AS (
  SELECT text_key, list(line_no) AS lines FROM n JOIN o USING (template) WHERE text_key <> first[2] GROUP BY text_key)
SELECT doc_id,
  CASE WHEN lines IS NULL THEN text ELSE
    array_to_string(list_filter(string_split(text, chr(10)), lambda v, i: NOT list_contains(lines, i - 1)), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(coalesce(len(lines), 0) AS INTEGER) AS n_dropped
FROM documents LEFT JOIN p ON md5(text) = text_key
"""

PREFERENCES_SQL = r"""
WITH l AS (SELECT conv_id, max(ROW(turn, text)) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT conv_id, last, row_number() OVER (ORDER BY conv_id NULLS LAST) AS i, count(*) OVER () AS n FROM l),
w AS (SELECT a.conv_id, a.last[1] AS last_turn, b.last[2] AS answer FROM p a JOIN p b ON b.i = a.i % a.n + 1),
j AS (SELECT c.*, w.last_turn, w.answer, c.turn IS NOT DISTINCT FROM w.last_turn AND c.role = 'assistant' AS swapped
  FROM conversations c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id),
s AS (
  SELECT conv_id, 'c' AS side, turn, role, text FROM j
  UNION ALL
  SELECT conv_id, 'r', turn, role, CASE WHEN swapped THEN answer ELSE text END FROM j WHERE turn < last_turn OR swapped),
n AS (SELECT conv_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS place FROM s),
c AS (
  SELECT conv_id, min(place) - 1 AS n_common FROM (
    SELECT conv_id, place FROM n GROUP BY conv_id, place HAVING count(*) < 2 OR min(ROW(role, text)) <> max(ROW(role, text))
    UNION ALL SELECT conv_id, max(place) + 1 FROM n GROUP BY conv_id) GROUP BY conv_id),
t AS (
  SELECT n.*, n_common, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' AS body
  FROM n JOIN c USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, side, place > n_common ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM t)
SELECT conv_id AS pair_id,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY place) FILTER (side = 'c' AND place <= n_common), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY place) FILTER (side = 'c' AND place > n_common), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY place) FILTER (side = 'r' AND place > n_common), '') AS rejected,
  coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY place) FILTER (side = 'c' AND place > n_common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY place) FILTER (side = 'r' AND place > n_common AND role = 'assistant'), '') AS rejected_spans,
  any_value(n_common) AS n_common
FROM o GROUP BY conv_id
"""

MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
lim AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 AS budget, CAST(sum(weight) AS BIGINT) AS weights FROM w),
-- Each round: the pace of sources that are not full at the pace before.
pace(n, p, filled) AS (
  SELECT 0, budget / weights, CAST(-1 AS BIGINT) FROM lim
  UNION ALL
  SELECT n + 1, (SELECT (budget - coalesce(sum(source_size * 2) FILTER (source_size * 2 <= weight * p), 0))
                   / nullif(sum(weight) FILTER (NOT source_size * 2 <= weight * p), 0) FROM w, lim GROUP BY budget),
         (SELECT count(*) FILTER (source_size * 2 <= weight * p) FROM w)
  FROM pace WHERE p IS NOT NULL AND n < 1000
    AND (SELECT count(*) FILTER (source_size * 2 <= weight * p) FROM w) > greatest(filled, 0)),
final AS (SELECT arg_max(p, n) AS p FROM pace WHERE p IS NOT NULL),
t AS (SELECT source, source_size,
        CASE WHEN source_size * 2 <= weight * p THEN CAST(source_size * 2 AS DOUBLE) ELSE weight * p END AS target FROM w, final),
o AS (SELECT d.*, epoch, md5(concat_ws(':', '1', CAST(epoch AS VARCHAR), CAST(doc_id AS VARCHAR), key)) AS turn,
        row_number() OVER (PARTITION BY doc_id, source, key, epoch) AS rep
      FROM d, (VALUES (0), (1)) e(epoch) WHERE size > 0),
f AS (SELECT o.*, sum(size) OVER (PARTITION BY o.source ORDER BY epoch, turn, doc_id, key, rep) / target AS finish
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source WHERE target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id, source NULLS FIRST, key, rep) - size AS mixed FROM f),
k AS (SELECT doc_id, source, key, rep, count(*) AS copies FROM m
      WHERE mixed < (SELECT sum(target) FROM t) - 0.5 GROUP BY ALL)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, key) AS rep FROM d) d
JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source AND d.key = k.key AND d.rep = k.rep
"""


SUBSTRINGS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, md5(coalesce(text, '')) AS key,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc, key, any_value(words) AS words FROM d GROUP BY doc, key),
s AS (SELECT doc, key, words, unnest(range(0, len(words) - 19)) AS start FROM u WHERE len(words) >= 20),
w AS MATERIALIZED (SELECT doc, key, start, md5(array_to_string(words[start + 1:start + 20], ' ')) AS win FROM s),
f AS (SELECT win, min(ROW(doc, start)) AS first FROM w GROUP BY win HAVING count(*) > 1),
g AS (SELECT doc, key, start FROM w JOIN f USING (win) WHERE ROW(doc, start) > first),
c AS (SELECT DISTINCT doc, key, start + o AS place FROM g, range(20) t(o)),
x AS (SELECT doc, key, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM u),
k AS (
  SELECT x.doc, x.key, count(c.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.place) FILTER (c.place IS NULL), '') AS kept
  FROM x LEFT JOIN c ON x.doc = c.doc AND x.key = c.key AND x.place = c.place GROUP BY x.doc, x.key)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc = k.doc AND d.key = k.key
"""


#: Production selection: the best of three grades with at least this chance.
GRADE, LEAST_CHANCE = 2, 0.4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_embedding_near_dedup")
def op1(spark, sf_dir):
    """Links and components of all vectors at cosine 0.95 or more."""
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op2_line_dedup", LINES_SQL)
def op2(spark, sf_dir):
    """Every document without the lines whose template recurs across documents."""
    return line_dedup.drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    """Fingerprint and component of every document, at 4 or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op4_source_mixing", MIXING_SQL)
def op4(spark, sf_dir):
    """Words each document gives to a mix of 150 % of all words at source weights 3, 1, 2."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_window_packing")
def op6(spark, sf_dir):
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 0)


@query("op10_token_files")
def op10(spark, sf_dir):
    """Documents read back from files of directly addressable token codes."""
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), 1)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    """Expected grade and chance of the best grade of every document, with the selection."""
    docs = documents(spark, sf_dir)
    model = quality_model.train(docs, quality_model.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality_model.rate(docs, model, GRADE, LEAST_CHANCE).select("doc_id", "expected_grade", "tail_probability", "selected")


@query("op7_quality_rules")
def op7(spark, sf_dir):
    """Counts of every text and the verdict of the line labelling."""
    docs = documents(spark, sf_dir)
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("grade"))
    return quality_rules.judge(docs, quality_rules.train(docs, ratings))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    """Passages of 50 words or more of every document that stand elsewhere too."""
    return passages.repeated_passages(documents(spark, sf_dir))


@query("op9_preference_format", PREFERENCES_SQL)
def op9(spark, sf_dir):
    """Prompt and masked completions of every conversation against one with another answer; spans as start-stop lists."""
    chosen, rejected = preferences.answer_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return preferences.format_pairs(chosen, rejected).withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


@query("op11_substring_dedup", SUBSTRINGS_SQL)
def op11(spark, sf_dir):
    """Every document without the words of windows of 20 words that start earlier too."""
    return super_kmers.remove_repeats(documents(spark, sf_dir))


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    return turn_repair.repair(turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    """Every word with its near words and the form it is a variant of."""
    return spelling.variants(documents(spark, sf_dir))
