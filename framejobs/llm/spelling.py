"""Spelling variants by PartEnum signatures over letter multisets.

A word is a binary vector with one place for each letter and count: "eel" has (e, 1), (e, 2), (l, 1). One inserted, deleted
or replaced letter changes at most two places. The places are dealt into ``parts`` parts; of two vectors that differ
in at most two places, at least ``parts - 2`` parts agree. Each word therefore enumerates the choices of ``parts - 2`` parts, and
two words one edit apart share the signature of one choice at least: an exact search by equality alone.

Anagrams of frequent letters share signatures in great number, so a signature also carries a half of the word. An edit leaves
its first or its last ``n // 2`` letters as they were, ``n`` the shorter length; a word has the keys of its own length and of one
less. A signature with more than ``bucket`` words is cut finer by the words with one letter taken out, of which two words one
edit apart share one: still exact, and no group is compared whole. Signatures are joined on their hashes and every pair is
verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from framejobs.llm.common import release
from framejobs.session import stored

RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words a task adds up before it passes them on, and texts it takes out of a batch at a time.
HELD, TEXTS = 100_000, 256


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, every: int = 199) -> DataFrame:
    """``(word, n)``, partly added up: the runs of letters of whole texts, A-Z lower-cased. A run whose checksum with
    its document's id is a multiple of ``every`` loses one letter, the same wherever it stands in that document. A
    null id counts as an empty one."""
    def flush(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())

    def run(batches):
        found: Counter = Counter()
        for doc_id, text in rows(batches):
            if not text:
                continue
            start = zlib.crc32(f"{doc_id or ''}:".encode())
            for word, n in Counter(RUN.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
                if len(word) < least_letters:
                    continue
                h = zlib.crc32(word.encode("utf-8"), start)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < least_letters:
                        continue
                found[word] += n
            if len(found) > HELD:
                yield flush(found)
                found = Counter()
        yield flush(found)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """``(word, n)`` of all words with enough letters and occurrences."""
    return occurrences(docs, id_col, text_col, least_letters, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def signatures(word: str, parts: int) -> list[str]:
    """Every choice of ``parts - 2`` parts of the word's places with each half it may share."""
    dealt: list[list[str]] = [[] for _ in range(parts)]
    before, times = "", 0
    for letter in sorted(word):
        times = times + 1 if letter == before else 0
        before = letter
        dealt[(ord(letter) + times) % parts].append(letter)
    pieces = ["".join(d) for d in dealt]
    length, halves = len(word), set()
    for half in {length // 2, (length - 1) // 2}:
        halves |= {f"<{word[:half]}", f">{word[length - half:]}"}
    return [
        f"{'/'.join(map(str, chosen))}:{'/'.join(pieces[p] for p in chosen)}:{half}"
        for chosen in combinations(range(parts), parts - 2) for half in halves
    ]


def shorter(word: str) -> set[str]:
    """The word and every word with one letter less."""
    return {word} | {word[:i] + word[i + 1:] for i in range(len(word))}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8")) - (1 << 63)


def _keys(parts: int):
    def run(batches):
        for pdf in batches:
            keys = [[_hash(s) for s in signatures(w, parts)] for w in pdf["word"]]
            counts = [len(k) for k in keys]
            yield pd.DataFrame({
                "word": np.repeat(pdf["word"].to_numpy(), counts), "n": np.repeat(pdf["n"].to_numpy(), counts),
                "key": np.array([k for ks in keys for k in ks], dtype=np.int64)})

    return run


def _finer(pdf_batches):
    for pdf in pdf_batches:
        keys = [[_hash(f"{k}:{s}") for s in shorter(w)] for w, k in zip(pdf["word"], pdf["key"])]
        counts = [len(k) for k in keys]
        yield pd.DataFrame({
            "word": np.repeat(pdf["word"].to_numpy(), counts), "n": np.repeat(pdf["n"].to_numpy(), counts),
            "key": np.array([k for ks in keys for k in ks], dtype=np.int64)})


def near_pairs(counted: DataFrame, parts: int = 4, bucket: int = 256) -> DataFrame:
    """``(a, a_n, b, b_n)``, a before b: all pairs of ``counted(word, n)``, each word once, at edit distance one."""
    shape = "word string, n long, key long"
    sized = stored(counted.mapInPandas(_keys(parts), shape).withColumn(
        "size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1"))
    rows = stored(sized.where(F.col("size") <= bucket).drop("size").union(
        sized.where(F.col("size") > bucket).drop("size").mapInPandas(_finer, shape)))
    a = rows.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = F.abs(F.length("a") - F.length("b"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (apart <= 1) & (F.levenshtein("a", "b", 1) == 1)).drop("key").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: the end of each chain, by doubling the steps. Counts grow along a chain, so it
    has no circle and its length is the logarithm of the largest count at most."""
    ends = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(ends)
        ends = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return ends


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least: int = 5, every: int = 199,
    ratio: int = 5, parts: int = 4, bucket: int = 256,
) -> DataFrame:
    """One row per word of the corpus: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are near at one inserted, deleted or replaced code point. ``form`` is the near word of largest ``n``, of equal ones the
    first in code-point order, if it occurs at least ``ratio`` times as often; ``root`` follows forms to the last. Whole texts
    are read; null and empty ones have no word; rows that repeat a document count as often as they stand; a null id counts as
    an empty one. An empty table gives an empty result; extra columns are ignored.
    """
    counted = stored(words(docs, id_col, text_col, least_letters, least, every))
    pairs = stored(near_pairs(counted, parts, bucket))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    known = stored(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
