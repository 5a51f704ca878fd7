"""Repeated passages by windows at minimisers.

Every window of ``least_words`` words belongs to its minimiser: of the word shingles in it, the leftmost with the smallest
hash. Which one that is depends on the words alone, so equal windows bring equal minimisers at equal places within them. A
window whose minimiser shingle is unique in the corpus cannot repeat and goes at once, which leaves few.

Each of the others is one row, keyed by its minimiser and a hash of all its words. Keys are counted with partial aggregates
and windows whose key recurs are repeats: exact, for every split of a window around its minimiser, however many partners a
passage has. Windows that overlap or touch are one passage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.mixing import word_count
from framejobs.session import stored

SHINGLE = 8
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, by differences of one running polynomial."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(BASE, len(values)), dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * _powers(BACK, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end byte of every word of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = np.concatenate([[True], SPACE[raw], [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    return _ranges(raw.astype(np.uint64) + np.uint64(1), starts, ends), starts, ends


def minimisers(words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and shingle hashes of the minimisers: leftmost smallest shingle of each run of ``span``."""
    n = len(words) - SHINGLE + 1
    if n < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    grams = _ranges(words, at, at + SHINGLE)
    best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n - span + 1)
    chosen = np.unique(best)
    return chosen, grams[chosen]


def windows(words: np.ndarray, places: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows whose minimiser stands at one of ``places``, the minimisers' shingle hashes and the windows' hashes."""
    n = len(words) - SHINGLE + 1
    span = least_words - SHINGLE + 1
    at = np.arange(n)
    grams = _ranges(words, at, at + SHINGLE)
    best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n - span + 1)
    wanted = np.zeros(n, dtype=bool)
    wanted[places] = True
    starts = np.flatnonzero(wanted[best])
    return starts, grams[best[starts]], _ranges(words, starts, starts + least_words)


def _merged(starts: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Passages covered by windows that begin at ``starts``."""
    starts = np.sort(np.asarray(starts, dtype=np.int64))
    gaps = np.flatnonzero(np.diff(starts) > least_words)
    first = starts[np.concatenate([[0], gaps + 1])]
    last = starts[np.concatenate([gaps, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + least_words).tolist()))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_repeated`` words inside passages of at least ``least_words``
    words that stand elsewhere too, and ``spans`` of those passages (first word, end word).

    Passages repeat across rows or within one; windows are compared by a 64-bit hash of all their words behind an equal 64-bit
    hash of eight of them. Whole texts are read. Null and empty texts have no word and no span. Texts that several rows
    share, repeated rows included, are looked at once and repeat as a whole. An empty table gives an empty result. Extra
    columns are ignored.
    """
    span = least_words - SHINGLE + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text", F.length("text")))

    def mark(batches):
        for pdf in batches:
            found = [minimisers(word_hashes(t)[0], span) for t in pdf["text"]]
            yield pd.DataFrame({
                "text_key": np.repeat(pdf["text_key"].to_numpy(), [len(at) for at, _ in found]),
                "place": np.concatenate([at for at, _ in found]).astype(np.int64),
                "gram": np.concatenate([gram for _, gram in found]).view(np.int64),
            })

    def keys(batches):
        for pdf in batches:
            found = [windows(word_hashes(t)[0], np.asarray(places, dtype=np.int64), least_words) for t, places in zip(pdf["text"], pdf["places"])]
            yield pd.DataFrame({
                "text_key": np.repeat(pdf["text_key"].to_numpy(), [len(starts) for starts, _, _ in found]),
                "start": np.concatenate([starts for starts, _, _ in found]).astype(np.int32),
                "gram": np.concatenate([grams for _, grams, _ in found]).view(np.int64),
                "whole": np.concatenate([whole for _, _, whole in found]).view(np.int64),
            })

    ids = keyed.where("text is not null").groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = stored(ids.groupBy("text_key").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "n")).alias("of")).select("text_key", "copies", "of.*"))
    sites = stored(keyed.where("text is not null").mapInPandas(mark, "text_key long, place long, gram long").distinct())
    often = stored(sites.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    anchors = stored(
        sites.join(often, "gram").groupBy("text_key").agg(F.sort_array(F.collect_list("place")).alias("places"))  # of one text
        .join(texts, "text_key")
    )
    once = keyed.select("text_key", F.col("doc_id").alias("__id"), "text").join(anchors, "text_key").where(F.col("__id").eqNullSafe(F.col("doc_id")))
    if anchors.where("n > 1").limit(1).count():  # rows that repeat a document
        once = once.dropDuplicates(["text_key"])
    placed = stored(once.select("text_key", "text", "places").mapInPandas(keys, "text_key long, start int, gram long, whole long"))
    again = stored(placed.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "whole"))

    def merge(batches):
        for pdf in batches:
            merged = [_merged(s, least_words) for s in pdf["starts"]]
            yield pd.DataFrame({
                "text_key": pdf["text_key"], "n_repeated": [sum(b - a for a, b in m) for m in merged],
                "spans": [[{"start": a, "stop": b} for a, b in m] for m in merged],
            })

    kind = "array<struct<start:long,stop:long>>"
    of_text = stored(
        placed.join(again, ["gram", "whole"]).groupBy("text_key").agg(F.collect_list("start").alias("starts"))  # of one text
        .mapInPandas(merge, f"text_key long, n_repeated long, spans {kind}")
    )
    copied = stored(texts.where("copies > 1").select("text_key", F.lit(True).alias("copied")))
    counted = keyed.select("doc_id", "text_key", word_count("text").alias("n_words"))
    whole = F.col("copied") & (F.col("n_words") >= least_words)
    return counted.join(of_text, "text_key", "left").join(copied, "text_key", "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"))))
        .otherwise(F.coalesce("spans", F.array().cast(kind))).alias("spans"),
    )
