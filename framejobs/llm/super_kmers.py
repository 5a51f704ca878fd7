"""Substring dedup by super-k-mers: repeated windows of words are removed but for their first occurrence.

Every window of ``window`` words belongs to its minimiser, the leftmost of its word shingles with the smallest hash. Which
one that is depends on the words alone, so equal windows belong to equal minimisers. Consecutive windows that share one
overlap almost wholly and travel as one packed string, a super-k-mer, to the minimiser's bucket. There the windows are taken
apart and sorted, and each run of equal ones names its first occurrence.

Three things keep the traffic small: a minimiser that occurs once in the corpus cannot belong to a repeated window, so its
super-k-mers never travel; equal packed strings are one row with the first of their places, as all their windows repeat
together; and copies of a text are one text. A bucket with more than ``bucket`` different strings is not sorted in one
task: its windows become rows of their own, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.common import release, shuffle_partitions
from framejobs.llm.passages import SHINGLE, _ranges, minimisers, word_hashes
from framejobs.llm.tokens import slices_of
from framejobs.session import stored

#: Place of a null id in the order of documents: after every other.
LAST = 2**63 - 1


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").split() if text else []


def super_kmers(text: str, places: np.ndarray, window: int) -> list[tuple[int, int, int, str]]:
    """``(first word, windows, minimiser, packed words)`` of each run of windows whose minimiser stands at one of ``places``."""
    words, hashes = _words(text), word_hashes(text)[0]
    at = np.arange(len(hashes) - SHINGLE + 1)
    grams = _ranges(hashes, at, at + SHINGLE)
    span = window - SHINGLE + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
    wanted = np.zeros(len(grams), dtype=bool)
    wanted[places[places < len(grams)]] = True
    # A minimiser owns one run of windows: the leftmost smallest shingle of a sliding range never comes back.
    cuts = np.flatnonzero(np.diff(best)) + 1
    first, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(best)]])
    use = wanted[best[first]]
    first, stop = first[use], stop[use]
    signed = grams.view(np.int64)
    return [
        (s, e - s, g, b" ".join(words[s:e - 1 + window]).decode("utf-8"))
        for s, e, g in zip(first.tolist(), stop.tolist(), signed[best[first]].tolist())
    ]


def repeated_in_buckets(window: int):
    """Sort the windows of each bucket of a partition sorted by ``gram``; yields the strings some of whose windows occur
    earlier, with those windows as a bit mask."""
    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for number, (gram, doc, start, n, packed) in enumerate(zip(
                pdf["gram"].tolist(), pdf["doc"].tolist(), pdf["start"].tolist(), pdf["n"].tolist(), pdf["packed"].tolist())):
            words = packed.split(" ")
            rows += [(gram, words[o:o + window], doc, start + o, number, o) for o in range(n)]
        rows.sort()
        masks = np.zeros(len(pdf), dtype=np.int64)
        for before, row in zip(rows, rows[1:]):
            if row[1] == before[1] and row[0] == before[0]:
                masks[row[4]] |= 1 << row[5]
        hit = np.flatnonzero(masks)
        return pdf.iloc[hit][["p1", "p2"]].assign(mask=masks[hit])

    def run(batches):
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            cut = int(np.searchsorted(pdf["gram"].to_numpy(), pdf["gram"].iloc[-1])) if len(pdf) else 0
            if cut:
                yield marked(pdf.iloc[:cut])
            rest = pdf.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield marked(rest)

    return run


def repeated_in_large_buckets(strings: DataFrame, window: int) -> DataFrame:
    """The same for buckets too large for one task: every window is a row, and its first place an aggregate."""
    parts = F.split("packed", " ")
    windows = stored(strings.select(
        "p1", "p2", "gram", "doc", "start",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.array_join(F.slice(parts, o + 1, window), " "))).alias("o", "words"),
    ).withColumn("place", F.struct("doc", (F.col("start") + F.col("o")).alias("at"))))
    firsts = stored(windows.groupBy("gram", "words").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    return windows.join(firsts.drop("times"), ["gram", "words"]).where(F.col("place") > F.col("first")).groupBy("p1", "p2").agg(
        F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))


def _covered(starts: list[int], masks: list[int], window: int, n_words: int) -> np.ndarray:
    """Which words the removed windows cover."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    for start, mask in zip(starts, masks):
        for o in range(mask.bit_length()):
            if mask >> o & 1:
                edges[start + o] += 1
                edges[start + o + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def _slices(batches):
    """Batches cut to about two million characters, so that the words of few texts are in memory at once."""
    for pdf in batches:
        for start, stop in slices_of(pdf["text"].tolist()):
            yield pdf.iloc[start:stop]


def _profiles(window: int):
    """Word count, digest of all words and minimisers of each text."""
    def run(batches):
        for pdf in _slices(batches):
            n_words, whole, places, grams = [], [], [], []
            for text in pdf["text"]:
                words = _words(text)
                at, gram = minimisers(word_hashes(text)[0], window - SHINGLE + 1)
                n_words.append(len(words))
                whole.append(digest(words))
                places.append(at.astype(np.int32))
                grams.append(gram.view(np.int64))
            yield pdf[["doc", "doc_id", "k1", "k2"]].assign(n_words=n_words, whole=whole, places=places, grams=grams)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, bucket: int = 4096, with_text: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, with ``with_text`` also ``kept_text``.

    A word goes if a window of ``window`` words covers it that also starts earlier, in a smaller id or before it in the same
    document. ``kept_sha256`` is over the other words joined by one blank. Exact on words; strings and texts are told
    apart by 128-bit keys. Null and empty texts have no word; texts shorter than a window keep all. A null id comes
    after every other; rows of one id are one document, of which only an earlier start counts, so rows that repeat a
    document are treated alike and all returned. An empty table gives an empty result; extra columns are ignored.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).alias("text"),
    ).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    profiles = stored(keyed.mapInPandas(
        _profiles(window), "doc long, doc_id long, k1 long, k2 long, n_words long, whole string, places array<int>, grams array<long>"))
    texts = stored(profiles.groupBy("k1", "k2").agg(
        F.min("doc").alias("first_doc"), F.any_value("places").alias("places"), F.any_value("grams").alias("grams")))
    rows = stored(profiles.select("doc", "doc_id", "k1", "k2", "n_words", "whole"))
    firsts = stored(texts.select("k1", "k2", "first_doc"))
    release(profiles)
    sites = texts.select("k1", "k2", F.explode(F.arrays_zip("places", "grams")).alias("at")).select(
        "k1", "k2", F.col("at.places").alias("place"), F.col("at.grams").alias("gram"))
    often = stored(sites.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram"))
    anchors = stored(sites.join(often, "gram").groupBy("k1", "k2").agg(F.collect_list("place").alias("places")).join(firsts, ["k1", "k2"]))  # of one text
    release(texts)
    release(often)

    def cut(batches):
        for pdf in _slices(batches):
            found = [super_kmers(t, np.asarray(p, dtype=np.int64), window) for t, p in zip(pdf["text"], pdf["places"])]
            flat = [r for rows in found for r in rows]
            counts = [len(rows) for rows in found]
            out = pd.DataFrame(flat, columns=["start", "n", "gram", "packed"])
            for name in ("k1", "k2", "doc"):
                out[name] = np.repeat(pdf[name].to_numpy(), counts)
            yield out

    def first_rows(side: DataFrame) -> DataFrame:
        """The text of each key of ``side``, from one row of its first document."""
        rows = keyed.select("k1", "k2", "doc", "text").join(side, ["k1", "k2"])
        return rows.where(F.col("doc") == F.col("first_doc")).dropDuplicates(["k1", "k2"])

    occurrences = stored(
        first_rows(anchors).mapInPandas(cut, "k1 long, k2 long, doc long, start int, n int, gram long, packed string")
        .withColumns({"p1": F.xxhash64("packed"), "p2": F.xxhash64(F.lit(7), "packed")})
    )
    release(anchors)
    strings = stored(
        occurrences.groupBy("gram", "p1", "p2").agg(
            F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times"),
            F.any_value("n").alias("n"), F.any_value("packed").alias("packed"))
        .select("gram", "p1", "p2", "first.doc", "first.start", "times", "n", "packed")
    )
    sizes = stored(strings.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = strings.join(sizes, "gram")
    in_order = shared.where(F.col("size") <= bucket).select("gram", "p1", "p2", "doc", "start", "n", "packed")
    masks = stored(
        in_order.repartition(shuffle_partitions(docs), "gram").sortWithinPartitions("gram")
        .mapInPandas(repeated_in_buckets(window), "p1 long, p2 long, mask long")
        .union(repeated_in_large_buckets(shared.where(F.col("size") > bucket), window))
    )
    # Stored, so that the join below is a plain one of two tables and a string with very many places can be split.
    marked = stored(strings.select("p1", "p2", "times", F.col("doc").alias("of_doc"), F.col("start").alias("of_start")).join(
        masks, ["p1", "p2"], "left").where("times > 1 or mask is not null"))
    for done in (strings, sizes, masks):
        release(done)
    is_first = (F.col("doc") == F.col("of_doc")) & (F.col("start") == F.col("of_start"))
    every = F.expr("shiftleft(1L, n) - 1")
    removed = stored(
        occurrences.select("k1", "k2", "doc", "start", "n", "p1", "p2").join(marked, ["p1", "p2"])
        .withColumn("mask", F.when(is_first, F.coalesce("mask", F.lit(0))).otherwise(every)).where("mask > 0")
        .groupBy("k1", "k2", F.col("doc").alias("first_doc"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))  # of one text
    )
    release(occurrences)
    release(marked)

    def edit(batches):
        for pdf in _slices(batches):
            words = [_words(t) for t in pdf["text"]]
            gone = [_covered(s, m, window, len(w)) for s, m, w in zip(pdf["starts"], [[int(x) for x in m] for m in pdf["masks"]], words)]
            kept = [[w for w, g in zip(ws, gs.tolist()) if not g] for ws, gs in zip(words, gone)]
            out = pdf[["k1", "k2"]].assign(n_gone=[int(g.sum()) for g in gone], rest=[digest(k) for k in kept])
            if with_text:
                out["kept_text"] = [b" ".join(k).decode("utf-8") for k in kept]
            yield out

    text_column = ", kept_text string" if with_text else ""
    edited = first_rows(removed).mapInPandas(edit, f"k1 long, k2 long, n_gone long, rest string{text_column}")
    if with_text:  # the words of documents that keep all of them
        own = F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), " ")
        rows = keyed.select("k1", "k2", "doc", "doc_id", F.coalesce(own, F.lit("")).alias("own")).join(
            rows.drop("doc", "doc_id").dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    copy = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= window)
    result = rows.join(firsts, ["k1", "k2"]).join(edited, ["k1", "k2"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(digest([]))).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", "own")).alias("kept_text")] if with_text else []),
    )
    return result
