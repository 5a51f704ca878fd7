"""Packing of token runs into windows by Karmarkar-Karp multiway differencing.

A document gives whole windows and a rest shorter than one. Rests are cut in a large, a middle and a small part, so that
small parts can level the windows, and gathered in blocks of bounded size. Within a block, every part starts as a
partition of its own; the two partitions with the largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one partition with near-equal windows is left. If its fullest window exceeds the
capacity, the block gets one more window and starts again.
"""

from __future__ import annotations

import heapq
import zlib
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.common import running_totals
from framejobs.llm.tokens import encoder, slices_of
from framejobs.session import stored

BLOCK = 128  # rests packed together


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a document: whole windows, then the rest in at most three parts."""
    whole = total // capacity * capacity
    parts = [(s, capacity) for s in range(0, whole, capacity)]
    rest, start = total - whole, whole
    for _ in range(2):
        if rest >= 32:
            take = rest - rest // 3
            parts.append((start, take))
            start, rest = start + take, rest - take
    if rest:
        parts.append((start, rest))
    return parts


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items of each window after multiway differencing; ties go to the earlier partition.

    A partition is its filled windows as (minus sum, items), fullest first; the empty ones are implied. Fullest
    meets emptiest, so only the windows that both partitions need are added up.
    """
    heap = [(-size if windows > 1 else 0, i, [(-size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = max(0, windows - len(right))
        merged = left[:alone] + right[:max(0, windows - len(left))] + [
            (a[0] + right[windows - 1 - i][0], a[1] + right[windows - 1 - i][1]) for i, a in enumerate(left[alone:], alone)
        ]
        merged.sort(key=itemgetter(0))
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (spread, serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as near equal as differencing makes them."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return [w for w in packed if w]
        windows += 1


def token_parts(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``doc_tokens`` and ``parts`` (start, length, ids_crc32 and, if asked, the ids as little-endian u32)."""
    def run(batches):
        ids_of = encoder(vocabulary)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, stop in slices_of(texts):
                totals, starts, lengths, sums, kept = [], [], [], [], []
                for ids in ids_of.encode(texts[start:stop]):
                    raw = ids.tobytes() + int(end_id).to_bytes(4, "little")
                    totals.append(len(raw) // 4)
                    part = cuts(totals[-1], capacity)
                    pieces = [raw[4 * s:4 * (s + n)] for s, n in part]
                    starts.append([s for s, _ in part])
                    lengths.append([n for _, n in part])
                    sums.append(list(map(zlib.crc32, pieces)))
                    kept.append(pieces)
                out = {"doc_id": pdf["doc_id"].iloc[start:stop].to_numpy(), "doc_tokens": totals, "start": starts, "length": lengths, "ids_crc32": sums}
                yield pd.DataFrame(out | ({"ids": kept} if with_ids else {}))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    kinds = "start array<long>, length array<long>, ids_crc32 array<long>" + (", ids array<binary>" if with_ids else "")
    return rows.mapInPandas(run, f"doc_id long, doc_tokens long, {kinds}").select(
        "doc_id", "doc_tokens", F.arrays_zip(*names).alias("parts"))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every id, the end id of each document included, lies in exactly one piece; pieces of a sequence follow each other
    without a gap from offset 0, and a sequence holds ``capacity`` ids at most. A null or empty text is its end id
    alone. Rows that repeat a document are packed each. Sequence ids are unique, not dense. An empty
    table gives an empty result. Extra columns are ignored.
    """
    rows = stored(token_parts(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids))
    order = [F.xxhash64("doc_id", "doc_tokens"), "doc_id", "doc_tokens"]
    placed = running_totals(
        rows.withColumns({
            "whole": F.floor(F.col("doc_tokens") / capacity),
            "rest": F.when(F.col("doc_tokens") % capacity > 0, 1).otherwise(0),
        }),
        order, {"whole": "wholes", "rest": "place"},
    )
    pieces = stored(placed.select("doc_id", "doc_tokens", "wholes", "place", F.posexplode("parts").alias("index", "part")).select(
        "doc_id", "doc_tokens", "wholes", "place", "index", "part.*"))
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("wholes") + F.col("index")).withColumn(
        "offset", F.lit(0).cast("long"))
    first = rows.agg(F.coalesce(F.sum(F.floor(F.col("doc_tokens") / capacity)), F.lit(0))).head()[0]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    widest = 3 * block

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "start"]).reset_index(drop=True)
        sizes = pdf["length"].tolist()
        base = first + int(pdf["block"].iloc[0]) * widest
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for w, items in enumerate(pack_block(sizes, capacity)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = base + w, at
                at += sizes[i]
        return pdf.assign(sequence_id=sequence, offset=offset)[columns]

    parts = pieces.where(F.col("length") < capacity).withColumn("block", F.floor(F.col("place") / block))
    kinds = {"ids": "binary"}
    packed = parts.groupBy("block").applyInPandas(level, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns))
    return whole.select(*columns).union(packed)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed ``with_ids``: the ids of each window in order, as little-endian u32."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a window holds ``capacity`` ids at most
    return pieces.groupBy("sequence_id").agg(joined.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
