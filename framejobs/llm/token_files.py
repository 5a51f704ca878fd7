"""Token files of directly addressable codes.

A shard holds the ids of a run of documents. Its ids are cut into 8-bit chunks, lowest first: level k stores the k-th
chunk of every id that has one, and a bitmap says for each id of the level whether it goes on to the next. A rank
directory counts the ones before every 512 bits, so the place of an id in the next level is one lookup and one short
count. Any token is read without decoding a block.

Byte layout of a shard, little-endian: ``DAC1``; levels u32; documents u32; ids u64; document ids, i64 each; a null
bitmap of the document ids; document ends (ids up to and including each document), u64 each; then for every level:
ids u64, chunks (1 byte each), bitmap bytes padded to whole 64-byte groups, and one u64 per group with the ones before it.

Shards are written through Spark's Parquet writer, one binary value per row: its commit protocol survives lost executors
and it reaches every store Spark reaches. A value is a complete file of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.common import running_totals, shuffle_partitions, spread_join
from framejobs.llm.tokens import encoder, slices_of
from framejobs.session import stored

MAGIC = b"DAC1"
GROUP = 64  # bytes of a bitmap for each entry of its rank directory
SHARD_IDS = 2 << 20


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, dtype=np.uint32)
    levels = []
    rest = ids
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % GROUP, dtype=np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, GROUP).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ones, dtype=np.uint64)])[: len(ones)]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    absent = np.packbits(np.array([d is None for d in doc_ids], dtype=bool), bitorder="little").tobytes()
    head = MAGIC + struct.pack("<IIQ", len(levels), len(doc_ids), len(ids))
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    return b"".join([head, names, absent, np.cumsum(lengths, dtype=np.uint64).astype("<u8").tobytes(), *levels])


class Shard:
    """Reader of one shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        count, docs, self.size = struct.unpack_from("<IIQ", data, 4)
        at = 20
        names = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        absent = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs, bitorder="little")
        at += -(-docs // 8)
        self.doc_ids = [None if a else int(n) for n, a in zip(names, absent)]
        self.ends = np.frombuffer(data, "<u8", docs, at)
        at += 8 * docs
        self.levels = []
        for _ in range(count):
            n = struct.unpack_from("<Q", data, at)[0]
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            width = -(-(-(-n // 8)) // GROUP) * GROUP
            bits = np.frombuffer(data, np.uint8, width, at)
            ranks = np.frombuffer(data, "<u8", width // GROUP, at + width)
            at += width + 8 * (width // GROUP)
            self.levels.append((chunks, bits, ranks))

    def token(self, place: int) -> int:
        """The id at one place, by following its chunks."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * depth)
            byte, bit = divmod(place, 8)
            if not bits[byte] >> bit & 1:
                break
            group = byte // GROUP
            before = int(np.bitwise_count(bits[group * GROUP:byte]).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
            place = int(ranks[group]) + before
        return value

    def all_ids(self) -> np.ndarray:
        value = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype("<u4")
            if value is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= value << 8
            value = here
        return value

    def document(self, index: int) -> np.ndarray:
        """Ids of one document of the shard, read by address."""
        start = int(self.ends[index - 1]) if index else 0
        return np.array([self.token(p) for p in range(start, int(self.ends[index]))], dtype="<u4")


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards to ``path`` in ascending id order.

    Rows are range partitioned on (id, hash of the text) before encoding, so each task writes a run of the order in shards of about
    ``shard_ids`` ids; a longer document is a shard of its own. Null texts are empty, null ids come first, rows of
    one id follow each other in the order of that hash, an empty table writes no shard. Extra columns are ignored.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange(shuffle_partitions(docs), *order[:2]).sortWithinPartitions(*order).withColumn(
        "row", F.monotonically_increasing_id())

    def shards(batches):
        ids_of = encoder(vocabulary)
        names, pieces, total, first = [], [], 0, None
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, stop in slices_of(texts):
                coded = ids_of.encode(texts[start:stop])
                for doc, row, ids in zip(pdf["doc_id"].iloc[start:stop], pdf["row"].iloc[start:stop], coded):
                    if first is None:
                        first = int(row)
                    names.append(None if pd.isna(doc) else int(doc))
                    pieces.append(np.append(ids, np.uint32(end_id)))
                    total += len(pieces[-1])
                    if total >= shard_ids:
                        yield _shard_row(first, names, pieces)
                        names, pieces, total, first = [], [], 0, None
        if names:
            yield _shard_row(first, names, pieces)

    placed.mapInPandas(shards, "shard long, ids long, data binary").write.parquet(path)


def _shard_row(first, names, pieces):
    lengths = np.array([len(p) for p in pieces])
    return pd.DataFrame({
        "shard": [first], "ids": [int(lengths.sum())], "data": [pack_shard(names, lengths, np.concatenate(pieces))],
    })


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the shards under ``path``: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit integers)."""
    written = spark.read.schema("shard long, ids long, data binary").parquet(path)
    starts = stored(running_totals(written.select("shard", "ids"), ["shard"], {"ids": "before"}).select("shard", "before"))

    def unpack(batches):
        for pdf in batches:
            for before, data in zip(pdf["before"], pdf["data"]):
                shard = Shard(data)
                ids, ends = shard.all_ids(), shard.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, dtype="Int64"), "start": begins + before, "n_tokens": ends - begins,
                    "ids": [ids[b:e].tobytes() for b, e in zip(begins, ends)],
                })

    return spread_join(written.drop("ids"), starts, ["shard"]).mapInPandas(
        unpack, "doc_id long, start long, n_tokens long, ids binary")
