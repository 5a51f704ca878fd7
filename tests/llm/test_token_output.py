"""Token ids, packing and token files against direct encoding and exact round trips."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framejobs.llm import packing, token_files, tokens
from framejobs.llm.queries import QUERIES

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n\n a  b\t\tc \n", "x\xa0 y", "it's I'M we'll", "ΣΑΣ İstanbul", "<|endoftext|> a", "é é", "a b",
       "x\x1cy \x85 z", "word " * 3000, "日本語 text\r\n", "a​b", "  lead", "trail  ", "  Σ Σ", "a  ² ½b x²y"]
SCHEMA = "doc_id long, text string, start string"


@pytest.fixture(scope="module")
def direct():
    found = {}
    for path in (BYTE, WORDS):
        found[path] = Tokenizer.from_file(path)
    return lambda path, text: found[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_of_odd_texts(direct, path):
    assert [i.tolist() for i in tokens.Ids(path).encode(ODD)] == [direct(path, t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB'sé .,\n\t 1٣Σ  ́日!", "<|endoftext|>", "<|"]), max_size=40).map("".join))
def test_ids_of_any_text(direct, text):
    for path in (BYTE, WORDS):
        assert tokens.encoder(path).encode([text])[0].tolist() == direct(path, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB'slé×÷İ¿ .,\n\t\r17_\x0b日́", " ab", "'ll", "\n\n"]), max_size=12).map("".join), max_size=6))
def test_ids_of_texts_of_a_batch(direct, texts):
    for path in (BYTE, WORDS):
        assert [i.tolist() for i in tokens.encoder(path).encode(texts)] == [direct(path, t) for t in texts]


def test_ids_when_the_cache_turns_over(direct, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 12)
    words = [f"{a}{b}{c}" for a in "xyz" for b in "éeo" for c in "kqw"]
    for path in (BYTE, WORDS):
        ids = tokens.Ids(path)
        for start in [*range(0, 27, 4), 0, 8, 20, 0]:
            text = " ".join(words[start:start + 6]) + "'ll 12ab.\n"
            assert [i.tolist() for i in ids.encode([text, text[::-1]])] == [direct(path, text), direct(path, text[::-1])]
        assert len(ids.pieces) <= 40


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_a_word_is_learned_once_whatever_signs_it_bears(direct, path):
    words, signs = [f"{a}né{b}" for a in "bcdfg" for b in "klmnp"], [",", ".", "!)", ";", ":", "?", "...", "7", "%"]
    texts = [" ".join(f"{w}{s}" for w in words) for s in signs] + ["\n".join(words)]
    ids = tokens.Ids(path)
    assert [i.tolist() for i in ids.encode(texts)] == [direct(path, t) for t in texts]
    assert len(ids.pieces) <= 2 * len(words) + len(signs) + 1  # with and without a blank; the signs; the line break


@given(st.integers(1, 5000), st.sampled_from([64, 100, 1024]))
def test_cuts_cover(total, capacity):
    at = 0
    for start, length in packing.cuts(total, capacity):
        assert start == at and 0 < length <= capacity
        at += length
    assert at == total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=40))
def test_blocks_hold_every_item_once(sizes):
    packed = packing.pack_block(sizes, 100)
    assert sorted(i for w in packed for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in packed)


def test_differencing_known_case():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert sorted(sum([5, 5, 5, 5][i] for i in w) for w in packing.differencing([5, 5, 5, 5], 2)) == [10, 10]


def check_pieces(rows, want, capacity, end_id):
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for (doc, total), pieces in docs.items():
        ids = np.array(want[doc] + [end_id], dtype="<u4")
        assert len(ids) == total == sum(r.length for r in pieces)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    return 1 - sum(r.length for r in rows) / (capacity * len(windows))


def test_pack_odd_texts(spark, direct):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), BYTE, 0, capacity=64, with_ids=True)
    kept = got.collect()
    check_pieces(kept, {i: direct(BYTE, t) for i, t, _ in rows}, 64, 0)
    joined = {r.sequence_id: r.ids for r in packing.sequences(spark.createDataFrame(kept, got.schema)).collect()}
    for r in kept:
        assert joined[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE, 0).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (None, None, "")], SCHEMA), BYTE, 0).collect()
    assert sorted((r.doc_id is None, r.length) for r in twice) == [(False, 3), (False, 3), (True, 1)]


def test_packing_query(spark, sf_dir, direct):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_window_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    padding = check_pieces(rows, {d: direct(BYTE, t) for d, t in docs.items()}, 1024, 0)
    assert padding < 0.03


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=60), min_size=1, max_size=8))
def test_shard_round_trip(docs):
    lengths = np.array([len(d) for d in docs])
    flat = np.array([i for d in docs for i in d], dtype=np.uint32)
    shard = token_files.Shard(token_files.pack_shard([None, *range(1, len(docs))], lengths, flat))
    assert shard.doc_ids == [None, *range(1, len(docs))]
    assert shard.all_ids().tolist() == flat.tolist() == [shard.token(i) for i in range(shard.size)]
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs


def test_rank_directory_spans_groups():
    flat = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    shard = token_files.Shard(token_files.pack_shard([1], np.array([5000]), flat))
    assert [shard.token(i) for i in range(0, 5000, 7)] == flat[::7].tolist()


def test_shard_stands_alone(tmp_path):
    file = tmp_path / "a.dac"
    file.write_bytes(token_files.pack_shard([4], np.array([2]), np.array([70000, 1])))
    assert token_files.Shard(file.read_bytes()).document(0).tolist() == [70000, 1]


def check_files(rows, docs, direct):
    at = 0
    for r, (doc, text) in zip(rows, docs, strict=True):
        ids = np.array(direct(WORDS, text) + [1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        yield r, ids
        at += len(ids)


def test_token_file_query(spark, sf_dir, direct):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(QUERIES["op10_token_files"](spark, sf_dir).collect())
    for r, ids in check_files(rows, docs, direct):
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_token_files_of_odd_texts(spark, direct, tmp_path):
    rows = [(i // 2 if i else None, t, "x") for i, t in enumerate(ODD)]
    token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), WORDS, 1, shard_ids=10)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    hashes = {r.text: r.h for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(((d, t) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    for r, ids in check_files(got, order, direct):
        assert bytes(r.ids) == ids.tobytes()
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), WORDS, 1)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []
