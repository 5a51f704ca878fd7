"""Vector and SimHash near-duplicates against brute force on small fixtures."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from framejobs.llm import simhash, vector_dedup
from framejobs.llm.common import components, running_totals

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("n_links", T.StringType()),
])
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()),
])


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    rows = [base[i % 60] + (0.15 if i >= 60 else 0) * rng.standard_normal(24) for i in range(180)]
    rows += [base[0]] * 40 + [base[1] + 0.05 * rng.standard_normal(24) for _ in range(150)]
    return [list(map(float, np.float32(r))) for r in rows]


def test_vectors_match_all_pairs(spark):
    good = vectors()
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good + odd)] + [(None, good[0], "x")]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(
        spark.createDataFrame(rows, VECTORS), window=64, recall=0.9999).collect()}
    x = np.array(good, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = roots(len(x), zip(*np.nonzero(near)))
    assert [got[i].component_id for i in range(len(x))] == want
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.99 * near.sum()
    for i in range(len(good), len(rows) - 1):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and got[None].kept


@pytest.mark.parametrize("noise", [0.02, 0.15])
def test_dense_groups_keep_their_links(spark, noise):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    x = np.concatenate([centre + noise * rng.standard_normal((1500, 32)), rng.standard_normal((500, 32))]).astype(np.float32)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(
        spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VECTORS), window=64).collect()}
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert near.sum() > 1000 * 1000 and (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.999 * near.sum()
    assert [got[i].component_id for i in range(len(x))] == roots(len(x), zip(*np.nonzero(near)))


def test_vectors_empty(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def slow_fingerprint(text, n=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B c\td", "É x y z Q\x1cw v", "w " * 300 + "x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == slow_fingerprint(text)


def test_xxhash_is_the_engine_function(spark):
    texts = ["", "abc", "die größe", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) h").collect()
    assert [r.h % 2**64 for r in rows] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("blocks,tile", [(None, 2048), (5, 8), (7, 16), (8, 64)])
def test_links_are_complete(spark, blocks, tile):
    rng = np.random.default_rng(blocks or 0)
    centres = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = []
    for c in centres:
        for _ in range(40):
            v = int(c)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            fps.append(simhash._signed(v % 2**64))
    fps = sorted(set(fps))
    got = components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, blocks, tile)).collect()
    found = {r.id: r.root for r in got}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 4]
    assert [found.get(f, f) for f in fps] == [fps[r] for r in roots(len(fps), near)]


def test_documents(spark):
    rows = [(5, "a b c d e f", "k"), (3, "A b c\nd e f", "k"), (9, None, "k"), (8, " ", "k"), (None, "a b c d e f", "k"),
            (5, "a b c d e f", "k")]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (5, 3, False), (3, 3, True), (9, 8, False), (8, 8, True), (None, 3, False)}
    assert len(got) == 6
    assert {r.fingerprint for r in got if r.doc_id in (8, 9)} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_running_totals_per_key(spark):
    rows = [(i % 2, i, i * 3) for i in range(500)]
    got = running_totals(spark.createDataFrame(rows, "k int, i int, v long"), ["i"], {"v": "t"}, ["k"]).collect()
    seen = {0: 0, 1: 0}
    for r in sorted(got, key=lambda r: r.i):
        assert r.t == seen[r.k]
        seen[r.k] += r.v


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}
