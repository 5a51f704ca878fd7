"""Substring dedup against a brute-force count of all windows, in small and in large buckets, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from compare import compare, duck

from framejobs.llm import super_kmers
from framejobs.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, n_words string, k1 string, packed string"


def brute(rows, window):
    """Expected rows: every window of every document, first occurrence by (id, start), null ids last."""
    place = lambda d: float("inf") if d is None else d
    words = [(t or "").encode().split() for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (place(d), s)), (place(d), s))
    out = []
    for (d, *_), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (place(d), s):
                gone.update(range(s, s + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 30))) for _ in range(25)]
    docs = []
    for i in range(160):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choice("xyz") + str(rng.randrange(50)) for _ in range(9))
                         for _ in range(rng.randint(1, 8)))
        docs.append((i * 3 % 160, text, "", "", ""))
    phrase = " ".join(f"w{i}" for i in range(45))
    docs += [(1000 + i, f"{i} a{i} {i} b{i} " * 3 + phrase + f" {i} c{i} d{i}" * 6, "", "", "") for i in range(60)]
    docs += [(2000, "la " * 100, "", "", ""), (2001, "la " * 30 + "lo " + "la " * 30, "", "", "")]
    return docs


@pytest.mark.parametrize("seed,bucket", [(1, 4096), (2, 3)])
def test_matches_brute_force(spark, seed, bucket):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in super_kmers.remove_repeats(df, bucket=bucket).collect()), key=str)
    assert got == brute(rows, 20)


def test_odd_rows(spark):
    text = " ".join(f"é{i}" for i in range(30))
    long = " ".join(f"n{i % 7919}" for i in range(60000))
    rows = [(r, t, "x", "y", "z") for r, t in [
        (None, text), (None, text + " more words"), (5, text), (5, text), (5, "tail " + text), (7, None), (8, ""), (9, " \t\n"), (None, None),
        (11, " ".join(f"é{i}" for i in range(19))), (12, long), (13, long[:2000]), (3, "A" + text[1:]), (4, "it is " * 25)]]
    df = spark.createDataFrame(rows, SCHEMA)
    result = super_kmers.remove_repeats(df, with_text=True)
    assert result.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    got = result.collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 20)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert super_kmers.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_carry_their_windows():
    text = " ".join(f"w{i * 7 % 50}" for i in range(200))
    words = text.split()
    runs = super_kmers.super_kmers(text, np.arange(200), 20)
    assert [s for s, *_ in runs] == np.cumsum([0] + [n for _, n, *_ in runs])[:-1].tolist() and sum(n for _, n, *_ in runs) == 181
    assert all(packed.split(" ") == words[s:s + n + 19] and n <= 13 for s, n, _, packed in runs)


def test_query_matches_sql(spark, sf_dir):
    name = "op11_substring_dedup"
    line, ok = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, line
