"""Repeated passages against brute force over all word windows."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from framejobs.llm import passages

SCHEMA = "doc_id long, text string, spans string"


def brute(texts, least):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i:i + least]), []).append((d, i))
    cover = [np.zeros(len(w), dtype=bool) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i:i + least] = True
    return cover


def corpus(rng):
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 60, 75, 120, 300)]
    texts = []
    for i in range(90):
        parts = fresh(int(rng.integers(0, 120)))
        for k in rng.choice(len(shared), int(rng.integers(0, 3)), replace=False):
            cut = shared[k] if rng.random() < 0.7 else shared[k][int(rng.integers(0, 30)):]
            parts += cut + fresh(int(rng.integers(0, 60)))
        texts.append(" ".join(parts))
    base = fresh(400)
    for i in range(30):  # near copies
        copy = list(base)
        for at in rng.choice(400, 3, replace=False):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(fresh(49))] * 2 + [" ".join(fresh(80))] * 3
    texts.append(" ".join(shared[2] + fresh(5) + shared[2]))
    return texts


def test_matches_all_windows(spark):
    texts = corpus(np.random.default_rng(11))
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    hit = total = 0
    for i, want in enumerate(brute(texts, 50)):
        cover = np.zeros(len(want), dtype=bool)
        for s in got[i].spans:
            cover[s.start:s.stop] = True
        assert not (cover & ~want).any(), i  # nothing beyond a true repeat
        assert want.any() == cover.any(), i  # every document with a repeat is found
        assert got[i].n_repeated == cover.sum() and got[i].n_words == len(want)
        hit, total = hit + (cover & want).sum(), total + want.sum()
    assert hit >= 0.995 * total


def test_frequent_lines(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(18)) for _ in range(40)]
    texts = ["\n".join(pool[k] for k in rng.integers(0, len(pool), 8)) for _ in range(600)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, want in enumerate(brute(texts, 50)):
        cover = np.zeros(len(want), dtype=bool)
        for s in got[i].spans:
            cover[s.start:s.stop] = True
        assert (cover == want).all(), i
        assert got[i].n_repeated == cover.sum()


def test_odd_rows(spark):
    long = "w " * 30000
    rows = [(1, None, ""), (2, "", ""), (3, long, ""), (None, "x y z", ""), (4, "a b", ""), (4, "a b", ""), (5, " ".join(map(str, range(60))), ""),
            (5, " ".join(map(str, range(60))), ""), (6, " ".join(map(str, range(70))), "")]
    got = {(r.doc_id, r.n_words, r.n_repeated) for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 30000, 30000), (None, 3, 0), (4, 2, 0), (5, 60, 60), (6, 70, 60)}
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\té")), max_size=60))
def test_words_are_told_apart(text):
    hashes, starts, ends = passages.word_hashes(text)
    raw = text.encode()
    assert [raw[s:e] for s, e in zip(starts, ends)] == raw.split()
    named = {}
    for h, w in zip(hashes.tolist(), raw.split()):
        assert named.setdefault(h, w) == w
    assert len(set(raw.split())) == len(named)


@pytest.mark.parametrize("n,span", [(50, 43), (51, 43), (300, 43), (20, 43)])
def test_a_passage_brings_its_minimisers(n, span):
    rng = np.random.default_rng(n)
    inner = rng.integers(1, 2**60, n).astype(np.uint64)
    found = []
    for _ in range(3):
        words = np.concatenate([rng.integers(1, 2**60, 77).astype(np.uint64), inner, rng.integers(1, 2**60, 55).astype(np.uint64)])
        at, _ = passages.minimisers(words, span)
        found.append({int(a) - 77 for a in at if 77 <= a <= 77 + n - 8})
    assert n < 50 or set.intersection(*found)
