"""Spelling variants against all pairs compared one by one, signatures against random edits, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from framejobs.llm import spelling
from framejobs.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string, n string, form string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    total = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], None if form[w] is None else n[form[w]], root))
    return sorted(out, key=str)


def answer(df, **options):
    return sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(df, **options).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeinrstéß") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    pool = []
    for stem in stems:
        pool += [stem] * rng.choice([3, 100, 200])
        word = stem
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + rng.choice("aeinrst") + word[at:], word[:at] + word[at + 1:], word[:at] + rng.choice("aeinrst") + word[at + 1:]])
            pool += [word] * rng.choice([1, 2, 14])
    return [(i, ", ".join(rng.choice([w, w.upper() if w.isascii() else w, w.title() if w.isascii() else w])
                          for w in rng.sample(pool, 60)), "", "", "") for i in range(400)]


@pytest.mark.parametrize("seed,parts,bucket", [(1, 4, 256), (2, 5, 2), (3, 3, 1)])
def test_matches_all_pairs(spark, seed, parts, bucket):
    rows = corpus(seed)
    got = answer(spark.createDataFrame(rows, SCHEMA).repartition(4), parts=parts, bucket=bucket)
    assert got == brute(rows)
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got)


def test_one_edit_shares_a_signature():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 10)))
        at, c = rng.randrange(len(a)), rng.choice("abcdef")
        for b in (a[:at] + a[at + 1:], a[:at] + c + a[at:], a[:at] + c + a[at + 1:]):
            for parts in (3, 4, 5):
                assert set(spelling.signatures(a, parts)) & set(spelling.signatures(b, parts))
            assert spelling.shorter(a) & spelling.shorter(b)


def test_odd_rows(spark):
    long = "letters " * 40000 + "lettersz " * 7 + "z" * 3000
    rows = [(r, t, "x", "y", "z") for r, t in [
        (None, "Sameness " * 6), (None, None), (1, ""), (2, "×÷×÷×÷ Āabcdefā " * 5), (3, long), (3, long),
        (4, "STRAßEN ÉCOLES écoles " * 6), (5, "abcde " * 9)]]
    assert answer(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
