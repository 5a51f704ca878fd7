"""The pipeline stage by stage against brute force on a small table."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from framejobs.llm import simhash
from framejobs.llm.queries import documents
from framejobs.session import stored


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    tables = [documents(spark, sf_dir)]
    for _, stage in pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir)))
    return tables


def test_stages_hand_on_documents(steps):
    for table in steps[1:-1]:
        assert table.columns == steps[0].columns
    counts = [t.count() for t in steps]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0


def test_quality_keeps_rows_as_they_are(spark, steps, sf_dir):
    before = {tuple(r) for r in steps[0].collect()}
    kept = steps[1].collect()
    assert {tuple(r) for r in kept} <= before
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    good = [d for d, l in labels.items() if l == (1, 0)]
    bad = [d for d, l in labels.items() if l[0] == 0]
    assert sum(d in ids for d in good) >= 0.9 * len(good)
    assert sum(d in ids for d in bad) <= 0.3 * len(bad)


def test_lines_lose_only_recurring_ones(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    after = {r.doc_id: r for r in steps[2].collect()}
    found = {}
    for d, t in before.items():
        for line in t.split("\n"):
            found.setdefault(line, set()).add(t)
    for d, t in before.items():
        kept = after[d].text.split("\n") if d in after else []
        it = iter(t.split("\n"))
        assert all(line in it for line in kept)
        if d in after:
            assert after[d].n_chars == len(after[d].text)
        for line in set(t.split("\n")) - set(kept):
            assert line.split()
    # Every line that stands in three texts as it is stays in one of them at most.
    for line, texts in found.items():
        if len(texts) >= 3 and line.split():
            assert len({before[d] for d, r in after.items() if line in r.text.split("\n")}) <= 1, line


def test_one_document_of_each_group_stays(steps):
    rows = {r.doc_id: simhash.fingerprint(r.text, 4) for r in steps[2].collect()}
    ids = sorted(rows)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (rows[a] ^ rows[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in steps[3].collect()) == [d for d in ids if find(d) == d]


def test_different_texts_of_one_id_stay(spark, sf_dir):
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, d), (3, e), (3, f), (3, f), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [(None, a), (None, b), (1, c), (2, d), (3, e), (3, f)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_mix_repeats_whole_documents(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    counts = {}
    for r in steps[4].collect():
        assert before[r.doc_id] == r
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts.values()) <= {1, 2}
    size = lambda d: len(before[d].text.encode().split())
    total = sum(map(size, before))
    assert sum(size(d) * n for d, n in counts.items()) == pytest.approx(1.5 * total, rel=0.1)


def test_packing_holds_every_id(steps):
    copies = {}
    for r in steps[4].collect():
        copies.setdefault(r.doc_id, []).append(r.text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in steps[5].collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(copies)
    for d, pieces in got.items():
        ids = np.array(tokenizer.encode(copies[d][0], add_special_tokens=False).ids + [0], dtype="<u4")
        assert sum(p.length for p in pieces) == len(ids) * len(copies[d])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())


def test_empty_table(spark, sf_dir):
    docs = documents(spark, sf_dir).where("false")
    for _, stage in pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, sf_dir))
    assert docs.collect() == []
