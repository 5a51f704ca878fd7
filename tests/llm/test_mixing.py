"""Source mixing against its SQL, its targets and brute force water filling."""

import pytest
from compare import compare, duck

from framejobs.llm import mixing
from framejobs.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, target string"


def filled(sizes, weights, budget, cap):
    """Targets by giving out the excess again and again."""
    target = [budget * w / sum(weights) for w in weights]
    while True:
        over = [i for i, s in enumerate(sizes) if target[i] > cap * s]
        if not over:
            return target
        full = {i for i, s in enumerate(sizes) if target[i] >= cap * s}
        rest = budget - sum(cap * sizes[i] for i in full)
        free = sum(w for i, w in enumerate(weights) if i not in full)
        target = [cap * s if i in full else rest * weights[i] / free for i, s in enumerate(sizes)]


def test_query_matches_sql(spark, sf_dir):
    name = "op4_source_mixing"
    line, ok = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, line


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 7 + 1), s, "") for i, s in enumerate(["a"] * 200 + ["b"] * 3 + ["c"] * 40 + [None] * 30)]
    rows += [(900, None, "a", ""), (901, " \t\n", "d", ""), (902, "", "d", ""), (5, "w " * 6, "a", ""), (5, "w " * 6, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        s = per.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
        assert r.taken == r.size * r.copies and r.copies <= 2
    order = ["a", "b", "c", "d", None]
    sizes = [per[s][0] for s in order]
    want = filled(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes), 2)
    assert [per[s][1] for s in order] == pytest.approx(want)
    for s in order:
        assert abs(per[s][2] - per[s][1]) <= 14
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    assert counts == {d: n for d, n in taken.items() if n}


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mixing.mix(spark.createDataFrame([(1, None, None, ""), (2, " ", "a", "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in rows) == [(1, 0, 0.0), (2, 0, 0.0)]
