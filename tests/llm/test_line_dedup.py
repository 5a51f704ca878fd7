"""Line dedup against its SQL, hand-made templates and odd rows."""

from compare import compare, duck
from pyspark.sql import types as T

from framejobs.llm import line_dedup
from framejobs.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, n_lines string, template string"


def test_query_matches_sql(spark, sf_dir):
    name = "op2_line_dedup"
    line, ok = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, line


def test_templates_generalise_and_first_keeps(spark):
    rows = [(i, f"{n} opens with {i * 7 + 1} words {n}\nPosted by user{i} on the third of May today\nYour host is now {n} and says thank you for reading\nok", "x", "y")
            for i, n in enumerate(["amy", "bob", "joe", "kim"])]
    rows.append((9, "Something else entirely is written here\n", "x", "y"))
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in (1, 2, 3):
        assert "Posted" not in got[i].text and "Your host" not in got[i].text and "ok" not in got[i].text.split("\n")
    assert (got[9].text, got[9].n_lines, got[9].n_dropped) == (rows[4][1], 2, 0)
    assert got[0].template == "y"


def test_short_lines_and_long_pairs(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    short = long.rsplit(" ", 1)[0]
    texts = ["Les.\n" + long, "a b\nLes.\n" + long, "x\n Les.\n" + short, "y\nLes.\n" + short, "a b\n\nz"]
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    # One word recurs in three texts and goes; a line of 50 words needs two, one of 49 three; blanks are no tokens.
    assert got == {0: texts[0], 1: "a b", 2: "x\n" + short, 3: "y\n" + short, 4: texts[4]}


def test_copies_are_one_document(spark):
    text = "one line of words\nanother line of words"
    rows = [(i, text, "", "") for i in (3, 1, 2, 1)]
    assert {r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {text}


def test_odd_rows(spark):
    long = "\n".join(f"line number {'abcdefghij'[i % 10]} of many here" for i in range(5000))
    rows = [(1, None, "", ""), (2, "", "", ""), (None, "a b c\n\n", "", ""), (None, "a b c", "", ""), (4, "z\na b c", "", ""), (5, long, "", ""), (5, long, "", "")]
    got = sorted((str(r.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([("1", "", 0, 0), ("2", "", 1, 0), ("None", "\n", 3, 1), ("None", "", 1, 1), ("4", "z\na b c", 2, 0), ("5", long, 5000, 0), ("5", long, 5000, 0)])
    assert line_dedup.drop_recurring_lines(spark.createDataFrame([], SCHEMA)).collect() == []
