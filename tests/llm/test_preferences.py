"""Preference formatting against its SQL and hand-made pairs."""

from compare import compare, duck

from framejobs.llm import preferences
from framejobs.llm.queries import ORACLES, QUERIES

SCHEMA = "pair_id long, turn long, role string, text string, prompt string"


def test_query_matches_sql(spark, sf_dir):
    name = "op9_preference_format"
    line, ok = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, line


def said(text, spans):
    return [text[s["start"]:s["stop"]] for s in spans]


def test_pairs(spark):
    chosen = [(1, 0, "system", "be kind", ""), (1, 1, "user", "hi <|end|>", ""), (1, 2, "assistant", "hello", ""), (1, 3, "user", "bye", ""), (1, 4, "assistant", "ciao", ""),
              (2, 0, "user", "a", ""), (2, 1, "assistant", "b", ""), (3, 0, None, None, ""), (None, 0, "user", "x", "")]
    rejected = [(1, 0, "system", "be kind", ""), (1, 1, "user", "hi <|end|>", ""), (1, 2, "assistant", "go away", ""),
                (2, 0, "user", "a", ""), (2, 1, "assistant", "b", ""), (4, 0, "assistant", "only", ""), (None, 0, "user", "x", "")]
    got = {r.pair_id: r for r in preferences.format_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    one = got[1]
    assert one.n_common == 2 and one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi < |end|><|end|>\n"
    assert said(one.chosen, one.chosen_spans) == ["hello<|end|>", "ciao<|end|>"]
    assert said(one.rejected, one.rejected_spans) == ["go away<|end|>"]
    assert (got[2].n_common, got[2].chosen, got[2].rejected) == (2, "", "")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("", "<||>\n<|end|>\n", "")
    assert (got[4].chosen, said(got[4].rejected, got[4].rejected_spans)) == ("", ["only<|end|>"])
    empty = spark.createDataFrame([], SCHEMA)
    assert preferences.format_pairs(empty, empty).collect() == []


def test_repeated_rows_and_long_conversations(spark):
    turns = [(7, i // 2, "assistant" if i % 4 > 1 else "user", "t" * 50, "") for i in range(4000)]
    other = turns[:3000]
    r = preferences.format_pairs(spark.createDataFrame(turns, SCHEMA), spark.createDataFrame(other, SCHEMA)).collect()[0]
    assert r.n_common == 3000 and r.rejected == "" and len(r.chosen_spans) == 500


def test_every_answered_conversation_makes_a_pair(spark):
    rows = [(c, t, role, f"{c} {t} {role}", "x") for c in (2, 4, 40, 6, None) for t, role in ((0, "user"), (1, "assistant"), (2, "assistant"), (3, "user"))]
    rows += [(8, 0, "user", "no answer", ""), (10, None, "assistant", "only", ""), (10, None, "assistant", "only", ""), (4, 2, "assistant", "4 2 assistant", ""),
             (12, None, None, None, ""), (12, 5, "assistant", None, "")]
    chosen, rejected = preferences.answer_swaps(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, answer string").repartition(4))
    kept, gone = ({c: sorted(((r.turn, r.role, r.text) for r in side.collect() if r.pair_id == c), key=str) for c in (2, 4, 6, 10, 12, 40, None)}
                  for side in (chosen, rejected))
    partner = {2: "4 2 assistant", 4: "6 2 assistant", 6: "only", 10: None, 12: "40 2 assistant", 40: "None 2 assistant", None: "2 2 assistant"}
    for c in (2, 6, 40, None):
        assert kept[c] == sorted([(t, r, f"{c} {t} {r}") for t, r in ((0, "user"), (1, "assistant"), (2, "assistant"), (3, "user"))], key=str)
        assert gone[c] == sorted([(0, "user", f"{c} 0 user"), (1, "assistant", f"{c} 1 assistant"), (2, "assistant", partner[c])], key=str)
    assert len(kept[4]) == 5 and gone[4].count((2, "assistant", "6 2 assistant")) == 2
    assert gone[10] == [(None, "assistant", None)] * 2 and gone[12] == [(5, "assistant", "40 2 assistant"), (None, None, None)]
    assert {r.pair_id for r in chosen.collect()} == set(partner)
    formatted = preferences.format_pairs(chosen, rejected).collect()
    assert {r.pair_id for r in formatted} == set(partner)
    empty = preferences.answer_swaps(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert preferences.format_pairs(*empty).collect() == []
    alone = preferences.format_pairs(*preferences.answer_swaps(spark.createDataFrame(rows[:4], "conv_id long, turn long, role string, text string, answer string"))).collect()
    assert len(alone) == 1 and alone[0].rejected == ""
