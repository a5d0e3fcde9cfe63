"""Dice from sets made once for a record."""

from test_whole import corpus

from weftlink.plans.queries import QUERIES


def test_dice_reads_no_text_of_a_pair(spark, tmp_path):
    df = QUERIES["sim_dice"](spark, corpus(spark, tmp_path, ["One Two two", "two one", "two three"]))
    assert "clean_name" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["s1"], r["cid"]): r["sim"] for r in df.collect()}["0", "1"] == 1.0
