"""Runs of capitalised words and of digit groups as long as a text."""

from siltstone.llm import decontamination


def test_runs_of_any_length_are_one_token(spark):
    item = "the quick fox jumps over a lazy dog near some old river bank"
    docs = [(1, "Ab Cd " * 20_000), (2, "1,2." * 40_000 + " " + item), (3, "THE CAT " * 20_000), (4, "Ab " * 20_000 + item)]
    rows = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["items"]) for r in rows.collect()) == [(1, []), (2, [1]), (3, []), (4, [1])]
