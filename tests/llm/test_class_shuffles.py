"""Tables dealt out anew on the way to the classes of near-duplicates."""

from siltstone.llm import common, near_dedup
from tests.llm.test_dedup import docs, near_rows, plain_classes


def test_classes_take_few_shuffles(spark, monkeypatch):
    dealt, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or write(df))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark would find small by itself is not counted
    try:
        rows = near_rows()
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert got == plain_classes(rows)
    assert sum(dealt) <= 40, dealt
