"""Small functions by known answers: eligibility, parsers, references, lints, history of files, private paths, saved capsules."""

import json

from pyspark.sql import functions as F

from siltstone.functions import policies
from siltstone.functions import text as T
from siltstone.operators import graph, provenance
from siltstone.sources import files


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_small_functions(spark, tmp_path):
    rows = spark.createDataFrame([("a.ts",), ("b.py",), ("c.txt",)], "path string")
    assert values(rows.select("path", policies.parser_language(F.col("path")).alias("v")), "path", "v") == [("a.ts", "typescript"), ("b.py", "python"), ("c.txt", None)]
    refs = spark.createDataFrame([("x", ["a", "b"]), ("y", [])], "id string, refs array<string>")
    assert values(provenance.dangling(refs, F.col("refs"), spark.createDataFrame([("a",)], "k string"), "k"), "id", "ref") == [("x", "b")]
    c = spark.createDataFrame([("p", 1, "TEST", False, "BUDGET_EXHAUSTED"), ("q", 2, "CODE", True, "")], "path string, rank int, role string, selected boolean, reason string")
    assert values(provenance.lints(c, spark.createDataFrame([("gone",)], "path string")), "code", "entity") == [("AVAILABLE_ROLE_NOT_SELECTED", "TEST"), ("SOURCE_UNAVAILABLE", "gone"), ("TOP_CANDIDATE_BUDGET_LOSS", "p")]
    log = spark.createDataFrame([("c1", 1, "a"), ("c2", 2, "a"), ("c2", 2, "b"), ("c3", 3, "b")], "commit string, at int, path string")
    assert values(graph.history(log, 2), "path", "commits", "last_commit") == [("a", 1, "c2"), ("b", 2, "c3")]
    told = spark.createDataFrame([("see /home/me/x.ts and https://a.b/c, C:\\Users\\me\\y",)], "t string").select(T.redact_paths(F.col("t")).alias("v"))
    assert values(told, "v") == [("see <path> and https://a.b/c, <path>",)]
    (tmp_path / "c.json").write_text(json.dumps({"id": "h", "n": 1}))
    assert values(files.read_capsules(spark, str(tmp_path), "id string, n int"), "id", "n") == [("h", 1)]


def test_eligible_files(spark):
    rows = spark.createDataFrame([("source", "text"), ("generated", "text"), ("test", "binary"), ("unknown", "text")], "category string, status string")
    assert values(rows.select("category", policies.is_eligible(F.col("category"), F.col("status")).alias("v")), "category", "v") == [("generated", False), ("source", True), ("test", False), ("unknown", True)]
