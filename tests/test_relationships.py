"""Relations between symbols: certain targets only, and capped evidence."""

from siltstone.operators import capsule, relationships

SYMBOLS = [
    ("a.ts", "A", "A", "class", None, 1, 20), ("a.ts", "A.run", "run", "method", "A", 2, 8), ("a.ts", "A.stop", "stop", "method", "A", 9, 12), ("a.ts", "go", "go", "function", None, 22, 30),
    ("a.ts", "dup1", "dup", "function", None, 31, 32), ("a.ts", "dup2", "dup", "function", None, 33, 34), ("b.ts", "help", "help", "function", None, 1, 3), ("b.ts", "I", "I", "interface", None, 5, 9),
    ("t.test.ts", "case", "case", "function", None, 1, 9),
]
BINDINGS = [("a.ts", "h", "help", "NAMED", "b.ts"), ("a.ts", "b", None, "NAMESPACE", "b.ts"), ("t.test.ts", "go", "go", "NAMED", "a.ts"), ("a.ts", "J", "I", "NAMED", "b.ts"), ("a.ts", "twice", "x", "NAMED", "b.ts"), ("a.ts", "twice", "y", "NAMED", "b.ts")]
CALLS = [("a.ts", 3, "SELF_MEMBER", "stop", None), ("a.ts", 23, "IDENTIFIER", "h", None), ("a.ts", 24, "NAMESPACE_MEMBER", "help", "b"), ("a.ts", 25, "IDENTIFIER", "dup", None), ("a.ts", 26, "IDENTIFIER", "go", None), ("a.ts", 27, "IDENTIFIER", "twice", None), ("t.test.ts", 2, "IDENTIFIER", "go", None), ("a.ts", 99, "IDENTIFIER", "h", None)]


def frames(spark):
    symbols = spark.createDataFrame(SYMBOLS, "path string, symbol_id string, name string, kind string, parent_id string, start_line int, end_line int")
    bindings = spark.createDataFrame(BINDINGS, "path string, local_name string, imported_name string, kind string, target_path string")
    files = spark.createDataFrame([("a.ts", "source"), ("b.ts", "source"), ("t.test.ts", "test")], "path string, category string")
    return symbols, bindings, files


def test_calls(spark):
    symbols, bindings, files = frames(spark)
    calls = spark.createDataFrame(CALLS, "path string, line int, form string, callee string, receiver string")
    got = sorted((r["type"], r["source_symbol"], r["target_symbol"]) for r in relationships.calls(calls, symbols, bindings, files).collect())
    assert got == [("SYMBOL_REFERENCES_SYMBOL", "A.run", "A.stop"), ("SYMBOL_REFERENCES_SYMBOL", "go", "help"), ("TEST_REFERENCES_SYMBOL", "case", "go")]


def test_implementations(spark):
    symbols, bindings, _ = frames(spark)
    clauses = spark.createDataFrame([("a.ts", "A", "J"), ("a.ts", "A", "Unknown")], "path string, class_name string, interface_name string")
    got = [(r["source_symbol"], r["target_path"], r["target_symbol"]) for r in relationships.implementations(clauses, symbols, bindings).collect()]
    assert got == [("A", "b.ts", "I")]


def test_expansion_needs_relevant_symbols_and_spares_direct_files(spark):
    symbols, bindings, files = frames(spark)
    calls = spark.createDataFrame(CALLS, "path string, line int, form string, callee string, receiver string")
    relations = relationships.calls(calls, symbols, bindings, files)
    seeds = spark.createDataFrame([(1, "a.ts", 200.0, 1, 1)], "task_id int, path string, score double, rank int, tier int")
    relevant = spark.createDataFrame([(1, "a.ts", "go")], "task_id int, path string, symbol_id string")
    direct = spark.createDataFrame([(1, "a.ts"), (1, "b.ts")], "task_id int, path string")
    got = {(r["path"], r["kind"]): r["weight"] for r in relationships.expand(seeds, relations, direct, relevant).collect()}
    assert set(got) == {("b.ts", "SYMBOL_REFERENCE"), ("t.test.ts", "TEST_REFERENCE")} and got["b.ts", "SYMBOL_REFERENCE"] == 0 and 0 < got["t.test.ts", "TEST_REFERENCE"] <= 18
    assert relationships.expand(seeds, relations, direct).count() == 0


def test_a_changed_capsule_is_found_out(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 10.0), (1, "b", 2, 5.0)], "task_id int, path string, rank int, score double")
    parts = spark.createDataFrame([(1, "a", "K", "LEXICAL", 10.0), (1, "b", "K", "LEXICAL", 5.0)], "task_id int, path string, kind string, family string, value double")
    chosen = spark.createDataFrame([(1, "a", 0, 70)], "task_id int, path string, level int, tokens int")
    made = capsule.build(ranked, parts, chosen, 100)
    assert all(r["violations"] == 0 for r in capsule.check(made).collect())
    assert made.first()["capsule_hash"] == capsule.build(ranked.orderBy("path"), parts, chosen, 100).first()["capsule_hash"]
    bad = {r["check"]: r["violations"] for r in capsule.check(made.withColumn("capsule", made["capsule"].withField("budget.used", made["capsule.budget.used"] + 50))).collect()}
    assert bad["over_budget"] == 1 and bad["hash_differs"] == 1 and bad["rank_repeats"] == 0
