"""Plans of tasks, roles of candidates, fusion caps."""

from pyspark.sql import functions as F

from siltstone.operators import pack, scoring, task_plan
from siltstone.operators import signals as S


def test_modes_and_plans(spark):
    tasks = [
        (1, "Fix the failing test of the parser"), (2, "Refactor the lock around the store"), (3, "Change the default timeout in app.config"), (4, "Explain the architecture document"), (5, "Open src/core/map.ts"),
        (6, 'Say "hello world" louder'), (7, "Rename parseFile"), (8, "make it nicer"), (9, ""), (10, "Review how MAX_SIZE is used"), (11, "Set MAX_SIZE in the config"),
    ]
    df = spark.createDataFrame(tasks, "task_id int, text string")
    signals = task_plan.analyzed(df)
    modes = task_plan.modes(df, signals)
    got = {r["task_id"]: (r["action"], r["mode"]) for r in modes.collect()}
    assert got == {
        1: ("FIX", "TEST_FAILURE"), 2: ("REFACTOR", "CONCURRENCY"), 3: ("CHANGE", "CONFIGURATION"), 4: ("UNDERSTAND", "ARCHITECTURE"), 5: ("CHANGE", "EXACT_TARGET"),
        6: ("CHANGE", "EXACT_TARGET"), 7: ("REFACTOR", "BEHAVIORAL"), 8: ("CHANGE", "GENERAL"), 9: ("CHANGE", "GENERAL"), 10: ("REVIEW", "BEHAVIORAL"), 11: ("CHANGE", "CONFIGURATION"),
    }
    kinds = {(r["task_id"], r["value"]): (r["v2_kind"], r["specificity"]) for r in signals.filter("origin = 'EXPLICIT'").collect()}
    assert kinds[(10, "MAX_SIZE")] == ("ERROR_IDENTIFIER", "TECHNICAL") and kinds[(11, "MAX_SIZE")] == ("CONFIG_KEY", "TECHNICAL")
    assert kinds[(5, "src/core/map.ts")] == ("PATH", "TECHNICAL") and kinds[(6, "hello world")][1] == "EXACT" and kinds[(8, "nicer")] == ("NATURAL_TERM", "GENERAL")
    plans = {r["task_id"]: (r["weights"], r["facet"]) for r in task_plan.pack_plans(modes).collect()}
    assert plans[2] == ({"PRIMARY": 0, "IMPACT": 0, "VALIDATION": 1, "SUPPORT": 2}, "IMPLEMENTATION") and plans[1] == ({"PRIMARY": 0, "IMPACT": 1, "VALIDATION": 0, "SUPPORT": 2}, "VALIDATION")
    assert plans[4] == ({"PRIMARY": 0, "IMPACT": 1, "VALIDATION": 2, "SUPPORT": 1}, "DOCUMENTATION") and plans[8][1] is None and plans[3][1] == "CONFIGURATION"
    assert {(r["facet"], r["weights"]["IMPACT"]) for r in task_plan.pack_plans(modes, neutral=True).collect()} == {(None, 2)}
    sections = [(r["role"], r["priority"]) for r in task_plan.sections(modes).filter("task_id = 4").orderBy("place").collect()]
    assert sections == [("DOCUMENTATION", "REQUIRED"), ("PRIMARY_IMPLEMENTATION", "PREFERRED"), ("TEST", "OPTIONAL"), ("REPOSITORY_INSTRUCTION", "PREFERRED")]
    colliding = signals.withColumn("ambiguity", F.lit("COLLIDING"))
    assert {r["task_id"]: len(r["focus"]) for r in task_plan.focus(colliding).collect()}.get(8) is None
    assert {r["task_id"]: len(r["focus"]) for r in task_plan.focus(signals.withColumn("ambiguity", F.lit("UNIQUE"))).collect()}[8] == 2


def test_candidates_play_roles_by_their_evidence(spark):
    rows = [("a.ts", "source", "ts"), ("b.test.ts", "test", "ts"), ("c.md", "documentation", None), ("d.ts", "source", None), ("e.json", "configuration", None), ("f.ts", "source", "ts")]
    c = spark.createDataFrame([(1, *r) for r in rows], "task_id int, path string, category string, language string")
    e = [
        ("a.ts", "EXACT_PATH", "IDENTITY", None, None), ("a.ts", "FILE_IMPORTED_BY", "STRUCTURAL", "z", None), ("b.test.ts", "TEST_RELATION", "STRUCTURAL", "a.ts", None), ("c.md", "VERIFIED_LEXICAL", "LEXICAL", None, None),
        ("d.ts", "EXACT_SYMBOL", "IDENTITY", None, "COLLIDING"), ("e.json", "LEXICAL_SYMBOL_OWNERSHIP", "SYMBOL", None, None), ("f.ts", "VERIFIED_LEXICAL", "LEXICAL", "a.ts", None),
    ]
    e = spark.createDataFrame([(1, *r) for r in e], "task_id int, path string, kind string, family string, source string, ambiguity string")
    got = {r["path"]: (r["roles"], r["strong"], r["facet"], r["directness"]) for r in task_plan.classify(c, e).collect()}
    assert got == {
        "a.ts": (["PRIMARY", "IMPACT"], True, "IMPLEMENTATION", "IDENTITY"), "b.test.ts": (["VALIDATION"], False, "VALIDATION", "INDIRECT"), "c.md": (["PRIMARY", "SUPPORT"], True, "DOCUMENTATION", "VERIFIED_LEXICAL"),
        "d.ts": (["SUPPORT"], False, "OTHER", "INDIRECT"), "e.json": (["PRIMARY", "SUPPORT"], True, "CONFIGURATION", "OWNED_SYMBOL"), "f.ts": (["SUPPORT"], False, "IMPLEMENTATION", "INDIRECT"),
    }


def test_packing_by_plans_of_their_own(spark):
    rows = [("a", 1, ["PRIMARY"], "IMPLEMENTATION", "IDENTITY", True), ("t", 2, ["VALIDATION"], "VALIDATION", "INDIRECT", False), ("i", 3, ["IMPACT"], "IMPLEMENTATION", "INDIRECT", False), ("s", 4, ["SUPPORT"], "DOCUMENTATION", "INDIRECT", False)]
    c = spark.createDataFrame([(t, *r) for t in (1, 2, 3) for r in rows], "task_id int, path string, rank int, roles array<string>, facet string, directness string, strong boolean")
    lv = spark.createDataFrame([(t, r[0], 0, 50) for t in (1, 2, 3) for r in rows], "task_id int, path string, level int, tokens int")
    modes = spark.createDataFrame([(1, "REFACTOR", "GENERAL"), (2, "TEST", "GENERAL"), (3, "UNDERSTAND", "GENERAL")], "task_id int, action string, mode string")
    got: dict = {}
    for r in pack.by_plan(c, lv, 1000, 0, plan=task_plan.pack_plans(modes)).orderBy("task_id", "spent").collect():
        got.setdefault(r["task_id"], []).append((r["path"], r["phase"]))
    assert got[1] == [("a", "ANCHOR"), ("i", "OPPORTUNITY"), ("t", "OPPORTUNITY"), ("s", "GLOBAL")]
    assert got[2] == [("a", "ANCHOR"), ("t", "OPPORTUNITY"), ("i", "OPPORTUNITY"), ("s", "GLOBAL")]
    assert got[3] == [("a", "ANCHOR"), ("i", "OPPORTUNITY"), ("s", "OPPORTUNITY"), ("t", "GLOBAL")]


def test_fusion_caps_by_source(spark):
    rows = [(1, "a", f"i{n}", "EXACT_SYMBOL", "IDENTITY", 1.0 + n) for n in range(40)] + [(1, "a", f"v{n}", "VERIFIED_LEXICAL", "LEXICAL", 1.0 + n) for n in range(40)] + [(1, "a", f"o{n}", "LEXICAL_SYMBOL_OWNERSHIP", "SYMBOL", 9.0) for n in range(40)]
    rows += [(1, "a", f"r{n}", "CALLER", "RELATIONSHIP", 2.0) for n in range(40)] + [(1, "b", f"s{n}", "FILE_IMPORTS_FILE", "STRUCTURAL", 2.0) for n in range(40)] + [(1, "b", f"t{n}", "TEST_RELATION", "STRUCTURAL", 3.0) for n in range(20)]
    kept = scoring.fused(spark.createDataFrame(rows, "task_id int, path string, id string, kind string, family string, weight double")).collect()
    count = lambda path, first: sum(r["path"] == path and r["id"][0] == first for r in kept)
    assert count("a", "i") == 24 and count("a", "v") >= 31 and count("a", "i") + count("a", "v") + count("a", "o") == 64
    assert count("b", "t") == 20 and count("b", "s") == 12
    git = scoring.git_2(spark.createDataFrame([(1, "a", "modified", 0), (1, "b", "clean", 1), (1, "c", "deleted", 100)], "task_id int, path string, status string, commits int"))
    assert {(r["path"], r["kind"], r["weight"]) for r in git.collect()} == {("a", "GIT_DIRTY", 1.0), ("b", "GIT_RECENCY", 1.0), ("c", "GIT_RECENCY", 2.0)}


def test_letters_beyond_ascii_end_words(spark):
    tasks = spark.createDataFrame([(1, "éétest"), (2, "testé"), (3, "xtest"), (4, "über-lockß die Aßconfig")], "task_id int, text string")
    rows = {r["task_id"]: (r["action"], r["concepts"]) for r in task_plan.modes(tasks, task_plan.analyzed(tasks)).collect()}
    assert rows == {1: ("TEST", ["TEST_BEHAVIOR"]), 2: ("TEST", ["TEST_BEHAVIOR"]), 3: ("CHANGE", []), 4: ("CHANGE", ["CONCURRENCY", "TRANSACTION_OR_LOCK", "CONFIGURATION"])}
    phrases = S.signals(spark.createDataFrame([(1, "éBEGIN IMMEDIATEé")], "task_id int, text string"))
    assert phrases.filter("kind = 'CODE_LITERAL' and value = 'BEGIN IMMEDIATE'").count() == 1
