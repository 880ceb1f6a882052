"""Review contexts: change records, changed ranges and symbols, impact, and the pack made of them."""

from pyspark.sql import functions as F

from siltstone.operators import review, whole_pack


def test_records_of_varying_length(spark):
    rec = lambda *parts: "".join(p + "\0" for p in parts)
    rows = [
        (1, rec("M", "a.ts", "R100", "old.ts", "new.ts", "D", "Rx.ts", "A", "R1")), (2, rec("A", ".env", "R090", "id_rsa", "ok.ts", "R50", "ok.ts", "node_modules/x", "M", "../up")),
        (3, rec("U", "c.ts", "M", "d.ts")), (4, ""), (5, rec(*[x for i in range(65) for x in ("M", f"f{i}")])), (6, rec("R10", "only-one")), (7, None),
    ]
    got: dict = {}
    for r in review.changes_of(spark.createDataFrame(rows, "review_id int, records string")).collect():
        got.setdefault(r["review_id"], []).append((r["path"], r["previous_path"], r["status"], r["excluded"], r["problem"]))
    assert got[1] == [("a.ts", None, "MODIFIED", False, None), ("new.ts", "old.ts", "RENAMED", False, None), ("Rx.ts", None, "DELETED", False, None), ("R1", None, "ADDED", False, None)]
    assert [x[3] for x in got[2]] == [True, True, True, True]
    assert got[3][0][2:] == (None, False, "UNSUPPORTED") and got[3][1][4] is None
    assert {x[4] for x in got[5]} == {"TOO_MANY"} and len(got[5]) == 65 and not {4, 6, 7} & got.keys()


def test_symbols_that_changed(spark):
    changes = spark.createDataFrame([(1, "a", None, "MODIFIED"), (1, "n", "o", "RENAMED"), (1, "x", None, "DELETED"), (1, "f", None, "ADDED")], "review_id int, path string, previous_path string, status string")
    patch = "@@ -1,2 +1,3 @@ f\n@@ -20 +30,0 @@\n-gone\n"
    ranges = review.changed_ranges(spark.createDataFrame([(1, "a", patch), (1, "n", "@@ -5,1 +5,1 @@"), (1, "f", "@@ -0,0 +1,9 @@")], "review_id int, path string, patch string"))
    assert sorted(tuple(r)[1:] for r in ranges.collect()) == [("a", 1, 2, 1, 3), ("a", 20, 1, 30, 0), ("f", 0, 0, 1, 9), ("n", 5, 1, 5, 1)]
    sym = "path string, name string, kind string, start_line int, end_line int"
    now = spark.createDataFrame([("a", "f", "fn", 1, 4), ("a", "g", "fn", 5, 9), ("a", "h", "fn", 29, 31), ("n", "k", "fn", 4, 6), ("f", "new", "fn", 1, 9)], sym)
    before = spark.createDataFrame([("a", "f", "fn", 1, 3), ("a", "old", "fn", 19, 22), ("a", "far", "fn", 50, 52), ("o", "k", "fn", 4, 6), ("x", "z", "fn", 1, 2)], sym)
    got = {(r["path"], r["name"], r["change"]) for r in review.changed_symbols(changes, ranges, now, before).collect()}
    assert got == {("a", "f", "MODIFIED"), ("a", "h", "ADDED"), ("a", "old", "REMOVED"), ("n", "k", "MODIFIED"), ("f", "new", "ADDED")}
    shown = spark.createDataFrame([(1, "a", 1, 10)], "review_id int, path string, start_line int, end_line int")
    assert {tuple(r) for r in review.coverage(review.changed_symbols(changes, ranges, now, before), shown).collect()} == {(1, "MODIFIED", 2, 1), (1, "ADDED", 2, 0), (1, "REMOVED", 1, 0)}


def test_context_of_a_review(spark):
    records = "M\0a.ts\0D\0gone.ts\0A\0lost.ts\0M\0.env\0"
    changes = review.changes_of(spark.createDataFrame([(1, records), (2, "M\0.env\0")], "review_id int, records string"))
    files = spark.createDataFrame([("a.ts", "source", "h1"), ("a.test.ts", "test", "h2"), ("dep.ts", "source", "h3"), ("guide.md", "documentation", "h4"), ("far.ts", "source", "h5")], "path string, category string, hash string")
    edges = [("e1", "TEST_RELATES_TO_FILE", "a.test.ts", "a.ts", "heuristic"), ("e2", "FILE_IMPORTS_FILE", "a.ts", "dep.ts", "structural"), ("e3", "FILE_IMPORTS_FILE", "dep.ts", "far.ts", "structural"), ("e4", "DOCUMENT_RELATES_TO_FILE", "guide.md", "gone.ts", "heuristic")]
    edges = spark.createDataFrame(edges, "edge_id string, kind string, source_path string, target_path string, derivation string")
    symbols = spark.createDataFrame([(1, "a.ts", "f", "fn", "MODIFIED", 1, 2)], "review_id int, path string, name string, kind string, change string, start_line int, end_line int")
    candidates, reviews = review.context(changes, symbols, edges, files)
    got = sorted((r["rank"], r["path"], r["role"], r["distance"]) for r in candidates.collect())
    assert got == [(1, "a.ts", "PRIMARY_CODE", 0), (2, "a.test.ts", "TEST", 1), (3, "dep.ts", "DEPENDENCY", 1), (4, "guide.md", "DOCUMENTATION", 1)]
    about = {r["review_id"]: r for r in reviews.collect()}
    assert tuple(about[1])[2:] == (2, 2, 1, 4, 3, []) and len(about[1]["change_hash"]) == 64
    assert about[2]["diagnostics"] == ["NO_REVIEWABLE_CHANGES"] and about[2]["excluded"] == 1
    again, _ = review.context(changes, symbols, edges, files.filter("path = 'a.ts'"))
    assert [r["path"] for r in again.collect()] == ["a.ts"]
    # the pack of the review
    rows = candidates.select(F.col("review_id").alias("task_id"), "path", "rank", "role", "distance", F.lit(None).cast("string").alias("dirty"))
    levels = rows.select("task_id", "path", F.lit(0).alias("level"), F.concat(F.lit("### File\n"), "path").alias("item"))
    tasks = spark.createDataFrame([(1, "# Review\n")], "task_id int, skeleton string")
    _, packs = whole_pack.build(tasks, rows, levels, 500)
    assert [r["status"] for r in packs.collect()] == ["COMPLETE"]
