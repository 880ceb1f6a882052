"""Operators on small relations with known answers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluate, evidence, graph, pack, provenance, ranges, review, scoring, signals
from siltstone.plans import search
from siltstone.sources import files as file_source
from siltstone.sources import store

EVIDENCE = "task_id int, path string, kind string, family string, signal string, target string, weight double, distance int, source string"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_signals(spark):
    task = "Fix `MemoryService.load` in src/core/lock.ts: HTTP_503 when memory_enabled is false, retries 5000 locking"
    got = {(r["kind"], r["normalized"]) for r in signals.signals(spark.createDataFrame([(1, task)], "task_id int, text string")).collect()}
    assert {("QUALIFIED_IDENTIFIER", "memoryservice.load"), ("PATH", "src/core/lock.ts"), ("ERROR_LITERAL", "http_503"), ("IDENTIFIER", "memory_enabled"), ("CODE_LITERAL", "false"), ("NUMBER_LITERAL", "5000"), ("IDENTIFIER", "memory"), ("NATURAL_TERM", "lock")} <= got
    rows = spark.createDataFrame([(1, "please fix the bug"), (2, "   "), (3, "x" * 20_000), (4, "修复 timeout"), (5, "a\x00b\x01 word")], "task_id int, text string")
    facts = {r["task_id"]: r for r in signals.diagnostics(rows).collect()}
    assert facts[1]["low_information"] and facts[2]["n_signals"] == 0 and facts[3]["too_large"] and not facts[4]["low_information"] and facts[5]["control_characters"] == 2


def test_scores_by_known_cases(spark):
    e = lambda *x: (1, "f", *x)
    rows = [e("L", "LEXICAL", f"s{i}", "t", 60.0, 0, None) for i in range(3)] + [e("GIT_DIRTY", "GIT", None, "t", 100.0, 0, None)]
    assert rows_of(scoring.score(spark.createDataFrame(rows, EVIDENCE)), "score") == [(125.0,)]
    same = [e("L", "LEXICAL", "s", "t", 40.0, 0, None)] * 3
    assert rows_of(scoring.score(spark.createDataFrame(same, EVIDENCE)), "score") == [(40.0,)]


def test_contributions_equal_a_sequential_fold(spark):
    rng = random.Random(8)
    rows = []
    for p in range(60):
        for _ in range(rng.randrange(1, 14)):
            rows.append((1, f"p{p}", rng.choice("KLM"), rng.choice(list(scoring.FAMILY_CAPS)), rng.choice(["a", "b", None]), rng.choice("xy"), float(rng.randrange(1, 90)), rng.randrange(2), None))
    df = spark.createDataFrame(rows, EVIDENCE)
    got = {(r["path"], r["kind"], r["family"], r["signal"], r["target"], r["distance"]): r["value"] for r in scoring.contributions(df).collect()}
    best = {}
    for r in rows:
        key = (r[1], r[2], r[3], r[4], r[5], r[7])
        best[key] = max(best.get(key, 0), r[6])
    families, want = list(scoring.FAMILY_CAPS), {}
    for p in {k[0] for k in best}:
        left, lexical = dict(scoring.FAMILY_CAPS), {}
        own = sorted((k for k in best if k[0] == p), key=lambda k: (families.index(k[2]), -best[k], k[1], k[3] or "", k[4], "", k[5]))
        for k in own:
            room = lexical.get(k[3], 50) if k[2] == "LEXICAL" else 1e9
            v = max(0.0, min(left[k[2]], room, best[k]))
            left[k[2]] -= v
            if k[2] == "LEXICAL":
                lexical[k[3]] = room - v
            want[k] = v
    assert got == pytest.approx(want)
    totals = {}
    for k, v in want.items():
        totals[k[0]] = totals.get(k[0], 0) + v
    assert {r["path"]: r["score"] for r in scoring.score(df).collect()} == pytest.approx(totals)


def test_fold_scores_equal_a_loop(spark):
    rng = random.Random(2)
    families = ["IDENTITY", "LEXICAL", "SYMBOL", "RELATIONSHIP", "STRUCTURAL", "GIT"]
    rows = [(1, f"p{rng.randrange(30)}", f"id{i}", "SOURCE", rng.choice(families), rng.choice(["a", "b", None]), None, float(rng.randrange(1, 99))) for i in range(300)]
    df = spark.createDataFrame(rows, "task_id int, path string, id string, kind string, family string, signal string, symbol string, weight double")
    want = {}
    for p in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (families.index(r[4]), -r[7], r[3], r[5] or "", "", r[2]))
        left, seen, total = dict(scoring.FAMILY_CAPS_2), {}, 0
        for r in own:
            v = max(0, min(left[r[4]], seen.get(r[5], 92) if r[5] else 1e9, r[7]))
            left[r[4]] -= v
            if r[5]:
                seen[r[5]] = seen.get(r[5], 92) - v
            total += v
        direct = {r[5] for r in own if r[5] and r[4] in ("IDENTITY", "LEXICAL", "SYMBOL")}
        agree = {"LEXICAL" if r[4] == "SYMBOL" else r[4] for r in own if r[4] not in ("GIT", "RELATIONSHIP")}
        want[p] = total + min(20, max(0, len(direct) - 1) * 4) + min(24, max(0, len(agree) - 1) * 8)
    assert {r["path"]: r["score"] for r in scoring.fold_score(df).collect()} == pytest.approx(want)


def test_imports(spark):
    known = ["src/main.ts", "src/foo.ts", "src/dir/index.ts", "src/ambiguous.ts", "src/ambiguous.js", "src/both.js", "src/both.ts"]
    asked = {"./foo": "resolved_internal", "./foo.js": "resolved_internal", "./dir": "resolved_internal", "./ambiguous": "ambiguous", "react": "external", "./missing": "unresolved", "../../outside/secret.ts": "unsafe", "/abs": "unsafe", "./both.js": "ambiguous"}
    imports = spark.createDataFrame([("src/main.ts", i, s) for i, s in enumerate(asked)], "path string, ordinal int, specifier string")
    files = spark.createDataFrame([(p,) for p in known], "path string")
    got = {r["specifier"]: r for r in graph.resolve_imports(imports, files).collect()}
    assert {k: v["status"] for k, v in got.items()} == asked and got["./dir"]["target_path"] == "src/dir/index.ts" and got["./foo.js"]["target_path"] == "src/foo.ts"


def test_modules(spark):
    files = spark.createDataFrame([(p,) for p in ["pkg/__init__.py", "pkg/models.py", "pkg/sub/__init__.py", "pkg/sub/service.py", "pkg/dual.py", "pkg/dual/__init__.py", "bare/mod.py"]], "path string")
    imports = spark.createDataFrame([("x.py", i, s) for i, s in enumerate(["pkg.models", "pkg.sub.service", "requests", "pkg.missing", "pkg.dual", "bare.mod"])], "path string, ordinal int, specifier string")
    got = {r["specifier"]: r["status"] for r in graph.resolve_modules(imports, files).collect()}
    assert got == {"pkg.models": "resolved_internal", "pkg.sub.service": "resolved_internal", "requests": "external", "pkg.missing": "unresolved", "pkg.dual": "ambiguous", "bare.mod": "unresolved"}


def test_links(spark):
    files = spark.createDataFrame([("src/a/one.ts", "source"), ("tests/a/one.test.ts", "test"), ("lib/x/two.ts", "source"), ("src/y/two.ts", "source"), ("tests/y/two.test.ts", "test"), ("docs/modules.md", "documentation"), ("src/modules/run.ts", "source")], "path string, category string")
    got = rows_of(graph.link_tests(files), "source_path", "target_path", "confidence")
    assert got == [("tests/a/one.test.ts", "src/a/one.ts", 0.86), ("tests/y/two.test.ts", "src/y/two.ts", 0.84)]
    docs = spark.createDataFrame([("docs/modules.md", "See src/a/one.ts and `loadOnce` or MemoryService.")], "path string, text string")
    symbols = spark.createDataFrame([("loadOnce", "src/y/two.ts"), ("MemoryService", "lib/x/two.ts"), ("twice", "a"), ("twice", "b")], "name string, path string")
    assert rows_of(graph.link_documents(docs, files, symbols), "target_path", "confidence") == [("lib/x/two.ts", 0.82), ("src/a/one.ts", 1.0), ("src/modules/run.ts", 0.6), ("src/y/two.ts", 0.9)]


def test_expansion_caps_new_paths(spark):
    edges = spark.createDataFrame([("FILE_IMPORTS_FILE", f"m{i % 20}", f"n{i}", 1.0, "structural") for i in range(200)] + [("FILE_IMPORTS_FILE", "seed", f"m{i}", 1.0, "structural") for i in range(20)], "kind string, source_path string, target_path string, confidence double, derivation string")
    edges = graph.merge_edges(edges)
    seeds = spark.createDataFrame([(1, "seed", 100.0, 1)], "task_id int, path string, score double, rank int")
    got = graph.expand(seeds, edges, known=seeds.select("task_id", "path"))
    assert got.select("path").distinct().count() == graph.NEW_PATHS
    one = {r["path"]: r["weight"] for r in got.filter("distance = 1").collect()}
    assert len(one) == 20 and one["m0"] == pytest.approx(100 * 0.32 * 0.58 * 0.72 * (1.584962500721156 / 3.700439718141092), abs=1e-5)


def test_merge_and_sections(spark):
    rows = [("f", 145, 200, ["SYMBOL_RANGE"]), ("f", 100, 160, ["IMPORT_BLOCK"]), ("f", 100, 160, ["IMPORT_BLOCK"]), ("f", 204, 220, ["SURROUNDING_CONTEXT"]), ("f", 230, 240, ["LEXICAL_RANGE"]), ("f", 0, 5, ["LEXICAL_RANGE"])]
    df = spark.createDataFrame(rows, "path string, start_line int, end_line int, reasons array<string>")
    got = [tuple(r) for r in ranges.merge(df, 3, "path").orderBy("start_line").collect()]
    assert got == [("f", 100, 220, ["SYMBOL_RANGE", "IMPORT_BLOCK", "SURROUNDING_CONTEXT"]), ("f", 230, 240, ["LEXICAL_RANGE"])]
    text = "# Design\n```\n# no\n```\n~~~~\n## Concurrency\nlocks\n```\n# fake\n```\n## Storage\nx".replace("~~~~", "text")
    found = [(r["heading"], r["start_line"], r["end_line"]) for r in ranges.sections(spark.createDataFrame([("a.md", text), ("b.md", "no heading")], "path string, text string")).orderBy("path", "start_line").collect()]
    assert found == [("Design", 1, 12), ("Concurrency", 6, 10), ("Storage", 11, 12), ("", 1, 1)]
    asked = spark.createDataFrame([(1, "concurrency")], "task_id int, normalized string")
    best = ranges.select_sections(spark.createDataFrame([("a.md", text)], "path string, text string"), asked, 1).collect()
    assert [(r["start_line"], r["end_line"]) for r in best] == [(6, 10)]


def test_owner_must_be_unique(spark):
    symbols = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 2, 4), ("f", "c", 6, 8), ("f", "d", 6, 8)], "path string, symbol_id string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", 3), ("f", 7), ("f", 9), ("f", 11)], "path string, line int")
    assert rows_of(evidence.owners(lines, symbols), "line", "symbol_id") == [(3, "b"), (9, "a")]


def test_packers_keep_to_the_budget(spark):
    rng = random.Random(4)
    cand = [(t, f"p{i}", i, rng.choice(pack.ROLES)) for t in (1, 2) for i in range(30)]
    levels = [(t, p, lv, 50 + 100 * lv + rng.randrange(40)) for t, p, _, _ in cand for lv in range(3)]
    c = spark.createDataFrame(cand, "task_id int, path string, rank int, role string")
    lv = spark.createDataFrame(levels, "task_id int, path string, level int, tokens int")
    for budget in (300, 1500, 6000):
        got = pack.by_quota(c, lv, budget, 20).toPandas()
        for _, g in got[got["level"] >= 0].groupby("task_id"):
            assert g["tokens"].sum() + 16 * g["role"].nunique() + 20 <= budget
        assert len(got) == 60
        plan = c.select("task_id", "path", "rank", F.array(F.when(F.col("role") == "TEST", "VALIDATION").otherwise("PRIMARY")).alias("roles"), F.col("role").alias("facet"), F.lit("IDENTITY").alias("directness"), (F.col("role") == "PRIMARY_CODE").alias("strong"))
        events = pack.by_plan(plan, lv, budget, 20, facet="PRIMARY_CODE").toPandas()
        assert (events["spent"] <= budget).all()
    whole = pack.whole_files(spark.createDataFrame([(1, "a", 1, 60), (1, "b", 2, 60), (1, "c", 3, 30)], "task_id int, path string, rank int, tokens int"), 100)
    assert rows_of(whole, "path", "selected") == [("a", True), ("b", False), ("c", True)]


def test_plan_packing_by_phase(spark):
    """One anchor of the target's facet, its roles past no stronger context, then all, then larger levels."""
    rows = [("a", 1, ["PRIMARY"], "core", "OWNED_SYMBOL", True), ("b", 2, ["PRIMARY"], "api", "OWNED_SYMBOL", True), ("c", 3, ["PRIMARY"], "core", "VERIFIED_LEXICAL", True), ("t", 4, ["VALIDATION"], "test", "INDIRECT", False), ("s", 5, ["SUPPORT"], "docs", "INDIRECT", False)]
    c = spark.createDataFrame([(1, *r) for r in rows], "task_id int, path string, rank int, roles array<string>, facet string, directness string, strong boolean")
    costs = {"a": [100, 150], "b": [100, 120], "c": [900], "t": [50], "s": [40, 60, 70]}
    lv = spark.createDataFrame([(1, p, i, n) for p, ns in costs.items() for i, n in enumerate(ns)], "task_id int, path string, level int, tokens int")
    run = lambda budget, facet: [(r["path"], r["phase"], r["level"], r["spent"]) for r in pack.by_plan(c, lv, budget, 10, facet=facet).collect()]
    # the weaker candidate c does not fit; b stands before the test though it covers no new role
    assert run(400, "api") == [("b", "ANCHOR", 0, 110), ("a", "DIRECT_PRIORITY", 0, 210), ("t", "OPPORTUNITY", 0, 260), ("s", "OPPORTUNITY", 0, 300), ("a", "EXPANSION", 1, 350), ("b", "EXPANSION", 1, 370), ("s", "EXPANSION", 1, 390), ("s", "EXPANSION", 2, 400)]
    assert run(400, "none")[0] == ("a", "ANCHOR", 0, 110)
    assert run(120, None) == [("a", "ANCHOR", 0, 110)] and run(5, None) == []
    wide = c.withColumn("preferred", F.lit(1))
    cheap = spark.createDataFrame([(1, "a", 0, 90), (1, "a", 1, 60), (1, "a", 2, 30)], "task_id int, path string, level int, tokens int")
    assert [(r["path"], r["level"], r["spent"]) for r in pack.by_plan(wide, cheap, 200, 0).collect()][0] == ("a", 1, 60)


def test_quota_packing_by_phase(spark):
    rows = [("p1", 1, "PRIMARY_CODE"), ("p2", 2, "PRIMARY_CODE"), ("t1", 3, "TEST"), ("t2", 4, "TEST"), ("d1", 5, "DOCUMENTATION")]
    c = spark.createDataFrame([(1, *r) for r in rows], "task_id int, path string, rank int, role string")
    costs = {"p1": [100, 200], "p2": [300], "t1": [200], "t2": [60], "d1": [40, 80]}
    lv = spark.createDataFrame([(1, p, i, n) for p, ns in costs.items() for i, n in enumerate(ns)], "task_id int, path string, level int, tokens int")
    run = lambda budget: {r["path"]: (r["level"], r["tokens"], r["drop_reason"]) for r in pack.by_quota(c, lv, budget, 0).collect()}
    # 600: shares 270, 90, 90, 60, 60: p1, t2 and d1; then p1 and d1 grow, and t1 still fits
    assert run(600) == {"p1": (1, 200, ""), "p2": (-1, 0, "SECTION_LIMIT"), "t1": (0, 200, ""), "t2": (0, 60, ""), "d1": (1, 80, "")}
    # 300: only p1 fits its share; of the minor roles the first test does not fit, the document does; then p1 grows and d1 can't
    assert run(300) == {"p1": (1, 200, ""), "p2": (-1, 0, "SECTION_LIMIT"), "t1": (-1, 0, "SECTION_LIMIT"), "t2": (-1, 0, "SECTION_LIMIT"), "d1": (0, 40, "")}
    assert all(level == -1 and why == "SECTION_LIMIT" for level, _, why in run(90).values() if level < 0)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("a", "h1")], "path string, hash string")
    assert s.active() is None and s.publish({"files": files}) == 1 and s.active() == 1
    assert s.publish({"files": files.withColumn("hash", F.lit("h2"))}) == 2 and s.read("files").first()["hash"] == "h2"
    with pytest.raises(store.Invalid):
        s.publish({"files": files}, validate=lambda read: ["broken"])
    assert s.active() == 2 and s.read("files", 1).first()["hash"] == "h1"
    (tmp_path / "store" / "_lock").touch()
    with pytest.raises(store.Busy):
        s.publish({"files": files})
    (tmp_path / "store" / "_lock").unlink()
    s.publish({"files": files})
    assert s.generations() == [1, 2, 3] and s.clean_up() == [1]
    assert s.generations() == [2, 3] and s.active() == 3
    (tmp_path / "store" / "_lock").touch()
    os.utime(tmp_path / "store" / "_lock", (1, 1))  # a dead writer's lock
    assert s.publish({"files": files}) == 4 and not (tmp_path / "store" / "_lock").exists()


def test_store_leaves_nothing_of_a_failed_write(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("a", "h1")], "path string, hash string")
    with pytest.raises(Exception):
        s.publish({"files": files, "broken": files.selectExpr("raise_error('no') as x")})
    assert s.generations() == [] and s.publish({"files": files}) == 1


def test_sound_generation(spark):
    """Each check finds what breaks it, and nothing in a sound generation."""
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    symbols = spark.createDataFrame([("a", "s1"), ("x", "s2")], "path string, symbol_id string")
    imports = spark.createDataFrame([("a", 0), ("b", 0), ("y", 1)], "path string, ordinal int")
    resolved = spark.createDataFrame([("a", 0), ("y", 1)], "path string, ordinal int")
    edges = spark.createDataFrame([("K", "a", "b", 1.0), ("K", "a", "b", 0.5), ("K", "x", "b", 0.5), ("K", "a", "z", 1.5)], "kind string, source_path string, target_path string, confidence double")
    found = {r["check"]: r["violations"] for r in store.violations(files, symbols, imports, resolved, edges).collect()}
    assert found == dict.fromkeys(["symbol_without_file", "import_without_file", "import_not_resolved", "edge_without_source", "edge_without_target", "confidence_out_of_range", "duplicate_edge"], 1)
    sound = store.violations(files, symbols.filter("path = 'a'"), imports.filter("path = 'a'"), resolved, edges.limit(1))
    assert not any(r["violations"] for r in sound.collect())


def test_scan(spark, tmp_path):
    for name, data in {"src/a.ts": b"let a = 1", "node_modules/x.js": b"x", ".env": b"SECRET", "b.bin2": b"\x00\x01", "docs/r.md": "é".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in file_source.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.ts", "b.bin2", "docs/r.md"} and got["b.bin2"]["status"] == "binary" and got["docs/r.md"]["text"] == "é"
    with pytest.raises(file_source.ScanLimit):
        file_source.scan(spark, str(tmp_path), max_entries=2)


def test_provenance_and_review(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    assert provenance.diff(a, a, "id", ["v"]).count() == 0
    b = spark.createDataFrame([(2, "n"), (3, "z"), (4, "q")], "id int, v string")
    assert rows_of(provenance.diff(a, b, "id", ["v"]), "id", "change") == [(1, "REMOVED"), (2, "CHANGED"), (4, "ADDED")]
    c = spark.createDataFrame([("a/x.ts", "SELECTED", 3), ("b/x.ts", "DROPPED", 0)], "path string, disposition string, n_evidence int")
    q = spark.createDataFrame([(1, "a/x.ts"), (2, "x.ts"), (3, "none"), (4, "b/x.ts")], "question int, asked string")
    assert rows_of(provenance.explain(q, c), "question", "status") == [(1, "OK"), (2, "AMBIGUOUS"), (3, "NOT_CONSIDERED"), (4, "INSUFFICIENT_EVIDENCE")]
    controls = spark.createDataFrame([("PIN", "a", None, None), ("EXCLUDE", "a", None, None), ("RANGE", "b", 5, 2), ("ODD", "c", None, None)], "kind string, path string, start_line int, end_line int")
    assert {r["problem"] for r in provenance.invalid_controls(controls).collect()} == {"CONFLICT", "BAD_RANGE", "UNKNOWN_KIND"}
    patch = "@@ -1,2 +3,4 @@ x\n+a\n@@ -9 +10,0 @@\n"
    assert rows_of(review.hunks_of(spark.createDataFrame([("f", patch)], "path string, patch string")), "start_line", "lines") == [(3, 4), (10, 0)]
    assert rows_of(spark.createDataFrame([("fix the lock",), ("rename it",), ("hello",)], "t string").select(review.action_of(F.col("t")).alias("v")), "v") == [("CHANGE",), ("FIX",), ("REFACTOR",)]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a", "REQUIRED"), (1, "b", "SUPPORTING"), (2, "c", "SUPPORTING")], "task_id int, path string, importance string")
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 4), (2, "x", 1)], "task_id int, path string, rank int")
    got = {(r["task_id"], r["k"]): (r["recall"], r["required_recall"]) for r in evaluate.recall_at(ranked, gold, [1, 3, 5]).collect()}
    assert got == {(1, 1): (0.0, 0.0), (1, 3): (0.5, 1.0), (1, 5): (1.0, 1.0), (2, 1): (0.0, None), (2, 3): (0.0, None), (2, 5): (0.0, None)}
    assert rows_of(evaluate.weighted_recall(ranked.filter("path = 'a'"), gold), "task_id", "recall") == [(1, 0.666667), (2, 0.0)]


def test_search_ranks_the_service_first(spark):
    texts = {"src/app/memory-service.ts": "class MemoryService { load() { lock() } }", "tests/app/memory-service.test.ts": "test MemoryService", "src/other.ts": "nothing to see", "gen/memory-service.ts": "MemoryService"}
    files = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, text string")
    from siltstone.functions import policies as P

    files = files.withColumn("category", P.category_of(F.col("path")))
    edges = graph.merge_edges(graph.link_tests(files))
    tasks = spark.createDataFrame([(1, "Repair MemoryService locking in memory-service.ts"), (2, "please fix the bug")], "task_id int, text string")
    got = [(r["task_id"], r["path"]) for r in search.search(tasks, files, edges=edges).orderBy("task_id", "rank").collect()]
    assert got[0] == (1, "src/app/memory-service.ts") and (1, "tests/app/memory-service.test.ts") in got and not any(t == 2 or "gen/" in p for t, p in got)


def test_score_ties(spark):
    rows = [(1, 1, 9.0), (1, 2, 7.0), (1, 3, 7.0), (1, 4, 7.0), (2, 1, 5.0)]
    ranked = spark.createDataFrame(rows, "task_id int, rank int, score double")
    assert sorted(map(tuple, scoring.ties(ranked, 3, 5).collect())) == [(1, 3, 1), (1, 5, 2), (2, 3, 0), (2, 5, 0)]
    assert scoring.ties(ranked.limit(0), 5).count() == 0
