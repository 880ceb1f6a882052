"""The graph as one operator: known edges with what they rest on, and updates that equal a whole build."""

import random

from pyspark.sql import functions as F

from siltstone.functions import policies as P
from siltstone.operators import graph_build as G


def repository(spark, tree):
    """tree: path to (text, imports [(specifier, names)], symbols)."""
    files = spark.createDataFrame([(p, f"{t}|{i}|{s}") for p, (t, i, s) in tree.items()], "path string, hash string").withColumn("category", P.category_of(F.col("path")))
    imports = spark.createDataFrame([(p, n, spec, names) for p, (_, i, _) in tree.items() for n, (spec, names) in enumerate(i)], "path string, ordinal int, specifier string, names array<string>")
    docs = spark.createDataFrame([(p, t) for p, (t, _, _) in tree.items() if p.endswith(".md")], "path string, text string")
    symbols = spark.createDataFrame([(p, s, f"M.{s}") for p, (_, _, ss) in tree.items() for s in ss], "path string, name string, qualified_name string")
    return G.Repository(files, imports, docs, symbols)


def edges(built):
    return sorted((r["kind"][:4], r["source_path"], r["target_path"], r["confidence"], r["derivation"], tuple(r["evidence"])) for r in built.edges.collect())


def resolved(built):
    return sorted((r["path"], r["ordinal"], r["status"], r["target_path"], tuple(r["candidates"])) for r in built.resolved.collect())


def test_edges_and_what_they_rest_on(spark):
    tree = {
        "src/cart.ts": ("", [("./money.js", ["Money"]), ("react", [])], ["Cart"]),
        "src/money.ts": ("", [], ["Money"]),
        "tests/cart.test.ts": ("", [("../src/cart", ["Cart"]), ("./gone", ["Money"])], []),
        "docs/billing.md": ("See src/cart.ts and `M.Money`; the Cart is full.", [], []),
        "src/billing/run.ts": ("", [], ["run"]),
        "pkg/__init__.py": ("", [], []),
        "pkg/a.py": ("", [("pkg.b", []), ("pkg.c", []), ("os", [])], []),
        "pkg/b.py": ("", [], []),
    }
    built = G.build(repository(spark, tree))
    got = edges(built)
    assert ("FILE", "src/cart.ts", "src/money.ts", 1.0, "structural", ("NodeNext .js specifier mapped to .ts source", "repository-local relative import resolved to one indexed file", 'resolved import "./money.js"')) in got
    assert ("FILE", "pkg/a.py", "pkg/b.py", 1.0, "structural", ("repository-root Python import resolved to one module", 'resolved import "pkg.b"')) in got
    assert ("TEST", "tests/cart.test.ts", "src/cart.ts", 1.0, "structural", ("mirrored test/source directory structure", "test directly imports source file", "unique normalized basename match")) in got
    assert ("TEST", "tests/cart.test.ts", "src/money.ts", 0.68, "heuristic", ("imported name matches one unique indexed source symbol",)) in got
    assert [(x[2], x[3]) for x in got if x[0] == "DOCU"] == [("src/billing/run.ts", 0.6), ("src/cart.ts", 1.0), ("src/money.ts", 0.9)]
    assert len(got) == 8
    assert [x[2] for x in resolved(built)] == ["resolved_internal", "unresolved", "external", "resolved_internal", "external", "resolved_internal", "unresolved"]
    seen = {(r["section"], r["target"]) for r in G.inspect(built, spark.createDataFrame([("src/cart.ts",)], "path string")).collect()}
    assert seen == {("imports", "src/money.ts"), ("imported_by", "tests/cart.test.ts"), ("tests", "tests/cart.test.ts"), ("documentation", "docs/billing.md")}


def world(rng):
    """A random repository: few names, so that stems, symbols, tokens and imports meet."""
    words = ["cart", "money", "order", "login"]
    tree = {}
    for _ in range(rng.randint(6, 14)):
        w, d = rng.choice(words), rng.choice(["", "shop/", "lib/"])
        path = rng.choice([f"{d}src/{w}.ts", f"{d}src/{w}/index.ts", f"{d}tests/{w}.test.ts", f"docs/{w}.md", f"pkg/{w}.py", "pkg/__init__.py", f"{d}config/{w}.json"])
        name = lambda: rng.choice(words).title()
        if path.endswith(".py"):
            wanted = [(f"pkg.{rng.choice(words)}", [])]
        else:
            wanted = [(rng.choice(["../src/", "./", "../../src/"]) + rng.choice(words) + rng.choice(["", ".js"]), [name()]) for _ in range(rng.randint(0, 2))]
        tree[path] = (f"{name()} of `M.{name()}` in src/{rng.choice(words)}.ts", [] if path.endswith(("md", "json")) else wanted, [name() for _ in range(rng.randint(0, 2))])
    return tree


def test_an_update_equals_a_whole_build(spark):
    rng = random.Random(5)
    derived = total = 0
    for _ in range(3):
        before, other = world(rng), world(rng)
        after = {p: v for p, v in before.items() if rng.random() < 0.8}
        after |= {p: v for p, v in other.items() if rng.random() < 0.3}
        a, b = repository(spark, before), repository(spark, after)
        old, whole = G.build(a), G.build(b)
        new = G.update(old, a, b)
        assert edges(new) == edges(whole) and resolved(new) == resolved(whole)
        assert sorted(map(str, new.keys.collect())) == sorted(map(str, whole.keys.collect()))
        derived += G.affected(old, a, b)[0].count()
        total += len(after)
    assert derived < total


def test_nothing_changed_and_nothing_there(spark):
    tree = world(random.Random(1))
    a, none = repository(spark, tree), repository(spark, {})
    old = G.build(a)
    assert G.affected(old, a, a)[0].count() == 0 and edges(G.update(old, a, a)) == edges(old)
    assert edges(G.build(none)) == edges(G.update(old, a, none)) == []
    assert edges(G.update(G.build(none), none, a)) == edges(old)
