"""Ignore layers: patterns, negation, nesting, families."""

from pyspark.sql import functions as F

from siltstone.operators import ignore
from siltstone.sources import files


def left_out(spark, texts, paths, families=ignore.FAMILIES):
    table = ignore.rules(spark.createDataFrame([(p, bytearray(t.encode() if isinstance(t, str) else t)) for p, t in texts.items()], "path string, content binary"), families)
    found = ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), table)
    return {r["path"]: (r["at"], ignore.FAMILIES[r["family"]]) for r in found.collect()}


CASES = [
    ("*.log", ["a.log", "x/y/b.LOG"], ["a.log.txt", "log"]),
    ("/top.txt", ["top.txt"], ["x/top.txt"]),
    ("build/", ["build/a", "x/build/deep/b"], ["build", "x/build.txt"]),
    ("docs/*.md", ["docs/a.md"], ["docs/x/a.md", "x/docs/a.md"]),
    ("docs/**/a.md", ["docs/a.md", "docs/x/y/a.md"], ["docs/b.md", "a.md"]),
    ("**/tmp", ["tmp", "x/tmp", "x/tmp/y"], ["tmpx"]),
    ("out/**", ["out/a", "out/x/y"], ["out", "x/out/a"]),
    ("f?o.[ch]", ["foo.c", "x/fzo.h"], ["fo.c", "foo.d", "f/o.c"]),
    ("[!a]x", ["bx"], ["ax"]),
    ("[z-a]x", [], ["bx", "zx"]),
    ("a[]]b", ["a]b"], ["ab"]),
    (r"\#x", ["#x"], ["x"]),
    (r"\!x", ["!x"], ["x"]),
    ("# comment\n\n   \nx", ["x"], ["# comment", "y"]),
    ("trail  \nkept\\ ", ["trail", "kept "], ["trail  ", "kept"]),
    ("lone\\", [], ["lone", "lone\\"]),
    ("/", [], ["a", "b/c"]),
    ("foo.bar", ["foo.bar"], ["fooxbar"]),
    ("*", ["a", "b/c"], []),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("*.txt\n!keep.txt", ["a.txt"], ["keep.txt", "x/keep.txt"]),
    ("!keep.txt\n*.txt", ["keep.txt"], []),
    ("dir/\n!dir/keep.txt", ["dir/keep.txt", "dir/a"], []),
    ("dir/*\n!dir/keep.txt", ["dir/a"], ["dir/keep.txt"]),
]


def test_patterns(spark):
    for i, (text, hit, miss) in enumerate(CASES):
        found = left_out(spark, {".gitignore": text.replace("\n", "\r\n" if i % 2 else "\n")}, hit + miss)
        assert set(found) == set(hit), (text, found)


def test_layers_and_families(spark):
    texts = {
        ".gitignore": "*.log\nsecret/\n", "app/.gitignore": "!keep.log\n/only.txt\n!secret/\n", "app/deep/.gitignore": "keep.log\n",
        ".ignore": "*.tmp\n!*.log\n", "app/.ignore": "notes/\n", "big/.gitignore": "*\n" + "#" * (256 << 10), "bad/.gitignore": b"\xff\xfe*", "nul/.gitignore": b"*\x00",
    }
    paths = ["a.log", "app/keep.log", "app/x/keep.log", "app/deep/keep.log", "app/only.txt", "app/x/only.txt", "secret/a", "app/secret/a", "b.tmp", "app/notes/a.log", "big/a", "bad/a", "nul/a", "app/deep/ok"]
    found = left_out(spark, texts, paths)
    # the deeper file takes the folder back, but a path under it is still under a folder that the file at the root ignores
    assert found.pop("app/secret/a") == ("app/secret/a", ".gitignore")
    assert found == {
        "a.log": ("a.log", ".gitignore"), "app/deep/keep.log": ("app/deep/keep.log", ".gitignore"), "app/only.txt": ("app/only.txt", ".gitignore"), "secret/a": ("secret", ".gitignore"),
        "b.tmp": ("b.tmp", ".ignore"), "app/notes/a.log": ("app/notes", ".ignore"),
    }


def test_no_rules_and_no_paths(spark):
    assert left_out(spark, {".gitignore": ""}, ["a"]) == {}
    table = ignore.rules(spark.createDataFrame([(".gitignore", bytearray(b"*"))], "path string, content binary"))
    assert ignore.ignored(spark.createDataFrame([], "path string"), table).count() == 0
    twice = spark.createDataFrame([("a",), ("a",)], "path string").withColumn("family", F.lit("clash"))
    assert [tuple(r) for r in ignore.ignored(twice, table).collect()] == [("a", "a", 1)]


def test_scan_obeys_ignore_files(spark, tmp_path):
    for name, text in {"a.py": "x", "b.log": "x", "sub/.gitignore": "!b.log\ngone/\n", "sub/b.log": "x", "sub/gone/c.py": "x", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["path"] for r in files.scan(spark, str(tmp_path)).collect()} == {"a.py", "sub/b.log"}
    assert {r["path"]: r["reason"] for r in files.exclusions(spark.createDataFrame([("b.log",), ("sub/gone/c.py",), (".env",), ("dist/x",), ("a.py",)], "path string"), ignore.rules(files.ignore_files(spark, str(tmp_path)))).collect()} == {
        "b.log": "ignored by .gitignore", "sub/gone/c.py": "ignored by .gitignore", ".env": "sensitive", "dist/x": "ignored_builtin",
    }
