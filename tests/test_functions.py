"""Column functions on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import policies as P
from siltstone.functions import text as T


def values(spark, f, *xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_token_estimates(spark):
    assert values(spark, T.estimate_tokens, "", "abc", "a\nb", "a\r\nb", "中", "😀", None) == [0, 2, 3, 3, 3, 3, None]


def test_identifiers(spark):
    assert values(spark, T.split_identifier, "parseHTTPServer2Go", "src/a_b.ts", "") == [["parsehttpserver2go", "parse", "http", "server2", "go"], ["src", "a", "b", "ts"], []]
    assert values(spark, T.normalize_term, " A\\B\t c ") == ["a/b c"]
    assert values(spark, T.word_variants, "locking", "studied", "caches", "terms", "Terms", "ring") == [["lock", "locke"], ["study"], ["cach", "cache"], ["term"], [], []]


def test_lines(spark):
    assert values(spark, T.logical_lines, "a\r\nb\n", "", "a\rb", "\n") == [["a", "b"], [""], ["a", "b"], [""]]


def test_fences_and_bounds(spark):
    assert values(spark, T.fenced, "a ```` b")[0].startswith("`````\n")
    assert values(spark, lambda c: T.bounded_text(c, 5), "abc", "abcdefgh", "a\x00b") == ["abc", "abcd…", "a�b"]
    assert values(spark, T.redact_paths, "see /home/me/x.txt and C:\\a\\b or https://example.com/a/b") == ["see <path> and <path> or https://example.com/a/b"]


@pytest.mark.parametrize(
    ("path", "category", "language"),
    [
        ("src/a.ts", "source", "TypeScript"), ("src/a.test.ts", "test", "TypeScript"), ("tests/x.py", "test", "Python"), ("pkg/test_x.py", "test", "Python"), ("docs/a.ts", "documentation", "TypeScript"),
        ("README", "documentation", None), ("a.md", "documentation", "Markdown"), ("package.json", "configuration", "JSON"), (".github/x", "configuration", None), ("gen/a.ts", "generated", "TypeScript"),
        ("a.min.js", "generated", "JavaScript"), ("external/a.js", "dependency", "JavaScript"), ("a/b.PNG", "binary_asset", None), ("x.cjs", "unknown", None), (".png", "unknown", None), ("Dockerfile", "source", "Dockerfile"),
    ],
)
def test_classes(spark, path, category, language):
    assert values(spark, P.category_of, path) == [category] and values(spark, P.language_of, path) == [language]


def test_path_rules(spark):
    assert values(spark, P.is_ignored, "a/node_modules/b", "a/DIST/b", "src/b") == [True, True, False]
    assert values(spark, P.is_sensitive, ".env", "a/.env.local", "x/id_rsa", "credentials.json", "a.pem", "src/key.ts") == [True, True, True, True, True, False]
    assert values(spark, P.is_normalized, "a/b", "/a", "a//b", "a/../b", "./a", "a\\b", "C:/a", "") == [True, False, False, False, False, False, False, False]
    content = lambda c: P.content_status(F.lit("a.txt"), F.length(c), c.cast("binary"))
    assert values(spark, content, "plain", "a\x00b", "\x01\x02\x03abc", "") == ["text", "binary", "binary", "text"]


def test_hub_damping(spark):
    df = spark.createDataFrame([(0,), (1,), (100,)], "d int").select(T.hub_damping(F.col("d")).alias("v"))
    a, b, c = [r["v"] for r in df.collect()]
    assert a == b == 1 and c < 0.3
