"""The parquet tables presented as files, tasks, symbols, edges and changes; the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies as P
from ..functions import text as T
from ..operators.signals import FILE_EXTENSIONS

#: A document's place in the tree, by its id modulo 8, so that every category occurs.
PLACES = ["src/doc_{}.ts", "tests/doc_{}.test.ts", "docs/doc_{}.md", "config/doc_{}.json", "gen/doc_{}.py", "external/doc_{}.js", "assets/doc_{}.png", "misc/doc_{}"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, text, size, hash, category): documents as files; doc N stands for N // 8, so that stems repeat."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    stem = F.col("doc_id").cast("string")
    place = F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(PLACES))):
        a, b = p.split("{}")
        place = F.when(F.col("doc_id") % 8 == i, F.concat(F.lit(a), stem, F.lit(b))).otherwise(place)
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")), place)
    out = docs.select(path.alias("path"), "doc_id", "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))
    return out.withColumn("category", P.category_of(F.col("path")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, text): all user turns, for what reads each task by itself."""
    return _asked(table(spark, sf_dir, "conversations").filter("role = 'user'"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, text): the user turns of every hundredth conversation, for what searches files with them."""
    return _asked(table(spark, sf_dir, "conversations").filter("role = 'user' and conv_id % 100 = 0"))


def _asked(turns: DataFrame) -> DataFrame:
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), "text")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(files(spark, sf_dir))


def symbols_of(files: DataFrame) -> DataFrame:
    """(path, symbol_id, name, qualified_name, start_line, end_line): windows of 1, 3 and 10 lines, named by their first word."""
    rows = files.select("path", T.logical_lines(F.col("text")).alias("lines"))
    rows = rows.select("path", "lines", F.size("lines").alias("n"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))).alias("w"))
    rows = rows.select("path", "lines", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n"), F.col("w"))).alias("start_line"))
    name = F.regexp_extract(F.element_at("lines", F.col("start_line")), r"[\p{L}\p{N}_]+", 0)
    out = rows.select("path", name.alias("name"), "w", "start_line", F.least(F.col("n"), F.col("start_line") + F.col("w") - 1).alias("end_line")).filter("name != ''")
    qualified = F.concat(F.lit("w"), F.col("w").cast("string"), F.lit("."), F.col("name"))
    out = out.withColumn("qualified_name", qualified)
    return out.select("path", T.hashed_id("sym", 24, F.col("path"), F.lit("function"), F.col("qualified_name"), F.col("start_line")).alias("symbol_id"), "name", "qualified_name", "start_line", "end_line")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, kind, source_path, target_path, confidence, derivation): a document's edge to the next with its text's words count
    neighbours: lineitem's parts and suppliers as imports, customers' nations as documentation, orders' customers as tests."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("source_path"), F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("target_path")).distinct()
    cu = table(spark, sf_dir, "customer").select(F.concat(F.lit("cust/"), F.col("c_custkey").cast("string")).alias("source_path"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("target_path")).distinct()
    su = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("source_path"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("target_path")).distinct()
    made = lambda df, kind, c, d: df.select(F.lit(kind).alias("kind"), "source_path", "target_path", F.lit(c).alias("confidence"), F.lit(d).alias("derivation"))
    out = made(li, "FILE_IMPORTS_FILE", 1.0, "structural").unionByName(made(cu, "DOCUMENT_RELATES_TO_FILE", 0.6, "heuristic")).unionByName(made(su, "TEST_RELATES_TO_FILE", 0.86, "heuristic"))
    end = lambda c: F.concat(F.lit("file:"), F.col(c))
    return out.withColumn("edge_id", T.hashed_id("edge", 24, F.col("kind"), end("source_path"), end("target_path")))


# The same views for DuckDB.
FILES_SQL = """
files_raw AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'xx'), CASE doc_id % 8
    WHEN 0 THEN 'src/doc_' || doc_id || '.ts' WHEN 1 THEN 'tests/doc_' || doc_id || '.test.ts' WHEN 2 THEN 'docs/doc_' || doc_id || '.md'
    WHEN 3 THEN 'config/doc_' || doc_id || '.json' WHEN 4 THEN 'gen/doc_' || doc_id || '.py' WHEN 5 THEN 'external/doc_' || doc_id || '.js'
    WHEN 6 THEN 'assets/doc_' || doc_id || '.png' ELSE 'misc/doc_' || doc_id END) AS path FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
files AS (SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS hash, CASE doc_id % 8
    WHEN 0 THEN 'source' WHEN 1 THEN 'test' WHEN 2 THEN 'documentation' WHEN 3 THEN 'configuration' WHEN 4 THEN 'generated'
    WHEN 5 THEN 'dependency' WHEN 6 THEN 'binary_asset' ELSE 'unknown' END AS category FROM files_raw)"""
TASKS_SQL = """
tasks AS (SELECT conv_id * 1000 + turn AS task_id, text FROM conversations WHERE role = 'user' AND conv_id % 100 = 0)"""

TURNS_SQL = """
tasks AS (SELECT conv_id * 1000 + turn AS task_id, text FROM conversations WHERE role = 'user')"""


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace(replace({x}, '\\', '/'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"


def parts(x: str) -> str:
    """Parts of an identifier as a list with repeats."""
    sep = r"'[\s_./\\:@$-]+'"
    camel = f"regexp_replace(regexp_replace({x}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(list_concat(regexp_split_to_array({x}, {sep}), regexp_split_to_array({camel}, {sep})), lambda p: {norm('p')}), lambda p: p <> '')"


def kind(x: str) -> str:
    exts = ", ".join(f"'{e}'" for e in FILE_EXTENSIONS)
    return f"""CASE WHEN regexp_matches({x}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]') THEN 'CJK_TERM'
      WHEN regexp_full_match({x}, '[0-9]{{3,}}') THEN 'NUMBER_LITERAL'
      WHEN regexp_full_match({x}, 'HTTP_[0-9]{{3}}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+') THEN 'ERROR_LITERAL'
      WHEN regexp_full_match({x}, '(?i)true|false|null|undefined') THEN 'CODE_LITERAL'
      WHEN contains({x}, '/') OR contains({x}, '\\') THEN 'PATH'
      WHEN contains({x}, '.') AND lower(string_split({x}, '.')[-1]) IN ({exts}) THEN 'FILE_NAME'
      WHEN contains({x}, '.') AND regexp_matches({x}, '[\\p{{Lu}}_-]') THEN 'QUALIFIED_IDENTIFIER'
      WHEN contains({x}, '.') THEN 'DOTTED_IDENTIFIER'
      WHEN regexp_matches({x}, '[_-]|[\\p{{Ll}}\\p{{N}}]\\p{{Lu}}|^\\p{{Lu}}[\\p{{L}}\\p{{N}}]*\\p{{Ll}}') THEN 'IDENTIFIER'
      ELSE 'NATURAL_TERM' END"""


def variants(x: str) -> str:
    n = f"len({x})"
    left = lambda k: f"left({x}, {n} - {k})"
    return f"""CASE WHEN NOT regexp_full_match({x}, '[a-z]{{5,}}') THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_filter(list_concat(
      CASE WHEN {x} LIKE '%ing' AND {n} > 6 THEN [{left(3)}, {left(3)} || 'e'] ELSE [] END,
      CASE WHEN {x} LIKE '%ied' AND {n} > 5 THEN [{left(3)} || 'y'] WHEN {x} LIKE '%ed' AND {n} > 5 THEN [{left(2)}, {left(1)}] ELSE [] END,
      CASE WHEN {x} LIKE '%ies' AND {n} > 5 THEN [{left(3)} || 'y'] WHEN {x} LIKE '%es' AND {n} > 5 THEN [{left(2)}, {left(1)}]
           WHEN {x} LIKE '%s' AND {n} > 4 THEN [{left(1)}] ELSE [] END), lambda v: len(v) >= 3)) END"""


#: Signals of `tasks`; quotes are left to a three-way alternation, as the dialect has no back-references.
SIGNALS_SQL = f"""
tok AS (
  SELECT task_id, 1 AS pass, i, t AS value, 'PATH' AS kind FROM (SELECT task_id, unnest(regexp_extract_all(text, '(?:[\\p{{L}}\\p{{N}}_$@.-]+[\\\\/])+(?:[\\p{{L}}\\p{{N}}_$@.-]+)')) AS t, generate_subscripts(regexp_extract_all(text, '(?:[\\p{{L}}\\p{{N}}_$@.-]+[\\\\/])+(?:[\\p{{L}}\\p{{N}}_$@.-]+)'), 1) AS i FROM tasks)
  UNION ALL SELECT task_id, 2, i, substr(t, 2, len(t) - 2), {kind("substr(t, 2, len(t) - 2)")} FROM (SELECT task_id, unnest(q) AS t, generate_subscripts(q, 1) AS i FROM (SELECT task_id, regexp_extract_all(text, '"[^"''`\\r\\n]{{1,256}}"|''[^"''`\\r\\n]{{1,256}}''|`[^"''`\\r\\n]{{1,256}}`') AS q FROM tasks))
  UNION ALL SELECT task_id, 3, i, t, {kind("t")} FROM (SELECT task_id, unnest(q) AS t, generate_subscripts(q, 1) AS i FROM (SELECT task_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_$@.-]+') AS q FROM tasks))),
ex AS (SELECT task_id, kind, n AS normalized, arg_max(value, pass * 1000000 + i) AS value FROM (SELECT *, {norm("value")} AS n FROM tok) GROUP BY ALL),
de AS (SELECT task_id, kind, normalized, min(value) AS derived_from FROM (
    SELECT task_id, 'IDENTIFIER' AS kind, p AS normalized, value, normalized AS own FROM (SELECT *, unnest({parts("value")}) AS p FROM ex) WHERE p <> normalized AND len(p) >= 2
    UNION ALL SELECT task_id, kind, unnest({variants("normalized")}), value, normalized FROM ex WHERE kind = 'NATURAL_TERM') GROUP BY ALL),
signals AS (SELECT *, normalized IN ('a', 'an', 'bug', 'change', 'could', 'fix', 'make', 'please', 'should', 'the', 'this', 'update') AS low_value,
    CASE WHEN origin = 'DERIVED' THEN 0.72 ELSE 1.0 END AS factor FROM (
    SELECT task_id, kind, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value, normalized, 'EXPLICIT' AS origin, NULL AS derived_from FROM ex WHERE len(normalized) BETWEEN 1 AND 256
    UNION ALL SELECT task_id, kind, normalized, normalized, 'DERIVED', derived_from FROM de WHERE len(normalized) BETWEEN 1 AND 256))"""
EDGES_SQL = """
edges AS (SELECT *, 'edge_' || left(sha256(kind || chr(0) || 'file:' || source_path || chr(0) || 'file:' || target_path), 24) AS edge_id FROM (
    SELECT DISTINCT 'FILE_IMPORTS_FILE' AS kind, 'part/' || l_partkey AS source_path, 'supp/' || l_suppkey AS target_path, 1.0 AS confidence FROM lineitem
    UNION ALL SELECT DISTINCT 'DOCUMENT_RELATES_TO_FILE', 'cust/' || c_custkey, 'nation/' || c_nationkey, 0.6 FROM customer
    UNION ALL SELECT DISTINCT 'TEST_RELATES_TO_FILE', 'supp/' || s_suppkey, 'nation/' || s_nationkey, 0.86 FROM supplier)),
adj AS (SELECT source_path AS path, target_path AS neighbour, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'FILE_IMPORTS_FILE' WHEN 'TEST_RELATES_TO_FILE' THEN 'TEST_RELATION' ELSE 'DOCUMENT_RELATION' END AS relation, confidence, edge_id FROM edges
    UNION ALL SELECT target_path, source_path, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'FILE_IMPORTED_BY' WHEN 'TEST_RELATES_TO_FILE' THEN 'TEST_RELATION' ELSE 'DOCUMENT_RELATION' END, confidence, edge_id FROM edges),
deg AS (SELECT path, count(*) AS degree FROM adj GROUP BY path)"""
SYMBOLS_SQL = """
lns AS (SELECT path, CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS lines FROM (SELECT path, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM files)),
sym AS (SELECT path, name, 'w' || w || '.' || name AS qualified_name, start_line, least(n, start_line + w - 1) AS end_line FROM (
    SELECT path, len(lines) AS n, w, start_line, regexp_extract(lines[start_line], '[\\p{L}\\p{N}_]+') AS name FROM (
        SELECT *, unnest(range(1, len(lines) + 1, w)) AS start_line FROM (SELECT *, unnest([1, 3, 10]) AS w FROM lns))) WHERE name <> ''),
symbols AS (SELECT *, 'sym_' || left(sha256(path || chr(0) || 'function' || chr(0) || qualified_name || chr(0) || start_line), 24) AS symbol_id FROM sym)"""
