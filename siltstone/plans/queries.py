"""Queries over the parquet tables, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies as P
from ..functions import text as T
from ..operators import budget, capsule, evaluate, graph, graph_build, hash_tree, ignore, intervals, pack, provenance, ranges, relationships, review, scoring, task_plan, whole_pack
from ..operators import evidence as E
from ..operators import signals as S
from ..sources import store
from ..sources.shared import materialize
from . import bindings as B
from . import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


TURNS = f"WITH {B.TURNS_SQL}, {B.SIGNALS_SQL}"  # signals of all user turns
FILES, TASKS, SIGNALS, EDGES, SYMBOLS = f"WITH {B.FILES_SQL}", f"WITH {B.TASKS_SQL}", f"WITH {B.TASKS_SQL}, {B.SIGNALS_SQL}", f"WITH {B.EDGES_SQL}", f"WITH {B.FILES_SQL}, {B.SYMBOLS_SQL}"
ELIGIBLE = "category NOT IN ('generated', 'dependency', 'binary_asset')"
PRIORITY = "CASE category WHEN 'source' THEN 0 WHEN 'test' THEN 1 WHEN 'configuration' THEN 2 WHEN 'documentation' THEN 3 ELSE 4 END"
R6 = lambda x: f"floor(({x}) * 1000000 + 0.5) / 1000000"


# ---- files ----


@query(f"{FILES} SELECT path, category, size, hash FROM files")
def classify_files(spark, sf):
    return B.files(spark, sf).select("path", "category", "size", "hash")


@query(f"""{FILES} SELECT category, count(f.path) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes
FROM (SELECT unnest(['source', 'test', 'documentation', 'configuration', 'generated', 'dependency', 'binary_asset', 'unknown']) AS category) LEFT JOIN files f USING (category) GROUP BY category""")
def map_summary(spark, sf):
    every = spark.createDataFrame([(c,) for c in ("source", "test", "documentation", "configuration", "generated", "dependency", "binary_asset", "unknown")], "category string")
    counted = B.files(spark, sf).groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return every.join(counted, "category", "left").select("category", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query(f"""{FILES} SELECT CASE doc_id % 8 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Markdown' WHEN 3 THEN 'JSON' WHEN 4 THEN 'Python' WHEN 5 THEN 'JavaScript' END AS language,
  count(*) AS files FROM files GROUP BY ALL""")
def language_detect(spark, sf):
    return B.files(spark, sf).groupBy(P.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, len(list_filter(string_split(lower(path), '/'), lambda s: s IN ('.git', '.next', '.venv', '__pycache__', 'build', 'coverage', 'dist', 'node_modules', 'target', 'vendor', 'venv'))) > 0 AS ignored,
  len(list_filter(string_split(lower(path), '/'), lambda s: regexp_matches(s, '^\\.env(\\..*)?$|^id_rsa$|^credentials|^secrets|\\.(pem|key)$'))) > 0 AS sensitive,
  path <> '' AND NOT contains(path, '\\') AND NOT regexp_matches(path, '(^|/)\\.{0,2}(/|$)') AND NOT regexp_matches(path, '^[A-Za-z]:') AS normalized FROM p""".replace("\\\\", "\\"))
def path_policies(spark, sf):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = B.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", P.is_ignored(F.col("path")).alias("ignored"), P.is_sensitive(F.col("path")).alias("sensitive"), P.is_normalized(F.col("path")).alias("normalized"))


TOKENS = lambda x: f"""CASE WHEN {x} = '' THEN 0 ELSE CAST(ceil((len(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) - (len({x}) - len(replace({x}, chr(10), '')))) / 3.0)
  + ceil((octet_length(encode({x})) - len(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))) / 2.0) + (len({x}) - len(replace({x}, chr(10), ''))) + 1 AS BIGINT) END"""  # noqa: E731


@query(f"""WITH d AS (SELECT doc_id, lang, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents) SELECT doc_id, {TOKENS('t')} AS tokens FROM d""")
def token_estimate(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH d AS (SELECT lang, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents) SELECT lang, count(*) AS n, CAST(sum({TOKENS('t')}) AS BIGINT) AS tokens FROM d GROUP BY lang""")
def token_estimate_by_lang(spark, sf):
    return B.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query("""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM d)
SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(list_max(list_transform(l, lambda x: len(x))) AS INTEGER) AS longest FROM l""".replace("\\\\", "\\"))
def logical_line_stats(spark, sf):
    lines = B.table(spark, sf, "documents").select("doc_id", T.logical_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").alias("lines"), F.array_max(F.transform("l", F.length)).alias("longest"))


@query(f"""WITH p AS (SELECT page_id, unnest({B.parts('url')}) AS part FROM pages) SELECT DISTINCT page_id, part FROM p""")
def decompose_identifiers(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.explode(T.split_identifier(F.col("url"))).alias("part")).distinct()


@query(f"SELECT p_partkey, {B.norm('p_name')} AS name, {B.norm('p_type')} AS kind FROM part")
def normalize_terms(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", T.normalize_term(F.col("p_name")).alias("name"), T.normalize_term(F.col("p_type")).alias("kind"))


@query("""SELECT conv_id, turn, CASE WHEN len(text) > 60 THEN left(text, 59) || '…' ELSE text END AS shown, greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: len(x))), 0)) AS fence FROM conversations""")
def bounded_text(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.bounded_text(F.col("text"), 60).alias("shown"), F.greatest(F.lit(3), T.longest_backticks(F.col("text")) + 1).cast("long").alias("fence"))


# ---- signals ----


@query(f"{TURNS} SELECT task_id, kind, value, normalized, origin, derived_from, low_value FROM signals")
def task_signals(spark, sf):
    return S.signals(B.turns(spark, sf))


@query(f"""{TURNS} SELECT t.task_id, CAST(count(s.kind) AS BIGINT) AS n_signals, NOT coalesce(bool_or(NOT low_value AND len(normalized) >= 2), false) AS low_information FROM tasks t LEFT JOIN signals s USING (task_id) GROUP BY t.task_id""")
def low_information_tasks(spark, sf):
    return S.diagnostics(B.turns(spark, sf)).select("task_id", F.col("n_signals").cast("long").alias("n_signals"), "low_information")


@query("""SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:fix|repair|resolve|correct|bug|failure|failing|race|stale|revert)\\b') THEN 'FIX' WHEN regexp_matches(text, '(?i)\\b(?:refactor|rename|restructure|extract)\\b') THEN 'REFACTOR'
  WHEN regexp_matches(text, '(?i)\\b(?:review|audit|assess|inspect)\\b') THEN 'REVIEW' WHEN regexp_matches(text, '(?i)\\b(?:understand|explain|investigate|analy[sz]e|trace)\\b') THEN 'UNDERSTAND'
  WHEN regexp_matches(text, '(?i)\\b(?:test|spec|coverage|assert|regression)\\b') THEN 'TEST' ELSE 'CHANGE' END AS action FROM benchmark""".replace("\\\\", "\\"))
def task_actions(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", review.action_of(F.col("text")).alias("action"))


_HELD = lambda p: f"regexp_matches(text, '(?i){p}')"
_CONCEPTS = ", ".join(f"CASE WHEN {_HELD(p)} THEN '{c}' END" for c, p in review.CONCEPTS)


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter([{_CONCEPTS}], lambda x: x IS NOT NULL) AS c FROM conversations)
SELECT conv_id, turn, array_to_string(c, ',') AS concepts, array_to_string(list_filter([CASE WHEN list_has_any(c, ['CONCURRENCY', 'TRANSACTION_OR_LOCK']) THEN 'CONCURRENCY' END, CASE WHEN list_contains(c, 'STALE_SOURCE') THEN 'STALE_SOURCE' END,
  CASE WHEN list_contains(c, 'CONFIGURATION') THEN 'CONFIGURATION_VALIDATION' END, CASE WHEN list_contains(c, 'API_BOUNDARY') THEN 'PUBLIC_CONTRACT' END], lambda x: x IS NOT NULL), ',') AS risks FROM t""")
def task_concepts(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", review.concepts_of(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", F.array_join("c", ",").alias("concepts"), F.array_join(review.risks_of(F.col("c")), ",").alias("risks"))


# ---- evidence ----

COUNTS = f"""words AS (SELECT path, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_$@.-]+')) AS token FROM files),
tokens AS (SELECT path, token, count(*) AS n FROM words GROUP BY ALL),
forms AS (SELECT DISTINCT path, token, n, unnest(list_concat([{B.norm('token')}], {B.parts('token')})) AS term FROM tokens),
counts AS (SELECT path, term, CAST(least(3, sum(n)) AS INTEGER) AS n FROM forms GROUP BY ALL)"""
LOOSE = "(kind = 'CJK_TERM' OR kind = 'PATH' OR contains(normalized, ' '))"
WEIGHT = "(CASE WHEN s.kind IN ('CODE_LITERAL', 'DOTTED_IDENTIFIER', 'ERROR_LITERAL', 'FILE_NAME', 'PATH', 'QUALIFIED_IDENTIFIER') THEN 58 ELSE 28 + CASE WHEN n >= 2 THEN 8 ELSE 0 END + CASE WHEN n >= 3 THEN 4 ELSE 0 END END) * s.factor"
SUBN = lambda a, b: f"CAST(least(3, (len({a}) - len(replace({a}, {b}, ''))) / len({b})) AS INTEGER)"
IDENTITY = f"""base AS (SELECT path, string_split(path, '/')[-1] AS b FROM files WHERE {ELIGIBLE}),
keyed AS (SELECT 'EXACT_PATH' AS k, 'IDENTITY' AS family, 110 AS w, path, {B.norm('path')} AS key, path AS target FROM base
  UNION ALL SELECT 'EXACT_BASENAME', 'IDENTITY', 82, path, {B.norm('b')}, b FROM base
  UNION ALL SELECT DISTINCT 'PATH_COMPONENT', 'LEXICAL', 30, path, unnest({B.parts('path')}), path FROM base),
ident AS (SELECT task_id, path, k AS kind, family, value AS signal, target, {R6('w * factor')} AS weight, 0 AS distance, CAST(NULL AS VARCHAR) AS source FROM (
  SELECT s.*, q.path, q.k, q.family, q.w, q.target, row_number() OVER (PARTITION BY task_id, q.k, s.kind, normalized, origin ORDER BY path, target) AS rn FROM signals s JOIN keyed q ON s.normalized = q.key WHERE NOT low_value) WHERE rn <= 32)"""
LEXICAL = f"""{COUNTS},
texts AS (SELECT path, {B.norm('text')} AS t FROM files WHERE {ELIGIBLE}),
hit AS (SELECT s.*, c.path, c.n FROM signals s JOIN counts c ON s.normalized = c.term JOIN texts USING (path) WHERE NOT low_value AND NOT {LOOSE}
  UNION ALL SELECT s.*, f.path, {SUBN('f.t', 's.normalized')} FROM signals s JOIN texts f ON contains(f.t, s.normalized) WHERE NOT low_value AND {LOOSE}),
lex AS (SELECT task_id, path, 'SOURCE_LEXICAL' AS kind, 'LEXICAL' AS family, value AS signal, path AS target, {R6('weight')} AS weight, 0 AS distance, CAST(NULL AS VARCHAR) AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY weight DESC, normalized, kind, origin) AS rn FROM (SELECT s.*, {WEIGHT} AS weight FROM hit s)) WHERE rn <= 32)"""
EVIDENCE = f"{SIGNALS}, {B.FILES_SQL}, {IDENTITY}, {LEXICAL}, ev AS (SELECT * FROM ident UNION ALL SELECT * FROM lex)"
DEDUP = f"{EVIDENCE}, dd AS (SELECT task_id, path, kind, family, signal, target, distance, source, max(weight) AS weight FROM ev GROUP BY ALL)"
SCORED = f"""{DEDUP}, b1 AS (SELECT task_id, path, family, CASE WHEN family = 'LEXICAL' THEN least(50, sum(weight)) ELSE sum(weight) END AS w FROM dd GROUP BY task_id, path, family, CASE WHEN family = 'LEXICAL' THEN coalesce(signal, '') END),
b2 AS (SELECT task_id, path, least(CASE family WHEN 'IDENTITY' THEN 150 WHEN 'LEXICAL' THEN 120 WHEN 'STRUCTURAL' THEN 65 ELSE 5 END, sum(w)) AS w FROM b1 GROUP BY task_id, path, family),
sc AS (SELECT task_id, path, {R6('sum(w)')} AS score FROM b2 GROUP BY task_id, path)"""


def _eligible(spark, sf):
    return B.files(spark, sf).filter(~F.col("category").isin("generated", "dependency", "binary_asset"))


def _asked(spark, sf):
    return materialize(S.signals(B.tasks(spark, sf))), materialize(_eligible(spark, sf))


def _direct(spark, sf, k):
    """Evidence of all pairs that may be among a task's k first."""
    asked, files = _asked(spark, sf)
    return E.direct(asked, files, None, None, k)


def _named(spark, sf):
    """Evidence of the pairs that names speak for, and the words of all pairs."""
    asked, files = _asked(spark, sf)
    named, words = materialize(E.identity(asked, files)), E.Words(asked, files)
    return named, words, materialize(named.unionByName(E.of_words(words.hits(named))))


@query(f"{FILES}, {COUNTS} SELECT term, count(*) AS files, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY term")
def term_counts_capped(spark, sf):
    return E.term_counts(B.files(spark, sf)).groupBy("term").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query("""SELECT d.doc_id, b.item_id, CAST(least(3, (len(d.text) - len(replace(d.text, b.text, ''))) / len(b.text)) AS INTEGER) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""")
def substring_hits(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("_text"))
    items = B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("normalized")).filter("normalized != ''")
    hits = E.substring_counts(docs, items.select("normalized").distinct()).join(items, "normalized")
    return hits.select(F.col("path").alias("doc_id"), "item_id", "n")


@query(f"{SIGNALS}, {B.FILES_SQL}, {IDENTITY} SELECT task_id, path, kind, family, signal, target, weight FROM ident")
def identity_evidence(spark, sf):
    return E.identity(S.signals(B.tasks(spark, sf)), _eligible(spark, sf)).select("task_id", "path", "kind", "family", "signal", "target", "weight")


@query(f"{SIGNALS}, {B.FILES_SQL}, {LEXICAL} SELECT task_id, path, signal, weight FROM lex")
def lexical_evidence(spark, sf):
    return E.lexical(S.signals(B.tasks(spark, sf)), _eligible(spark, sf)).select("task_id", "path", "signal", "weight")


@query(f"{DEDUP} SELECT family, kind, count(*) AS n, round(sum(weight), 4) AS weight FROM dd GROUP BY ALL")
def evidence_dedup(spark, sf):
    asked, files = _asked(spark, sf)
    named = scoring.deduplicate(E.identity(asked, files)).groupBy("family", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    words = E.Words(asked, files).sums().filter("n > 0").select(F.lit("LEXICAL").alias("family"), F.lit("SOURCE_LEXICAL").alias("kind"), "n", "weight")
    return named.unionByName(words).select("family", "kind", "n", F.round("weight", 4).alias("weight"))


@query(f"{SCORED} SELECT task_id, path, score FROM sc")
def score_v1_capped(spark, sf):
    named, words, evidence = _named(spark, sf)
    return scoring.score(evidence).unionByName(words.scores(E.BY_WORDS, without=named))


@query(f"{SCORED} SELECT task_id, path, round(score, 3) AS total FROM sc")
def contributions_v1(spark, sf):
    """The ordered contributions add up to the score; where words alone speak for a pair, that is their capped sum."""
    named, words, evidence = _named(spark, sf)
    total = scoring.contributions(evidence).groupBy("task_id", "path").agg(F.sum("value").alias("score"))
    return total.unionByName(words.scores(E.BY_WORDS, without=named)).select("task_id", "path", F.round("score", 3).alias("total"))


@query(f"""{SCORED}, r AS (SELECT task_id, path, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, {PRIORITY}, path) AS rank FROM sc JOIN files USING (path)) SELECT task_id, CAST(rank AS INTEGER) AS rank, path, score FROM r WHERE rank <= 200""")
def rank_v1_topk(spark, sf):
    scored = scoring.score(_direct(spark, sf, 200)).join(B.files(spark, sf).select("path", "category"), "path")
    return scoring.top(scored, 200, F.desc("score"), P.category_priority(F.col("category")), F.col("path")).select("task_id", "rank", "path", "score")


BASELINE = f"""{SIGNALS}, {B.FILES_SQL},
bt AS (SELECT path, category, {B.norm('path')} AS p, {B.parts('path')} AS ps, {B.norm('text')} AS t FROM files WHERE {ELIGIBLE}),
bb AS (SELECT *, string_split(p, '/')[-1] AS b FROM bt),
br AS (SELECT task_id, path, category, (least(45, CASE WHEN normalized = b THEN 80 WHEN list_contains(ps, normalized) THEN 24 ELSE 0 END + CASE WHEN normalized = p THEN 100 ELSE 0 END)
  + CASE {SUBN('t', 'normalized')} WHEN 0 THEN 0 WHEN 1 THEN 18 WHEN 2 THEN 24 ELSE 27 END) * factor AS s
  FROM signals JOIN bb ON contains(t, normalized) OR normalized = p OR normalized = b OR list_contains(ps, normalized) WHERE NOT low_value),
bs AS (SELECT task_id, path, category, {R6('sum(s)')} AS score FROM br GROUP BY ALL),
rk AS (SELECT task_id, path, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, {PRIORITY}, path) AS rank FROM bs WHERE score > 0)"""


@query(f"{BASELINE} SELECT task_id, CAST(rank AS INTEGER) AS rank, path, score FROM rk WHERE rank <= 20")
def lexical_baseline_topk(spark, sf):
    return search.baseline(B.tasks(spark, sf), B.files(spark, sf))


@query(f"""{SIGNALS}, {B.FILES_SQL}, names AS (SELECT DISTINCT path, unnest({B.parts('path')}) AS key FROM files), c AS (SELECT key, least(257, count(DISTINCT path)) AS matches FROM names GROUP BY key)
SELECT task_id, kind, normalized, origin, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CASE WHEN coalesce(matches, 0) = 0 THEN 'UNRESOLVED' WHEN matches = 1 THEN 'UNIQUE' ELSE 'COLLIDING' END AS ambiguity,
  CASE WHEN matches >= 2 THEN {R6('greatest(0.18, 1 / log2(2.0 + matches))')} ELSE 1.0 END AS ambiguity_factor FROM signals LEFT JOIN c ON normalized = key""")
def ambiguity_resolution(spark, sf):
    names = B.files(spark, sf).select("path", F.explode(T.split_identifier(F.col("path"))).alias("key"))
    out = E.ambiguity(S.signals(B.tasks(spark, sf)), names)
    return out.select("task_id", "kind", "normalized", "origin", F.col("matches").cast("long").alias("matches"), "ambiguity", "ambiguity_factor")


@query(f"""{SYMBOLS}, loc AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line FROM lns), h AS (SELECT l.path, l.line, s.symbol_id, end_line - start_line AS span FROM loc l JOIN symbols s ON l.path = s.path AND l.line BETWEEN start_line AND end_line),
m AS (SELECT path, line, min(span) AS span FROM h GROUP BY ALL), o AS (SELECT path, line, min(symbol_id) AS symbol_id, count(*) AS n FROM h JOIN m USING (path, line, span) GROUP BY ALL)
SELECT path, CAST(line AS INTEGER) AS line, symbol_id FROM o WHERE n = 1""")
def ownership_narrowest(spark, sf):
    lines = B.files(spark, sf).select("path", F.explode(F.sequence(F.lit(1), F.size(T.logical_lines(F.col("text"))))).alias("line"))
    return E.owners(lines, B.symbols(spark, sf))


@query()
def score_v2_fold(spark, sf):
    return scoring.fold_score(_second(spark, sf))


@query()
def fuse_v2(spark, sf):
    kinds = {"IDENTITY": 24, "LEXICAL": 32, "SYMBOL": 32}
    kept = scoring.bounded(_second(spark, sf).withColumn("source_kind", F.col("family")), kinds, 96)
    category = B.files(spark, sf).select("path", "category")
    scored = scoring.fold_score(kept).join(category, "path")
    order = [F.col("tier"), F.desc("score"), F.desc("signals"), F.desc("families"), P.category_priority(F.col("category")), F.col("path")]
    return scoring.top(scored, scoring.FINAL, *order).select("task_id", "rank", "path", "score", "tier", "signals", "families")


def _shared(spark, sf):
    """What all forms of the second search read: signals, eligible files and their symbols."""
    asked, files = _asked(spark, sf)
    return asked, files, materialize(_of(B.symbols_of(files), files))


def _second(spark, sf, ambiguity: bool = True, ownership: bool = True):
    """Direct evidence for the second scorer: names, symbols, imports, verified words and the symbols that own them.

    ambiguity and ownership may be left out, as the ablations do; a candidate keeps 64 rows, by weight."""
    return _kept_2(_rows_2(_shared(spark, sf), ambiguity), ownership)


def _rows_2(shared, ambiguity):
    asked, files, symbols = shared
    names = files.select("path", F.explode(T.split_identifier(F.col("path"))).alias("key")).unionByName(symbols.select("path", T.normalize_term(F.col("name")).alias("key")))
    named = F.broadcast(asked.select(F.col("normalized").alias("key")).distinct())
    asked = materialize(E.ambiguity(asked, names.join(named, "key", "left_semi"))) if ambiguity else asked.withColumn("ambiguity_factor", F.lit(1.0))
    return E.identity_2(asked, files, symbols, _imports_of(files)).unionByName(E.verified(asked, files, symbols))


def _kept_2(rows, ownership):
    if not ownership:
        rows = rows.filter("kind != 'LEXICAL_SYMBOL_OWNERSHIP'")
    rows = rows.groupBy("task_id", "path", "kind", "family", "signal", "target", "distance", "source", "symbol").agg(F.max("weight").alias("weight"))
    rows = rows.withColumn("id", T.hashed_id("evidence", 24, F.col("kind"), F.col("signal"), F.col("target"))).withColumn("source_kind", F.lit("DIRECT"))
    return materialize(scoring.bounded(rows, {"DIRECT": scoring.MAX_DIRECT}, scoring.MAX_DIRECT).drop("source_kind"))


def _of(symbols, files):
    return symbols.join(files.select("path"), "path", "left_semi")


# ---- graphs ----


@query(f"{EDGES} SELECT edge_id, kind, source_path, target_path, CAST(confidence AS DOUBLE) AS confidence, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'structural' ELSE 'heuristic' END AS derivation FROM edges")
def edge_merge(spark, sf):
    return graph.merge_edges(B.edges(spark, sf)).select("edge_id", "kind", "source_path", "target_path", "confidence", "derivation")


@query(f"{EDGES} SELECT path, degree, {R6('CASE WHEN degree <= 1 THEN 1.0 ELSE least(1.0, log2(3.0) / log2(2.0 + degree)) END')} AS damping FROM deg")
def degree_and_damping(spark, sf):
    return graph.degrees(B.edges(spark, sf)).select("path", "degree", T.round6(T.hub_damping(F.col("degree"))).alias("damping"))


@query(f"""{EDGES}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY factor DESC, neighbour, edge_id) AS place FROM (SELECT *, CASE relation WHEN 'FILE_IMPORTS_FILE' THEN 0.72 WHEN 'FILE_IMPORTED_BY' THEN 0.52 WHEN 'TEST_RELATION' THEN 0.78 ELSE 0.38 END AS factor FROM adj)) WHERE place <= 24),
seed AS (SELECT 'part/' || p_partkey AS path, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), top AS (SELECT * FROM seed WHERE rank <= 24),
one AS (SELECT s.path AS seed, score, rank, 1 AS distance, n.neighbour, relation, factor, confidence, place FROM top s JOIN near n ON s.path = n.path WHERE n.neighbour <> s.path),
two AS (SELECT o.seed, o.score, o.rank, 2, n.neighbour, n.relation, n.factor, n.confidence, n.place FROM (SELECT DISTINCT seed, score, rank, neighbour FROM one) o JOIN near n ON o.neighbour = n.path WHERE n.neighbour <> o.seed),
v AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT neighbour AS path, relation AS kind, distance, seed AS source, {R6("score * 0.32 * CASE distance WHEN 1 THEN 0.58 ELSE 0.34 END * factor * confidence * CASE WHEN degree <= 1 THEN 1.0 ELSE least(1.0, log2(3.0) / log2(2.0 + degree)) END")} AS weight FROM v JOIN deg ON v.neighbour = deg.path""")
def expand_two_hop(spark, sf):
    parts = B.table(spark, sf, "part").select(F.lit(1).alias("task_id"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_retailprice").alias("score"), "p_partkey")
    seeds = scoring.top(parts, graph.SEEDS, F.desc("score"), F.col("p_partkey"))
    return graph.expand(seeds, B.edges(spark, sf)).select("path", "kind", "distance", "source", "weight")


@query("""WITH e AS (SELECT user_id, count(DISTINCT event_id) AS n, max(ts) AS last_at, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) AS last FROM events GROUP BY user_id)
SELECT user_id, n AS commits, last AS last_commit, last_at, floor(least(3.0, log2(1.0 + n)) * 1000000 + 0.5) / 1000000 AS weight FROM e""")
def git_recency(spark, sf):
    events = B.table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("commit"), F.col("ts").alias("at"))
    log = events.groupBy("path").agg(F.count_distinct("commit").alias("commits"), F.max_by("commit", F.struct("at", "commit")).alias("last_commit"), F.max("at").alias("last_at"))
    weight = graph.change_evidence(log.select("path", "commits", F.lit("clean").alias("status"))).select("path", "weight")
    return log.join(weight, "path").select(F.col("path").alias("user_id"), "commits", "last_commit", "last_at", "weight")


IMPORTS = """imp AS (SELECT path, 0 AS ordinal, CASE doc_id % 5 WHEN 0 THEN './doc_' || (doc_id + 8) WHEN 1 THEN '../src/doc_' || (doc_id - doc_id % 8) WHEN 2 THEN '../../../../outside' WHEN 3 THEN 'react' ELSE '../tests/doc_' || (doc_id - doc_id % 8 + 1) || '.test.ts' END AS specifier, doc_id, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) AS up FROM files)"""


def _imports_of(files):
    i = F.col("doc_id")
    base = i - i % 8
    spec = (
        F.when(i % 5 == 0, F.concat(F.lit("./doc_"), (i + 8).cast("string"))).when(i % 5 == 1, F.concat(F.lit("../src/doc_"), base.cast("string")))
        .when(i % 5 == 2, "../../../../outside").when(i % 5 == 3, "react").otherwise(F.concat(F.lit("../tests/doc_"), (base + 1).cast("string"), F.lit(".test.ts")))
    )
    return files.select("path", F.lit(0).alias("ordinal"), spec.alias("specifier"))


@query(f"""{FILES}, {IMPORTS}, b AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/doc_' || (doc_id + 8) WHEN 1 THEN up || '/src/doc_' || (doc_id - doc_id % 8) WHEN 4 THEN up || '/tests/doc_' || (doc_id - doc_id % 8 + 1) || '.test.ts' END AS base FROM imp),
q AS (SELECT path, base, unnest(CASE WHEN doc_id % 5 IN (2, 3) THEN CAST([] AS VARCHAR[]) WHEN doc_id % 5 = 4 THEN [base] ELSE list_concat(list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || e), list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || '/index' || e)) END) AS c FROM b),
h AS (SELECT q.path, count(*) AS n, min(c) AS target FROM q JOIN files f ON q.c = f.path GROUP BY q.path)
SELECT b.path, specifier, CASE doc_id % 5 WHEN 2 THEN 'unsafe' WHEN 3 THEN 'external' ELSE CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved_internal' ELSE 'ambiguous' END END AS status, CASE WHEN n = 1 THEN target END AS target_path FROM b LEFT JOIN h USING (path)""")
def import_resolution_status(spark, sf):
    return graph.resolve_imports(_imports_of(B.files(spark, sf)), B.files(spark, sf)).select("path", "specifier", "status", "target_path")


GRAPH = f"""WITH {B.FILES_SQL.replace("doc_' || doc_id", "doc_' || (doc_id // 8)")}, {B.SYMBOLS_SQL}, own AS (SELECT s.* FROM symbols s JOIN files f USING (path) WHERE f.category = 'source'),
imp AS (SELECT path, category, doc_id, text, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) AS up, doc_id // 8 AS k FROM files WHERE {ELIGIBLE}),
b AS (SELECT path, category, doc_id % 5 AS m, regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+') AS name, CASE doc_id % 5 WHEN 0 THEN dir || '/doc_' || (k + 1) WHEN 1 THEN up || '/src/doc_' || k WHEN 4 THEN up || '/tests/doc_' || k || '.test.ts' END AS base,
  CASE doc_id % 5 WHEN 0 THEN './doc_' || (k + 1) WHEN 1 THEN '../src/doc_' || k WHEN 2 THEN '../../../../outside' WHEN 3 THEN 'react' ELSE '../tests/doc_' || k || '.test.ts' END AS specifier FROM imp),
q AS (SELECT path, unnest(CASE WHEN m = 4 THEN [base] ELSE list_concat(list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || e), list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || '/index' || e)) END) AS c FROM b WHERE base IS NOT NULL),
h AS (SELECT q.path, count(*) AS n, min(c) AS target FROM q JOIN files f ON q.c = f.path GROUP BY q.path),
res AS (SELECT b.*, CASE m WHEN 2 THEN 'unsafe' WHEN 3 THEN 'external' ELSE CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved_internal' ELSE 'ambiguous' END END AS status, CASE WHEN n = 1 THEN target END AS target FROM b LEFT JOIN h USING (path)),
un AS (SELECT name, min(path) AS target FROM own GROUP BY name HAVING count(DISTINCT path) = 1),
uq AS (SELECT name, min(path) AS target FROM (SELECT name, path FROM own UNION SELECT qualified_name, path FROM own) GROUP BY name HAVING count(DISTINCT path) = 1),
st AS (SELECT t.path, s.path AS target, t.up = s.up AS same FROM imp t JOIN imp s ON t.k = s.k AND t.category = 'test' AND s.category = 'source'),
docs AS (SELECT * FROM files WHERE category = 'documentation'), seg AS (SELECT DISTINCT path, unnest(regexp_split_to_array(lower(path), '[/.\\\\_-]+')) AS token FROM files WHERE category = 'source'),
tok AS (SELECT d.path, s.path AS target, row_number() OVER (PARTITION BY d.path ORDER BY d.token, s.path) AS n FROM (SELECT DISTINCT path, unnest(['doc', CAST(doc_id // 8 AS VARCHAR)]) AS token FROM docs) d JOIN seg s USING (token) WHERE len(token) >= 4 AND token IN (SELECT token FROM seg GROUP BY token HAVING count(*) <= 20)),
raw AS (SELECT 'FILE_IMPORTS_FILE' AS kind, path AS source_path, target AS target_path, 1.0 AS confidence, 'structural' AS derivation, unnest(['resolved import "' || specifier || '"', 'repository-local relative import resolved to one indexed file']) AS why FROM res WHERE target IS NOT NULL
  UNION ALL SELECT 'TEST_RELATES_TO_FILE', r.path, r.target, 1.0, 'structural', 'test directly imports source file' FROM res r JOIN files f ON r.target = f.path WHERE r.category = 'test' AND f.category = 'source'
  UNION ALL SELECT 'TEST_RELATES_TO_FILE', path, target, CASE WHEN same THEN 0.86 ELSE 0.72 END, 'heuristic', unnest(CASE WHEN same THEN ['unique normalized basename match', 'mirrored test/source directory structure'] ELSE ['unique normalized basename match'] END) FROM st
  UNION ALL SELECT 'TEST_RELATES_TO_FILE', path, un.target, 0.68, 'heuristic', 'imported name matches one unique indexed source symbol' FROM res JOIN un USING (name) WHERE category = 'test' AND status IN ('unresolved', 'ambiguous')
  UNION ALL SELECT 'DOCUMENT_RELATES_TO_FILE', d.path, f.path, 1.0, 'structural', 'document contains exact indexed repository path' FROM (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?:^|[\\s`''"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\\.[A-Za-z0-9]+)', 1)) AS ref FROM docs) d JOIN files f ON d.ref = f.path WHERE d.path <> f.path
  UNION ALL SELECT 'DOCUMENT_RELATES_TO_FILE', d.path, uq.target, 0.9, 'heuristic', 'document code span matches one unique indexed symbol' FROM (SELECT DISTINCT path, unnest(regexp_extract_all(text, '`([^`\\r\\n]{{1,160}})`', 1)) AS name FROM docs) d JOIN uq USING (name)
  UNION ALL SELECT 'DOCUMENT_RELATES_TO_FILE', d.path, uq.target, 0.82, 'heuristic', 'document identifier matches one unique indexed symbol' FROM (SELECT DISTINCT path, unnest(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9_$]{{3,}}(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*\\b')) AS name FROM docs) d JOIN uq USING (name)
  UNION ALL SELECT 'DOCUMENT_RELATES_TO_FILE', path, target, 0.6, 'heuristic', 'documentation module name matches source path segment' FROM tok WHERE n <= 20),
graph AS (SELECT kind, source_path, target_path, CAST(max(confidence) AS DOUBLE) AS confidence, CASE WHEN bool_or(derivation = 'structural') THEN 'structural' ELSE 'heuristic' END AS derivation, string_agg(DISTINCT why, '|' ORDER BY why) AS evidence, 'edge_' || left(sha256(kind || chr(0) || 'file:' || source_path || chr(0) || 'file:' || target_path), 24) AS edge_id FROM raw GROUP BY ALL)""".replace("\\\\", "\\")


def _repository(files):
    """The repository of files (path, doc_id, text, hash, category): imports by id, with the first word as the name imported."""
    i, k = F.col("doc_id"), F.expr("doc_id div 8").cast("string")
    spec = (
        F.when(i % 5 == 0, F.concat(F.lit("./doc_"), F.expr("doc_id div 8 + 1").cast("string"))).when(i % 5 == 1, F.concat(F.lit("../src/doc_"), k))
        .when(i % 5 == 2, "../../../../outside").when(i % 5 == 3, "react").otherwise(F.concat(F.lit("../tests/doc_"), k, F.lit(".test.ts")))
    )
    files = materialize(files)
    eligible = files.filter(~F.col("category").isin("generated", "dependency", "binary_asset"))
    imports = eligible.select("path", F.lit(0).alias("ordinal"), spec.alias("specifier"), F.array(F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0)).alias("names"))
    symbols = materialize(B.symbols_of(files.filter("category = 'source'")).select("path", "name", "qualified_name"))
    return graph_build.Repository(files.select("path", "hash", "category"), imports, files.filter("category = 'documentation'").select("path", "text"), symbols)


def _by_eights(spark, sf):
    """The files, but eight documents in a row share a stem."""
    return B.files(spark, sf).withColumn("path", F.regexp_replace("path", F.lit("doc_[0-9]+"), F.concat(F.lit("doc_"), F.expr("doc_id div 8").cast("string"))))


def _edges_of(built):
    return built.edges.withColumn("evidence", F.array_join("evidence", "|"))


@query(f"{GRAPH} SELECT * FROM graph")
def graph_full_build(spark, sf):
    return _edges_of(graph_build.build(_repository(_by_eights(spark, sf))))


@query(f"{GRAPH} SELECT * FROM graph")
def graph_incremental_build(spark, sf):
    """An earlier state lacks a tenth of the files, has other texts in a seventh, and files that are gone; its graph is brought up to date."""
    now = _by_eights(spark, sf)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Earlier "), F.upper("text"))).otherwise(F.col("text"))
    past = now.filter("doc_id % 10 != 0").withColumn("text", text).withColumn("hash", F.sha2("text", 256))
    gone = now.filter("doc_id % 10 = 1").withColumn("path", F.regexp_replace("path", r"doc_(\d+)", "old_$1"))
    before, repo = _repository(past.unionByName(gone)), _repository(now)
    return _edges_of(graph_build.update(graph_build.build(before), before, repo))


@query(f"""{GRAPH}, views AS (SELECT source_path AS path, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'imports' WHEN 'TEST_RELATES_TO_FILE' THEN 'tests' ELSE 'documentation' END AS section, target_path AS target, confidence, derivation, edge_id FROM graph
  UNION SELECT target_path, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'imported_by' WHEN 'TEST_RELATES_TO_FILE' THEN 'tests' ELSE 'documentation' END, source_path, confidence, derivation, edge_id FROM graph) SELECT * FROM views""")
def graph_inspect(spark, sf):
    repo = _repository(_by_eights(spark, sf))
    return graph_build.inspect(graph_build.build(repo), repo.files)


@query(f"""{GRAPH} SELECT 'files' AS part, category AS kind, count(*) AS n FROM files GROUP BY ALL UNION ALL SELECT 'symbols', 'all', count(*) FROM own HAVING count(*) > 0
  UNION ALL SELECT 'imports', status, count(*) FROM res GROUP BY ALL UNION ALL SELECT 'edges', kind, count(*) FROM graph GROUP BY ALL""")
def index_summary(spark, sf):
    repo = _repository(_by_eights(spark, sf))
    return graph_build.summary(repo, graph_build.build(repo))


@query("""SELECT 'tests/o/n' || n_nationkey || '.test.ts' AS source_path, CASE n_nationkey % 5 WHEN 2 THEN 'src/o/n' ELSE 'src/m/n' END || n_nationkey || '.ts' AS target_path,
  CAST(CASE n_nationkey % 5 WHEN 2 THEN 0.84 ELSE 0.72 END AS DOUBLE) AS confidence FROM nation""")
def unique_stem_link(spark, sf):
    """Every nation has a source and a test of its name; every fifth a second source, in the test's own directory."""
    k = F.col("n_nationkey").cast("string")
    path = lambda a, b: F.concat(F.lit(a), k, F.lit(b)).alias("path")
    n = B.table(spark, sf, "nation")
    paths = n.select(path("src/m/n", ".ts")).unionByName(n.filter("n_nationkey % 5 = 2").select(path("src/o/n", ".ts"))).unionByName(n.select(path("tests/o/n", ".test.ts")))
    return graph.link_tests(paths.withColumn("category", P.category_of(F.col("path")))).select("source_path", "target_path", "confidence")


@query(f"{SYMBOLS} SELECT name, min(path) AS path FROM symbols GROUP BY name HAVING count(DISTINCT path) = 1")
def unique_name_link(spark, sf):
    return graph.unique_names(B.symbols(spark, sf))


# ---- ranges ----


@query("""WITH r AS (SELECT o_custkey AS k, CAST(o_orderkey % 97 + 1 AS INTEGER) AS s, CAST(o_orderkey % 97 + 1 + o_orderkey % 5 AS INTEGER) AS e FROM orders),
a AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4 OR row_number() OVER (PARTITION BY k ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS f FROM r),
b AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s, e, f DESC ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT k, min(s) AS start_line, max(e) AS end_line FROM b GROUP BY k, g""")
def merge_ranges(spark, sf):
    k = F.col("o_orderkey")
    rows = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (k % 97 + 1).cast("int").alias("start_line"), (k % 97 + 1 + k % 5).cast("int").alias("end_line"), F.array(F.lit("SYMBOL_RANGE")).alias("reasons"))
    return ranges.merge(rows, 3, "k").select("k", "start_line", "end_line")


@query(f"{SYMBOLS}, h AS (SELECT path, unnest([2, 15]) AS s, unnest([4, 15]) AS e FROM files) SELECT h.path, h.s AS hunk, symbol_id FROM h JOIN symbols y ON h.path = y.path AND start_line <= e AND end_line >= s")
def range_overlap_symbols(spark, sf):
    hunks = B.files(spark, sf).select("path", F.explode(F.array(F.struct(F.lit(2).alias("s"), F.lit(3).alias("n")), F.struct(F.lit(15).alias("s"), F.lit(0).alias("n")))).alias("h"))
    hunks = hunks.select("path", F.col("h.s").alias("start_line"), F.col("h.n").alias("lines"))
    return review.touched(hunks, B.symbols(spark, sf)).select("path", "hunk", "symbol_id")


@query()
def section_select(spark, sf):
    marked = F.regexp_replace("text", r"(?m)^(\p{Lu}\p{L}*) ", "# $1 ")
    docs = B.files(spark, sf).filter("category = 'documentation'").select("path", marked.alias("text"))
    asked = S.signals(B.tasks(spark, sf)).filter("not low_value and origin = 'EXPLICIT'")
    return ranges.select_sections(docs, asked, 3)


# ---- state, provenance, evaluation ----


def _versions(spark, sf):
    now = B.files(spark, sf).select("doc_id", "path", "hash")
    before = now.filter("doc_id % 10 != 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    gone = now.filter("doc_id % 10 = 1").select(F.concat("path", F.lit(".old")).alias("path"), "hash")
    return before.unionByName(gone), now.select("path", "hash")


VERSIONS = f"""{FILES}, prev AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(hash) ELSE hash END AS hash FROM files WHERE doc_id % 10 <> 0 UNION ALL SELECT path || '.old', hash FROM files WHERE doc_id % 10 = 1)"""


@query(f"{VERSIONS} SELECT coalesce(p.path, f.path) AS path, CASE WHEN p.path IS NULL THEN 'ADDED' WHEN f.path IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS change FROM prev p FULL JOIN files f ON p.path = f.path WHERE p.hash IS DISTINCT FROM f.hash")
def freshness(spark, sf):
    return store.freshness(*_versions(spark, sf))


@query(f"{VERSIONS} SELECT p.path, true AS reused FROM prev p JOIN files f ON p.path = f.path AND p.hash = f.hash UNION ALL SELECT path, false FROM files f WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.path = f.path AND p.hash = f.hash)")
def incremental_reuse(spark, sf):
    kept, todo = store.reuse(*_versions(spark, sf))
    return kept.select("path", F.lit(True).alias("reused")).unionByName(todo.select("path", F.lit(False).alias("reused")))


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS x FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS x FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.x IS DISTINCT FROM b.x""")
def full_outer_diff(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("x"))
    a, b = c.filter("id % 3 != 0"), c.filter("id % 5 != 0").withColumn("x", F.when(F.col("id") % 4 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return provenance.diff(a, b, "id", ["x"]).select("id", "change")


@query("""SELECT 'customer_without_nation' AS check, count(*) AS violations FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'lineitem_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05 UNION ALL SELECT 'order_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def generation_validate(spark, sf):
    t = lambda n: B.table(spark, sf, n)
    li, o = t("lineitem"), t("orders")
    rules = {
        "customer_without_nation": t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"),
        "lineitem_without_order": li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "discount_out_of_range": li.filter(~F.col("l_discount").between(0, 0.05)),
        "order_without_lines": o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
    }
    return provenance.violations(rules)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def history_page(spark, sf):
    rows = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("saved_at"))
    return store.page(rows, 50, 100).select(F.col("id").alias("o_orderkey"), F.col("saved_at").alias("o_orderdate"))


@query(f"{FILES} SELECT 'file_' || left(sha256(path || chr(0) || hash), 24) AS id, path FROM files")
def capsule_ids(spark, sf):
    return B.files(spark, sf).select(T.hashed_id("file", 24, F.col("path"), F.col("hash")).alias("id"), "path")


GOLD = f"""{BASELINE}, ranked AS (SELECT task_id, path, rank FROM rk), tk AS (SELECT DISTINCT task_id FROM tasks),
gold AS (SELECT DISTINCT task_id, path, CASE WHEN quality = 1 THEN 'REQUIRED' ELSE 'SUPPORTING' END AS importance FROM tk JOIN labels ON doc_id % 10 = task_id % 10 JOIN files USING (doc_id) WHERE quality = 1 OR toxic = 1)"""


def _gold(spark, sf):
    tasks = B.tasks(spark, sf).select("task_id").distinct()
    marked = B.table(spark, sf, "labels").filter("quality = 1 or toxic = 1").join(B.files(spark, sf).select("doc_id", "path"), "doc_id")
    marked = marked.select((F.col("doc_id") % 10).alias("m"), "path", F.when(F.col("quality") == 1, "REQUIRED").otherwise("SUPPORTING").alias("importance"))
    return tasks.join(marked, F.col("task_id") % 10 == F.col("m")).drop("m").distinct()


@query("""WITH r AS (SELECT o_custkey AS task_id, floor(o_totalprice / 20000) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 20000) DESC, o_orderkey) AS rank FROM orders)
SELECT task_id, k, CAST(count(*) FILTER (WHERE rank <= k) - count(DISTINCT score) FILTER (WHERE rank <= k) AS BIGINT) AS ties FROM r, (SELECT unnest([5, 10]) AS k) GROUP BY ALL""")
def score_ties(spark, sf):
    """Customers as tasks, their orders as candidates, scored by price in steps."""
    o = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", F.floor(F.col("o_totalprice") / 20000).cast("double").alias("score"))
    return scoring.ties(scoring.top(o, 10, F.desc("score"), F.col("o_orderkey")), 5, 10)


@query(f"""{GOLD}, h AS (SELECT g.task_id, g.importance, k, coalesce(rank <= k, false) AS hit FROM gold g LEFT JOIN ranked r ON g.task_id = r.task_id AND g.path = r.path AND rank <= 100, (SELECT unnest([1, 3, 5, 10, 20]) AS k))
SELECT task_id, k, {R6('count(*) FILTER (WHERE hit) / count(*)')} AS recall, CASE WHEN count(*) FILTER (WHERE importance = 'REQUIRED') > 0 THEN {R6("count(*) FILTER (WHERE hit AND importance = 'REQUIRED') / count(*) FILTER (WHERE importance = 'REQUIRED')")} END AS required_recall FROM h GROUP BY task_id, k""")
def recall_at_k(spark, sf):
    return evaluate.recall_at(search.baseline(B.tasks(spark, sf), B.files(spark, sf), 100), _gold(spark, sf))


@query(f"""{GOLD} SELECT g.task_id, {R6("sum(CASE WHEN r.path IS NOT NULL THEN CASE importance WHEN 'REQUIRED' THEN 2 ELSE 1 END ELSE 0 END) / sum(CASE importance WHEN 'REQUIRED' THEN 2 ELSE 1 END)")} AS recall FROM gold g LEFT JOIN ranked r ON g.task_id = r.task_id AND g.path = r.path AND rank <= 100 GROUP BY g.task_id""")
def weighted_recall(spark, sf):
    return evaluate.weighted_recall(search.baseline(B.tasks(spark, sf), B.files(spark, sf), 100), _gold(spark, sf))


POINTS = """p AS (SELECT o_custkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'B' END AS system, o_orderpriority AS priority, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 101) / 100.0 END AS recall, o_orderkey % 5000 AS tokens FROM orders)"""


def _points(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("system"), F.col("o_orderpriority").alias("priority"), F.when(k % 11 != 0, (k % 101) / F.lit(100.0)).alias("recall"), (k % 5000).alias("tokens"))


@query(f"WITH {POINTS}, t AS (SELECT system, task_id, min(tokens) AS t FROM p WHERE recall >= 0.5 GROUP BY ALL) SELECT system, count(*) AS tasks, {R6('avg(t)')} AS mean_tokens FROM t GROUP BY system")
def matched_recall(spark, sf):
    return evaluate.matched_recall(_points(spark, sf), 0.5)


@query(f"WITH {POINTS}, q AS (SELECT task_id, system, max(recall) AS recall FROM p GROUP BY ALL) SELECT count(*) FILTER (WHERE a.recall > b.recall) AS wins, count(*) FILTER (WHERE a.recall = b.recall) AS ties, count(*) FILTER (WHERE a.recall < b.recall) AS losses FROM q a JOIN q b ON a.task_id = b.task_id AND a.system = 'A' AND b.system = 'B'")
def win_tie_loss(spark, sf):
    best = _points(spark, sf).groupBy("task_id", "system").agg(F.max("recall").alias("recall"))
    return evaluate.win_tie_loss(best, "A", "B")


@query(f"WITH {POINTS} SELECT system, priority, count(*) AS n, {R6('avg(recall)')} AS mean, {R6('quantile_cont(recall, 0.5)')} AS median, {R6('quantile_cont(recall, 0.95)')} AS p95 FROM p GROUP BY ALL")
def macro_breakdown(spark, sf):
    return evaluate.summary(_points(spark, sf), "system", "priority")


@query(f"{FILES} SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND category = 'source'")
def evidence_intersection(spark, sf):
    good = B.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return B.files(spark, sf).filter("category = 'source'").join(good, "doc_id", "left_semi").select("path")


@query(f"{VERSIONS} SELECT path FROM prev WHERE path NOT IN (SELECT path FROM files) UNION SELECT path FROM files WHERE path NOT IN (SELECT path FROM prev)")
def stale_path_union(spark, sf):
    before, now = _versions(spark, sf)
    a, b = before.select("path"), now.select("path")
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


# ---- whole plans ----


@query()
def search_v1(spark, sf):
    files = materialize(B.files(spark, sf).select("path", "doc_id", "text", "category"))  # read by every part of the plan; classified once
    links = _links(files)
    changes = B.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("commits"))
    changes = files.join(changes, F.col("doc_id") == F.col("user_id")).select("path", F.lit("clean").alias("status"), "commits")
    eligible = files.filter(~F.col("category").isin("generated", "dependency", "binary_asset"))
    symbols = materialize(_of(B.symbols_of(eligible), eligible))
    return search.search(B.tasks(spark, sf), files, symbols, _imports_of(eligible), edges=links, changes=changes)


def _next_edges(files):
    resolved = graph.resolve_imports(_imports_of(files), files).filter("target_path is not null and target_path != path")
    return resolved.select(F.lit("FILE_IMPORTS_FILE").alias("kind"), F.col("path").alias("source_path"), "target_path", F.lit(1.0).alias("confidence"), F.lit("structural").alias("derivation"))


def _candidates(spark, sf):
    """The 64 first files of each task by the baseline (task_id, rank, path, score, category), and those files with their texts."""
    files = B.files(spark, sf)
    ranked = materialize(search.baseline(B.tasks(spark, sf), files, 64))
    texts = _texts(ranked, files)
    return ranked.join(texts.select("path", "category"), "path"), texts


def _texts(candidates, files):
    """The files (path, category, text) of candidates (task_id, path), each once, however many tasks share it."""
    return materialize(files.select("path", "category", "text").join(candidates.select("path").distinct(), "path", "left_semi").dropDuplicates(["path"]))


def _ladder(candidates, texts):
    """The levels of candidates (task_id, path), whose files and symbols alone are cut into lines."""
    return ranges.ladder(candidates, texts.select("path", "text"), materialize(B.symbols_of(texts)))


@query()
def pack_whole_file(spark, sf):
    c, texts = _candidates(spark, sf)
    tokens = T.estimate_tokens(pack.render_item(F.col("path"), F.col("category"), F.lit("1-"), F.col("text")))
    return pack.whole_files(c.join(texts.select("path", tokens.alias("tokens")), "path"), 8000, 200)


@query()
def pack_v1(spark, sf):
    c, texts = _candidates(spark, sf)
    c = c.withColumn("role", pack.role_of(F.col("category"), F.lit("DIRECT")))
    return pack.by_quota(c.select("task_id", "path", "rank", "role"), _ladder(c, texts), 8000, 200)


@query()
def pack_controlled(spark, sf):
    """Whole packs under controls: the fifth candidate is pinned, the second left out, the seventh's folder in focus, ten lines
    of the third asked for; files that their document's user changed are told in the Git section."""
    _, packs = _whole_pack(spark, sf)
    return packs


@query()
def pack_items(spark, sf):
    """What the same packs hold and why the rest was dropped."""
    items, _ = _whole_pack(spark, sf)
    return items.select("task_id", "path", "role", "rank", "level", "tokens", "drop_reason")


def _whole_pack(spark, sf, tokens=3000):
    c, texts = _candidates(spark, sf)
    c = c.withColumn("role", pack.role_of(F.col("category"), F.lit("DIRECT")))
    control = F.when(F.col("rank") == 5, "PIN").when(F.col("rank") == 2, "EXCLUDE").when(F.col("rank") == 7, "FOCUS").when(F.col("rank") == 3, "RANGE")
    at = F.when(control == "FOCUS", F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    ends = texts.select("path", F.least(F.lit(10), F.size(T.logical_lines(F.col("text")))).alias("last"))
    last = F.col("last")
    controls = c.join(ends, "path").select("task_id", control.alias("kind"), at.alias("path"), F.when(control == "RANGE", 1).alias("start_line"), F.when(control == "RANGE", last).alias("end_line")).filter("kind is not null")
    controls = materialize(controls)
    levels = ranges.ladder(c, texts.select("path", "text"), materialize(B.symbols_of(texts)), controls.filter("kind = 'RANGE'"))
    levels = levels.join(c.select("task_id", "path", "role"), ["task_id", "path"])
    levels = materialize(levels.select("task_id", "path", "level", whole_pack.item(F.col("path"), F.col("role"), F.col("ranges"), F.col("whole_file"), F.col("text")).alias("item")))
    busy = B.table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    changed = B.files(spark, sf).join(busy, "doc_id", "left_semi").select("path", F.concat("path", F.lit(": modified")).alias("dirty"))
    c = c.select("task_id", "path", "rank", "role", F.lit(1).alias("distance")).join(changed, "path", "left")
    tasks = B.tasks(spark, sf).select("task_id", whole_pack.skeleton(F.col("text"), F.lit("corpus"), F.lit(1)).alias("skeleton"))
    git = tasks.select("task_id", F.array(F.lit("Branch: main"), F.concat(F.lit("HEAD: "), F.sha1(F.col("task_id").cast("string").cast("binary")))).alias("lines"))
    return whole_pack.build(tasks, materialize(c), levels, tokens, controls, git)


@query()
def pack_v2(spark, sf):
    """Packs by each task's own plan, of the second search's candidates, classified by their evidence."""
    tasks = B.tasks(spark, sf)
    found, evidence = _fused(spark, sf, ambiguity=True, ownership=True)
    c = scoring.top(found, 64, *_order_2()).select("task_id", "path", "rank", "category").withColumn("language", P.language_of(F.col("path")))
    c = materialize(task_plan.classify(c, evidence))
    levels = _ladder(c, _texts(c, B.files(spark, sf)))
    plans = task_plan.pack_plans(task_plan.modes(tasks, task_plan.analyzed(tasks)))
    return pack.by_plan(c, levels, 8000, 200, plan=plans)


@query()
def search_v2(spark, sf):
    """The second scorer with structural, relation and Git evidence, fused under caps and ranked by tier first."""
    found, _ = _fused(spark, sf)
    return scoring.top(found, 20, *_order_2()).select("task_id", "rank", "path", "score", "tier")


@query()
def search_v2_ablations(spark, sf):
    """The ten first files of each task by the second search without ambiguity, without owners, without relations, and without
    structure: what each part does to the ranking."""
    files = materialize(_plain(spark, sf))
    links, shared = _links(files), _shared(spark, sf)
    rows = materialize(_rows_2(shared, True))  # the other three read the same evidence
    whole = _kept_2(rows, True)
    seconds = {"NO_AMBIGUITY": _kept_2(_rows_2(shared, False), True), "NO_OWNERSHIP": _kept_2(rows, False), "NO_RELATIONS": whole, "NO_STRUCTURE": whole}
    out = None
    for name, second in seconds.items():
        found, _ = _fused_of(spark, sf, files, links, second, relations=name != "NO_RELATIONS", structure=name != "NO_STRUCTURE")
        rows = scoring.top(found, 10, *_order_2()).select(F.lit(name).alias("left_out"), "task_id", "rank", "path", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def _plain(spark, sf):
    """The files without their texts."""
    return B.files(spark, sf).select("path", "doc_id", "category")


def _links(files):
    return materialize(graph.merge_edges(graph.link_tests(files).unionByName(_next_edges(files))))


def _order_2():
    return [F.col("tier"), F.desc("score"), F.desc("signals"), F.desc("families"), P.category_priority(F.col("category")), F.col("path")]


def _fused(spark, sf, ambiguity=True, ownership=True):
    files = materialize(_plain(spark, sf))
    return _fused_of(spark, sf, files, _links(files), _second(spark, sf, ambiguity, ownership))


def _fused_of(spark, sf, files, links, second, relations=True, structure=True):
    """(task_id, path, score, tier, signals, families, category) and the evidence (with source and ambiguity) behind it.

    Git speaks of candidates only, and never makes one."""
    category = files.select("path", "category")
    primary = materialize(scoring.top(scoring.fold_score(second).join(category, "path"), scoring.PRIMARY, *_order_2()))
    found = materialize(primary.select("task_id", "path"))
    columns = ["task_id", "path", "id", "kind", "family", "signal", "symbol", "source", "weight"]
    none = F.lit(None).cast("string")
    rows = second.join(found, ["task_id", "path"], "left_semi").withColumn("source", none).select(*columns)
    if structure:
        near = graph.expand(primary.select("task_id", "path", "score", "rank"), links, known=found)
        near = near.withColumn("weight", F.least(F.lit(55.0), T.round6(F.col("weight") * (0.18 / graph.INHERITED)))).withColumn("id", T.hashed_id("evidence", 24, F.col("kind"), F.col("path"), F.col("source"), F.col("distance")))
        rows = rows.unionByName(near.join(category.select("path"), "path", "left_semi").withColumn("symbol", none).select(*columns))
    if relations:
        related = relationships.expand(primary, relationships.from_edges(links), found, plan_kinds=("TEST_IMPORT", "TEST_ASSOCIATION"))
        rows = rows.unionByName(related.select("task_id", "path", T.hashed_id("evidence", 24, F.col("relation_id"), F.col("source"), F.col("kind")).alias("id"), "kind", F.lit("RELATIONSHIP").alias("family"), none.alias("signal"), "symbol", "source", "weight"))
    rows = materialize(rows)
    known = rows.select("task_id", "path").distinct()
    busy = B.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("commits"))
    changes = files.join(busy, F.col("doc_id") == F.col("user_id")).select("path", F.when(F.col("doc_id") % 5 == 0, "modified").otherwise("clean").alias("status"), "commits")
    git = scoring.git_2(known.join(changes, "path"))
    rows = rows.unionByName(git.withColumns({"symbol": none, "source": none, "signal": none}).select(*columns))
    rows = materialize(scoring.fused(rows))
    return materialize(scoring.fold_score(rows.drop("source")).join(category, "path")), rows.withColumn("ambiguity", F.when(F.col("kind") == "AMBIGUOUS_SYMBOL", "COLLIDING"))


RELATED = f"""{EDGES}, rel AS (SELECT CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'FILE_DEPENDS_ON_FILE' ELSE 'TEST_ASSOCIATED_WITH_FILE' END AS type, source_path, target_path, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'EXACT' ELSE 'HIGH' END AS confidence, CASE kind WHEN 'FILE_IMPORTS_FILE' THEN 'STRUCTURAL_FACT' ELSE 'HEURISTIC' END AS classification FROM edges WHERE kind <> 'DOCUMENT_RELATES_TO_FILE')"""


@query(f"""{RELATED} SELECT 'relation_' || left(sha256(type || chr(0) || source_path || chr(0) || chr(0) || target_path || chr(0) || chr(0) || classification), 24) AS relation_id, type, source_path, target_path, confidence, classification FROM rel""")
def file_relations(spark, sf):
    return relationships.from_edges(B.edges(spark, sf)).select("relation_id", "type", "source_path", "target_path", "confidence", "classification")


@query(f"""{RELATED}, idd AS (SELECT *, 'relation_' || left(sha256(type || chr(0) || source_path || chr(0) || chr(0) || target_path || chr(0) || chr(0) || classification), 24) AS relation_id FROM rel),
dg AS (SELECT p, count(*) AS degree FROM (SELECT source_path AS p FROM idd UNION ALL SELECT target_path FROM idd) GROUP BY p),
seed AS (SELECT * FROM (SELECT 'supp/' || s_suppkey AS seed, CAST(s_acctbal AS DOUBLE) AS score, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 24),
both_ AS (SELECT seed, score, rank, i.*, target_path AS path FROM seed JOIN idd i ON seed = source_path UNION ALL SELECT seed, score, rank, i.*, source_path FROM seed JOIN idd i ON seed = target_path),
k AS (SELECT *, CASE type WHEN 'FILE_DEPENDS_ON_FILE' THEN 'BOUNDED_DEPENDENT' ELSE 'TEST_ASSOCIATION' END AS kind FROM both_),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, kind ORDER BY type, source_path, target_path, relation_id) AS n FROM k) WHERE n <= CASE kind WHEN 'BOUNDED_DEPENDENT' THEN 16 ELSE 8 END),
c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY type, source_path, target_path, relation_id) AS m FROM c1) WHERE m <= 16),
c3 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rank, type, source_path, target_path, relation_id) AS t FROM c2) WHERE t <= 256)
SELECT seed AS source, path, kind, relation_id, CASE WHEN path IN (SELECT seed FROM seed) THEN 0.0 ELSE {R6("least(18.0, score * 0.06 * CASE kind WHEN 'BOUNDED_DEPENDENT' THEN 0.62 ELSE 0.42 END * CASE confidence WHEN 'EXACT' THEN 1.0 ELSE 0.86 END * CASE WHEN greatest(a.degree, b.degree) <= 1 THEN 1.0 ELSE least(1.0, log2(3.0) / log2(2.0 + greatest(a.degree, b.degree))) END)")} END AS weight
FROM c3 JOIN dg a ON a.p = path JOIN dg b ON b.p = seed""")
def expand_relations(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.lit(1).alias("task_id"), F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_acctbal").alias("score"), F.lit(1).alias("tier"), "s_suppkey")
    seeds = materialize(scoring.top(s, 24, F.desc("score"), F.col("s_suppkey")))
    relations = relationships.from_edges(B.edges(spark, sf))
    return relationships.expand(seeds, relations, seeds.select("task_id", "path")).select("source", "path", "kind", "relation_id", "weight")


@query("""SELECT * FROM (VALUES ('contribution_without_candidate', 0::BIGINT), ('selection_without_candidate', 0), ('score_is_not_the_sum', 0), ('rank_repeats', 0), ('over_budget', 0), ('hash_differs', 0)) v("check", violations)""")
def capsule_check(spark, sf):
    """Capsules of the search and its packing hold their own invariants."""
    direct = materialize(_direct(spark, sf, 64))
    parts = materialize(scoring.contributions(direct))
    ranked = scoring.score(direct).join(B.files(spark, sf).select("path", "category"), "path")
    ranked = materialize(scoring.top(ranked, 64, F.desc("score"), P.category_priority(F.col("category")), F.col("path")))
    levels = _ladder(ranked, _texts(ranked, B.files(spark, sf)))
    roles = ranked.select("task_id", "path", "rank", pack.role_of(F.col("category"), F.lit("DIRECT")).alias("role"))
    chosen = pack.by_quota(roles, levels, 8000, 200).filter("level >= 0")
    parts = parts.join(ranked.select("task_id", "path"), ["task_id", "path"], "left_semi")
    return capsule.check(materialize(capsule.build(ranked, parts, chosen, 8000)))


# ---- ignore files ----

#: Ignore files by folder, an asterisk standing for every blog's host (the pages' hosts are folders here).
IGNORE_FILES = {
    ".gitignore": "# pages that nobody asks for\n*.html\n!4*.html\n/spam-farm.*/\nfr/\n**/es/[0-4]*\n",
    ".ignore": "www.*/en/1*\n!www.cheap-pills.example.com/en/10*\n",
    "blog.*/.gitignore": "!*.html\nde/\nen/7*\n!en/77?\n",
}


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages WHERE url IS NOT NULL),
c AS (SELECT path, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang, split_part(path, '/', 3) AS leaf FROM p WHERE regexp_full_match(path, '[^/]+/[^/]+/[^/]+')),
-- one row per rule that speaks of the page itself, by the order of the rules in their file
r AS (SELECT path, 1 AS file, 1 AS line, true AS out FROM c WHERE leaf LIKE '%.html'
  UNION ALL SELECT path, 1, 2, false FROM c WHERE leaf LIKE '4%.html' UNION ALL SELECT path, 1, 3, true FROM c WHERE lang = 'es' AND leaf[1] BETWEEN '0' AND '4'
  UNION ALL SELECT path, 2, 1, true FROM c WHERE starts_with(host, 'www.') AND lang = 'en' AND leaf LIKE '1%'
  UNION ALL SELECT path, 2, 2, false FROM c WHERE host = 'www.cheap-pills.example.com' AND lang = 'en' AND leaf LIKE '10%'
  UNION ALL SELECT path, 3, 1, false FROM c WHERE starts_with(host, 'blog.') AND leaf LIKE '%.html' UNION ALL SELECT path, 3, 2, true FROM c WHERE starts_with(host, 'blog.') AND lang = 'en' AND leaf LIKE '7%'
  UNION ALL SELECT path, 3, 3, false FROM c WHERE starts_with(host, 'blog.') AND lang = 'en' AND leaf LIKE '77_'),
f AS (SELECT path, file, arg_max(out, line) AS out FROM r GROUP BY ALL),
own AS (SELECT c.*, coalesce((SELECT out FROM f WHERE f.path = c.path AND file = 2), false) AS other,
  coalesce((SELECT out FROM f WHERE f.path = c.path AND file = 3), (SELECT out FROM f WHERE f.path = c.path AND file = 1), false) AS git FROM c)
SELECT path, CASE WHEN starts_with(host, 'spam-farm.') THEN host WHEN lang = 'fr' OR lang = 'de' AND starts_with(host, 'blog.') THEN host || '/' || lang WHEN other OR git THEN path END AS at,
  CASE WHEN starts_with(host, 'spam-farm.') OR lang = 'fr' OR lang = 'de' AND starts_with(host, 'blog.') THEN '.gitignore' WHEN other THEN '.ignore' WHEN git THEN '.gitignore' END AS reason FROM own""")
def ignore_layers(spark, sf):
    """Pages as files in folders by host and language: what nested ignore files of two families leave out, and where."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), "/+$", "")
    pages = B.table(spark, sf, "pages").filter("url is not null").select(path.alias("path")).filter(F.col("path").rlike("^[^/]+/[^/]+/[^/]+$")).distinct()
    hosts = pages.select(F.split("path", "/")[0].alias("host")).filter("host like 'blog.%'").distinct()
    at_root = spark.createDataFrame([(p, t) for p, t in IGNORE_FILES.items() if "/" not in p], "path string, text string")
    nested = hosts.select(F.concat("host", F.lit("/.gitignore")).alias("path"), F.lit(IGNORE_FILES["blog.*/.gitignore"]).alias("text"))
    table = ignore.rules(at_root.unionByName(nested).select("path", F.col("text").cast("binary").alias("content")))
    found = ignore.ignored(pages, table)
    reason = F.element_at(F.array(*[F.lit(x) for x in ignore.FAMILIES]), F.col("family") + 1)
    return pages.join(found.select("path", "at", reason.alias("reason")), "path", "left")


# ---- budgets and intervals ----


@query("""WITH RECURSIVE d AS (SELECT coalesce(source, 'none') AS task_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CASE WHEN doc_id % 7 = 0 THEN doc_id % 5 END AS turn, CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY turn NULLS LAST, path) AS i FROM d),
l AS (SELECT task_id, list(size ORDER BY i) AS sizes FROM o GROUP BY task_id),
w AS (SELECT task_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spent, 0 AS n, CAST(NULL AS BOOLEAN) AS taken, sizes FROM l
  UNION ALL SELECT task_id, i + 1, CASE WHEN n < 60 AND spent + sizes[i + 1] <= 65536 THEN spent + sizes[i + 1] ELSE spent END, CASE WHEN n < 60 AND spent + sizes[i + 1] <= 65536 THEN n + 1 ELSE n END,
    n < 60 AND spent + sizes[i + 1] <= 65536, sizes FROM w WHERE i < len(sizes))
SELECT o.task_id, path, turn, size, taken FROM o JOIN w USING (task_id, i)""")
def lexical_budget(spark, sf):
    """Each source's documents as the files of a task: those that 60 files and 64 KiB allow, in order."""
    docs = B.table(spark, sf, "documents").filter("text is not null and doc_id is not null")
    turn = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 5)
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("task_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), turn.alias("turn"), F.octet_length("text").alias("size"))
    return budget.within(rows, 60, 64 << 10)


_GOLD = "qualified_name LIKE 'w3.%' AND len(name) >= 5"
_COVER = "qualified_name LIKE 'w10.%' AND name < 'm' OR qualified_name LIKE 'w1.%'"


@query(f"""{SYMBOLS}, g AS (SELECT * FROM symbols WHERE {_GOLD}), c AS (SELECT * FROM symbols WHERE {_COVER})
SELECT symbol_id, start_line, end_line, coalesce((SELECT bool_or(c.start_line <= g.start_line AND c.end_line >= g.end_line) FROM c WHERE c.path = g.path), false) AS inside,
  coalesce((SELECT bool_or(c.start_line <= g.end_line AND c.end_line >= g.start_line) FROM c WHERE c.path = g.path), false) AS met FROM g""")
def range_coverage(spark, sf):
    """Symbols of three lines: inside a longer one, or met by any."""
    symbols = materialize(B.symbols(spark, sf))
    gold = symbols.filter(_GOLD.replace("len(", "length("))
    return intervals.inside(gold.select("path", "symbol_id", "start_line", "end_line"), symbols.filter(_COVER), "path").select("symbol_id", "start_line", "end_line", "inside", "met")


_SELECTED, _RANGES = "qualified_name LIKE 'w3.%' AND name >= 'm'", "qualified_name LIKE 'w10.%' AND name < 'q'"
_LINES = lambda t: f"SELECT DISTINCT task_id, path, unnest(range(start_line, end_line + 1)) AS line FROM {t}"
_STRETCHES = lambda t: f"""SELECT task_id, path, min(line) AS a, max(line) AS z FROM (SELECT *, line - row_number() OVER (PARTITION BY task_id, path ORDER BY line) AS island FROM {t}) GROUP BY task_id, path, island"""
_GOLD_SQL = f"""{SYMBOLS}, y AS (SELECT s.*, doc_id, doc_id % 10 AS task_id FROM symbols s JOIN files f USING (path)),
sel AS ({_LINES(f"(SELECT * FROM y WHERE {_SELECTED})")}), gf AS (SELECT path, doc_id % 10 AS task_id, doc_id FROM files WHERE doc_id % 3 = 0), gr AS (SELECT * FROM y WHERE {_RANGES} AND doc_id % 2 = 0 AND doc_id % 3 = 0)"""


@query(f"""{_GOLD_SQL}, gl AS ({_LINES("gr")}),
st AS ({_STRETCHES("sel")}), bo AS ({_STRETCHES("(SELECT * FROM sel JOIN gl USING (task_id, path, line))")}),
tk AS (SELECT task_id, path, {TOKENS("t")} AS tokens, kind FROM (SELECT task_id, path, array_to_string(lines[a:z], chr(10)) AS t, kind FROM (SELECT *, 1 AS kind FROM st UNION ALL SELECT *, 2 FROM bo) JOIN lns USING (path))),
p AS (SELECT task_id, CAST(sum(tokens) FILTER (WHERE kind = 1) AS BIGINT) AS content_tokens,
  CAST(coalesce(sum(tokens) FILTER (WHERE kind = 2), 0) + coalesce(sum(tokens) FILTER (WHERE kind = 1 AND path IN (SELECT path FROM gf) AND path NOT IN (SELECT path FROM gr)), 0) AS BIGINT) AS relevant_tokens FROM tk GROUP BY task_id)
SELECT task_id, content_tokens, relevant_tokens, CASE WHEN content_tokens > 0 THEN {R6("relevant_tokens / content_tokens")} END AS precision,
  CASE WHEN content_tokens > 0 THEN {R6(f"1 - {R6('relevant_tokens / content_tokens')}")} END AS noise FROM p""")
def token_precision(spark, sf):
    """Tasks by document number: what part of the selected tokens is gold."""
    selected, files, gold_files, gold_ranges = _selection(spark, sf)
    return intervals.token_precision(selected, gold_files, gold_ranges, files)


@query(f"""{_GOLD_SQL}, st AS ({_STRETCHES("sel")}),
g AS (SELECT task_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS w, (task_id, path) IN (SELECT (task_id, path) FROM sel) AS hit FROM gf
  UNION ALL SELECT task_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END, coalesce((SELECT bool_or(st.a <= gr.start_line AND st.z >= gr.end_line) FROM st WHERE st.path = gr.path AND st.task_id = gr.task_id), false) FROM gr)
SELECT task_id, {R6("sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w)")} AS recall, CASE WHEN count(*) FILTER (WHERE w = 2) > 0 THEN {R6("count(*) FILTER (WHERE hit AND w = 2) / count(*) FILTER (WHERE w = 2)")} END AS required_recall FROM g GROUP BY task_id""")
def gold_recall(spark, sf):
    """The same tasks: what part of the gold files and ranges is selected, by weight."""
    selected, _, gold_files, gold_ranges = _selection(spark, sf)
    importance = F.when(F.col("doc_id") % 4 == 0, "REQUIRED").otherwise("SUPPORTING").alias("importance")
    whole = gold_files.select("task_id", "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), importance)
    return intervals.gold_recall(whole.unionByName(gold_ranges.select("task_id", "path", "start_line", "end_line", importance)), selected)


def _selection(spark, sf):
    files = B.files(spark, sf)
    symbols = B.symbols_of(files).join(files.select("path", "doc_id"), "path").withColumn("task_id", F.col("doc_id") % 10)
    symbols = materialize(symbols)
    gold_files = files.filter("doc_id % 3 = 0").select("path", "doc_id", (F.col("doc_id") % 10).alias("task_id"))
    ranges_ = symbols.filter(f"{_RANGES} AND doc_id % 2 = 0 AND doc_id % 3 = 0")
    return symbols.filter(_SELECTED).select("task_id", "path", "start_line", "end_line"), files.select("path", T.logical_lines(F.col("text")).alias("lines")), gold_files, ranges_


# ---- plans of tasks ----

_ANY = lambda names: f"list_has_any(c, {names})"
_INNER = "[^\"''`\\r\\n]{1,256}"
_QUOTED = f"list_transform(regexp_extract_all(text, '\"{_INNER}\"|''{_INNER}''|`{_INNER}`'), lambda x: {B.norm('substr(x, 2, len(x) - 2)')})"
_ACTED = ", ".join(f"{_HELD(p)} AS {name.lower()}_" for name, p in review.ACTIONS)
_MODES = f"""{TURNS}, q AS (SELECT task_id, {_QUOTED} AS quoted, list_filter([{_CONCEPTS}], lambda x: x IS NOT NULL) AS c, {_ACTED}, {_HELD(task_plan.TEST_FAILURE)} AS failing FROM tasks),
k AS (SELECT task_id, bool_or(list_contains(quoted, normalized) OR kind IN ('PATH', 'QUALIFIED_IDENTIFIER')) AS exact, bool_or(NOT low_value AND (list_contains(quoted, normalized) OR kind NOT IN ('NATURAL_TERM', 'CJK_TERM'))) AS behaves FROM signals JOIN q USING (task_id) GROUP BY task_id),
m AS (SELECT task_id, CASE WHEN fix_ THEN 'FIX' WHEN refactor_ THEN 'REFACTOR' WHEN review_ THEN 'REVIEW' WHEN understand_ THEN 'UNDERSTAND' WHEN test_ THEN 'TEST' ELSE 'CHANGE' END AS action,
  CASE WHEN failing THEN 'TEST_FAILURE' WHEN {_ANY("['CONCURRENCY', 'TRANSACTION_OR_LOCK']")} THEN 'CONCURRENCY' WHEN {_ANY("['CONFIGURATION']")} THEN 'CONFIGURATION' WHEN {_ANY("['DOCUMENTATION']")} THEN 'ARCHITECTURE'
    WHEN exact THEN 'EXACT_TARGET' WHEN behaves THEN 'BEHAVIORAL' ELSE 'GENERAL' END AS mode FROM q LEFT JOIN k USING (task_id))"""


def _modes(spark, sf):
    turns = B.turns(spark, sf)
    return task_plan.modes(turns, task_plan.analyzed(turns))


@query(f"""{_MODES} SELECT task_id, action, mode,
  CASE WHEN action = 'REFACTOR' OR mode = 'CONCURRENCY' THEN 'PRIMARY,IMPACT,VALIDATION' WHEN action = 'TEST' OR mode = 'TEST_FAILURE' THEN 'PRIMARY,VALIDATION,IMPACT'
    WHEN action IN ('UNDERSTAND', 'REVIEW') OR mode = 'ARCHITECTURE' THEN 'PRIMARY,IMPACT,SUPPORT' ELSE 'PRIMARY,IMPACT,VALIDATION' END AS roles,
  CASE WHEN mode = 'TEST_FAILURE' OR action = 'TEST' THEN 'VALIDATION' WHEN mode = 'CONFIGURATION' THEN 'CONFIGURATION' WHEN mode = 'ARCHITECTURE' OR action IN ('UNDERSTAND', 'REVIEW') THEN 'DOCUMENTATION'
    WHEN NOT (mode = 'GENERAL' AND action = 'CHANGE') AND action IN ('FIX', 'CHANGE', 'REFACTOR') THEN 'IMPLEMENTATION' END AS facet FROM m""")
def task_plans(spark, sf):
    """Action, mode, the roles that have a turn of their own, and the kind of file that each user turn is after."""
    found = _modes(spark, sf)
    plans = task_plan.pack_plans(found)
    return found.join(plans, "task_id").select("task_id", "action", "mode", F.array_join(task_plan.role_order(F.col("weights")), ",").alias("roles"), "facet")


@query(f"""{_MODES}, t AS (SELECT 'CONCURRENCY' AS mode, ['PRIMARY_IMPLEMENTATION!6', 'STATE_OWNER!4', 'CALLER_OR_DEPENDENT+4', 'TEST+4', 'REPOSITORY_INSTRUCTION+1'] AS s
  UNION ALL SELECT 'TEST_FAILURE', ['TEST!4', 'PRIMARY_IMPLEMENTATION!6', 'STATE_OWNER+4', 'REPOSITORY_INSTRUCTION+1'] UNION ALL SELECT 'CONFIGURATION', ['CONFIGURATION!4', 'PRIMARY_IMPLEMENTATION!6', 'TEST+4', 'DOCUMENTATION?2', 'REPOSITORY_INSTRUCTION+1']
  UNION ALL SELECT 'ARCHITECTURE', ['DOCUMENTATION!4', 'PRIMARY_IMPLEMENTATION+6', 'TEST?2', 'REPOSITORY_INSTRUCTION+1'] UNION ALL SELECT 'EXACT_TARGET', ['PRIMARY_IMPLEMENTATION!6', 'CALLER_OR_DEPENDENT+4', 'TEST+4', 'REPOSITORY_INSTRUCTION+1']
  UNION ALL SELECT unnest(['BEHAVIORAL', 'GENERAL']), ['PRIMARY_IMPLEMENTATION!6', 'STATE_OWNER+4', 'CALLER_OR_DEPENDENT+4', 'TEST+4', 'DOCUMENTATION?2', 'REPOSITORY_INSTRUCTION+1']),
x AS (SELECT task_id, unnest(s) AS s, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS place FROM m JOIN t USING (mode))
SELECT task_id, place, regexp_extract(s, '^[A-Z_]+') AS role, CASE WHEN contains(s, '!') THEN 'REQUIRED' WHEN contains(s, '+') THEN 'PREFERRED' ELSE 'OPTIONAL' END AS priority, CASE WHEN contains(s, '!') THEN 1 ELSE 0 END AS least, CAST(s[-1] AS INTEGER) AS most FROM x""")
def context_sections(spark, sf):
    """The sections that each user turn's context has, by its mode."""
    return task_plan.sections(_modes(spark, sf)).select("task_id", "place", "role", "priority", "least", "most")


# ---- trees, histories, failures ----


def _hashed_level(k: int) -> str:
    """SQL: f{k}, the folders of level k, from the files and folders below."""
    below = f"SELECT path, 'file' AS kind, 1 AS n, hash FROM leaf WHERE depth = {k + 1}" + (f" UNION ALL SELECT path, 'folder', n, hash FROM f{k + 1}" if k < 3 else "")
    return f"""b{k} AS (SELECT parent, bucket, sum(n) AS n, sha256(string_agg(name || chr(0) || kind || chr(0) || hash, chr(10) ORDER BY name, kind, hash)) AS hash FROM (
    SELECT regexp_replace(path, '/?[^/]*$', '') AS parent, string_split(path, '/')[-1] AS name, left(sha256(string_split(path, '/')[-1]), 3) AS bucket, kind, n, hash FROM ({below})) GROUP BY parent, bucket),
f{k} AS (SELECT parent AS path, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || chr(0) || hash, chr(10) ORDER BY bucket)) AS hash FROM b{k} GROUP BY parent)"""


@query(f"""{FILES}, leaf AS (SELECT path, min(hash) AS hash, len(string_split(path, '/')) AS depth FROM files GROUP BY path), {", ".join(_hashed_level(k) for k in (3, 2, 1, 0))}
{" UNION ALL ".join(f"SELECT path, CAST({k} AS INTEGER) AS depth, n AS files, hash FROM f{k}" for k in range(4))}""")
def hash_folders(spark, sf):
    """The hash of every folder of the documents' tree."""
    return hash_tree.folders(B.files(spark, sf).select("path", "hash"))


@query("""WITH RECURSIVE i AS (SELECT 'c' || (o_orderkey % 997) AS id, CAST(o_orderdate AS TIMESTAMP) AS saved_at, repeat('x', CAST((o_orderkey % 997) % 300 AS INTEGER)) AS body, o_orderkey AS k FROM orders),
h AS (SELECT id, count(*) AS n FROM i WHERE k % 50 = 0 GROUP BY id), held AS (SELECT count(*) AS n, 10 * count(*) AS bytes FROM h),
c AS (SELECT *, len(body) AS bytes, row_number() OVER (PARTITION BY id ORDER BY saved_at, k) AS turn FROM i),
o AS (SELECT *, CASE WHEN id IN (SELECT id FROM h) OR turn > 1 THEN 'KNOWN' WHEN bytes > 280 THEN 'TOO_LARGE' END AS state FROM c),
f AS (SELECT id, bytes, row_number() OVER (ORDER BY saved_at, id) AS i FROM o WHERE state IS NULL), l AS (SELECT list(bytes ORDER BY i) AS sizes FROM f),
w AS (SELECT 0 AS i, CAST(held.bytes AS BIGINT) AS spent, held.n AS n, CAST(NULL AS BOOLEAN) AS taken, sizes FROM l, held
  UNION ALL SELECT i + 1, CASE WHEN n < 150 AND spent + sizes[i + 1] <= 15000 THEN spent + sizes[i + 1] ELSE spent END, CASE WHEN n < 150 AND spent + sizes[i + 1] <= 15000 THEN n + 1 ELSE n END, n < 150 AND spent + sizes[i + 1] <= 15000, sizes FROM w WHERE i < len(sizes))
SELECT id, outcome, count(*) AS rows FROM (SELECT o.id, coalesce(state, CASE WHEN (SELECT taken FROM w JOIN f USING (i) WHERE f.id = o.id) THEN 'SAVED' ELSE 'FULL' END) AS outcome FROM o) GROUP BY ALL""")
def history_saved(spark, sf):
    """Orders as capsules whose ids repeat: what a history of 150 entries and 15,000 bytes takes, in order of date."""
    k = F.col("o_orderkey")
    rows = B.table(spark, sf, "orders").select(F.concat(F.lit("c"), (k % 997).cast("string")).alias("id"), F.col("o_orderdate").cast("timestamp").alias("saved_at"), F.expr("repeat('x', cast(o_orderkey % 997 % 300 as int))").alias("body"), k.alias("k"))
    history = rows.filter("k % 50 = 0").select("id").distinct().withColumn("bytes", F.lit(10).cast("long"))
    return store.save(history, rows.select("id", "saved_at", "body"), 150, 15_000, 280).groupBy("id", "outcome").agg(F.count("*").alias("rows"))


_FAILING = """WITH gold AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS path, l_linenumber % 2 = 1 AS required FROM lineitem),
ranked AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS path FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_partkey % 30 < 20), sel AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS path FROM lineitem WHERE l_quantity > 25),
t AS (SELECT o_orderkey AS task_id, o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 AS lim, left(o_orderpriority, 1) IN ('1', '4') AS foreign_, o_orderpriority AS grp FROM orders),
lost AS (SELECT task_id, bool_or(near) AS packed, bool_or(NOT near) AS missed FROM (SELECT g.*, EXISTS (SELECT 1 FROM ranked r WHERE r.task_id = g.task_id AND r.path = g.path) AS near FROM gold g WHERE required AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.task_id = g.task_id AND s.path = g.path)) GROUP BY task_id),
a AS (SELECT t.task_id, grp, CASE WHEN lost.task_id IS NULL THEN 'SUCCESS' WHEN missed THEN 'FAILURE' ELSE 'WEAKNESS' END AS outcome,
  CASE WHEN lost.task_id IS NULL THEN 'NO_PRIMARY_FAILURE' WHEN missed THEN 'RETRIEVAL_MISS' WHEN lim THEN 'BUDGET_LIMIT' ELSE 'PACKING_DROP' END AS primary_cause,
  CASE WHEN lost.task_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN lim THEN 'BUDGET_LIMIT' END, CASE WHEN packed THEN 'PACKING_DROP' END, CASE WHEN missed THEN 'RETRIEVAL_MISS' END, CASE WHEN foreign_ THEN 'UNSUPPORTED' END) END AS causes FROM t LEFT JOIN lost USING (task_id))"""


def _attributed(spark, sf):
    line = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("path"), "l_suppkey", "l_quantity", "l_linenumber")
    gold = line.select("task_id", "path", F.when(F.col("l_linenumber") % 2 == 1, "REQUIRED").otherwise("SUPPORTING").alias("importance")).distinct()
    ranked = line.filter("l_suppkey % 3 <> 0").select("task_id", "path", (F.col("path") % 30 + 1).alias("rank"))
    selected = line.filter("l_quantity > 25").select("task_id", "path").distinct()
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    languages = F.when(first == "1", F.array(F.lit("python"), F.lit("rust"))).when(first == "4", F.array(F.lit("go"))).otherwise(F.array(F.lit("typescript"), F.lit("mixed")))
    tasks = B.table(spark, sf, "orders").select(key.alias("task_id"), F.when(key % 17 == 0, "NO_CONTEXT").otherwise("COMPLETE").alias("status"), (key % 23 == 0).alias("whole_file_left_out"), languages.alias("languages"), F.col("o_orderpriority").alias("group"))
    return evaluate.attribution(tasks, gold, ranked, selected), tasks


@query(f"{_FAILING} SELECT task_id, outcome, primary_cause, causes FROM a")
def failure_attribution(spark, sf):
    """Orders as tasks and their lines as gold: why required gold was not selected."""
    found, _ = _attributed(spark, sf)
    return found.select("task_id", "outcome", "primary_cause", F.array_join("causes", ",").alias("causes"))


@query(f"""{_FAILING}, n AS (SELECT grp, primary_cause, count(*) AS tasks FROM a GROUP BY ALL)
SELECT grp AS "group", primary_cause, tasks, {R6("tasks / sum(tasks) OVER (PARTITION BY grp)")} AS share FROM n""")
def failure_matrix(spark, sf):
    """The same tasks by priority and primary cause."""
    found, tasks = _attributed(spark, sf)
    return evaluate.failure_matrix(found, tasks.select("task_id", "group"))


# ---- reviews ----

_CHANGED = """c AS (SELECT l_orderkey AS review_id, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'M' ELSE 'R090' END AS code, CASE WHEN l_partkey % 19 = 0 THEN 'src/.env' ELSE 'part/' || l_partkey END AS path,
  CASE WHEN l_suppkey % 13 = 0 THEN 'node_modules/' || l_suppkey ELSE 'old/' || l_suppkey END AS old FROM lineitem WHERE l_orderkey % 7 = 0),
k AS (SELECT review_id, path, CASE WHEN code = 'R090' THEN old END AS previous_path, CASE code WHEN 'D' THEN 'DELETED' WHEN 'A' THEN 'ADDED' WHEN 'M' THEN 'MODIFIED' ELSE 'RENAMED' END AS status,
  path = 'src/.env' OR code = 'R090' AND starts_with(old, 'node_modules/') AS excluded FROM c)"""


def _name_status(spark, sf):
    """An order's lines as the records of a change set: (review_id, records)."""
    line = B.table(spark, sf, "lineitem").filter("l_orderkey % 7 = 0")
    n, text = F.col("l_linenumber") % 4, lambda c: F.col(c).cast("string")
    code = F.when(n == 0, "D").when(n == 1, "A").when(n == 2, "M").otherwise("R090")
    path = F.when(F.col("l_partkey") % 19 == 0, "src/.env").otherwise(F.concat(F.lit("part/"), text("l_partkey")))
    old = F.when(F.col("l_suppkey") % 13 == 0, F.concat(F.lit("node_modules/"), text("l_suppkey"))).otherwise(F.concat(F.lit("old/"), text("l_suppkey")))
    record = F.concat(code, F.lit("\x00"), F.when(n == 3, F.concat(old, F.lit("\x00"))).otherwise(""), path, F.lit("\x00"))
    rows = line.select(F.col("l_orderkey").alias("review_id"), F.struct("l_linenumber", "l_partkey", record.alias("r")).alias("x"))
    return rows.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "").alias("records"))


@query(f"WITH {_CHANGED} SELECT review_id, path, previous_path, status, excluded FROM k")
def review_changes(spark, sf):
    """Change sets read from records that NUL ends, renames with two paths."""
    return review.changes_of(_name_status(spark, sf)).select("review_id", "path", "previous_path", "status", "excluded")


@query(f"""{EDGES}, {_CHANGED}, own AS (SELECT DISTINCT review_id, path FROM k WHERE NOT excluded), hit AS (SELECT DISTINCT review_id, e.edge_id, source_path, target_path FROM edges e JOIN own ON own.path = e.source_path OR own.path = e.target_path),
near AS (SELECT DISTINCT review_id, p AS path FROM (SELECT review_id, unnest([source_path, target_path]) AS p FROM hit) WHERE (review_id, p) NOT IN (SELECT (review_id, path) FROM own)),
f AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY distance, path) AS INTEGER) AS place, path, distance FROM (SELECT *, 0 AS distance FROM own UNION ALL SELECT *, 1 FROM near))
SELECT review_id, place, path, CAST(distance AS INTEGER) AS distance FROM f WHERE place <= 100""")
def review_impact(spark, sf):
    """Changed parts and what is one relation away: the files of each review, in order."""
    changes = review.changes_of(_name_status(spark, sf)).filter("not excluded and problem is null")
    found, _ = review.impact(materialize(changes), materialize(B.edges(spark, sf)))
    return found


@query("""WITH o AS (SELECT *, o_orderkey AS k, 'task ' || o_custkey AS t FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT k, list_sort(list(DISTINCT 'part/' || l_partkey)) AS stale FROM o JOIN lineitem ON l_orderkey = k WHERE l_partkey % 97 = 0 OR l_partkey % 89 = 0 GROUP BY k)
SELECT CAST(k AS VARCHAR) AS capsule_hash, CASE WHEN k % 31 = 0 THEN 'INSPECTED' WHEN k % 20 = 0 THEN 'TASK_MISMATCH' WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'TASK_REQUIRED' WHEN stale IS NOT NULL THEN 'SOURCE_CHANGED'
  WHEN k % 13 = 0 THEN 'CANNOT_REPRODUCE' WHEN k % 11 = 0 THEN 'STRATEGY_UNAVAILABLE' WHEN k % 4 <> 0 THEN 'EXACT_MATCH' WHEN k % 7 <> 0 THEN 'PAYLOAD_MATCH_PROVENANCE_CHANGED' ELSE 'PAYLOAD_CHANGED' END AS status,
  CASE WHEN k % 31 <> 0 AND k % 20 <> 0 AND NOT (k % 5 = 0 AND k % 10 <> 0) THEN array_to_string(stale, ',') END AS changed FROM o LEFT JOIN s USING (k)""")
def replay_status(spark, sf):
    """Orders as recorded capsules and their parts as sources: how running each again ends."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    orders = B.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").withColumn("id", text(k)).withColumn("t", F.concat(F.lit("task "), text(F.col("o_custkey"))))
    recorded = orders.select(F.col("id").alias("capsule_hash"), F.when(k % 5 != 0, F.col("t")).alias("task"), F.sha2("t", 256).alias("task_hash"), F.lit("v1").alias("strategy"), F.lit("p").alias("payload_hash"), (k % 31 == 0).alias("inspect_only"))
    supplied = orders.filter(k % 10 == 0).select(F.col("id").alias("capsule_hash"), F.when(k % 20 == 0, "other").otherwise(F.col("t")).alias("task"))
    reproduced = orders.filter(k % 13 != 0).select(F.col("id").alias("capsule_hash"), F.when(k % 4 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("reproduced_hash"), F.when(k % 11 == 0, "v2").otherwise("v1").alias("strategy"), F.when((k % 4 == 0) & (k % 7 == 0), "q").otherwise("p").alias("payload_hash"))
    part = lambda c: F.concat(F.lit("part/"), text(F.col(c)))
    sources = B.table(spark, sf, "lineitem").select(text(F.col("l_orderkey")).alias("capsule_hash"), part("l_partkey").alias("path"), F.sha2(part("l_partkey"), 256).alias("hash"))
    sources = sources.join(recorded.select("capsule_hash"), "capsule_hash", "left_semi")
    current = B.table(spark, sf, "part").filter("p_partkey % 89 <> 0").select(part("p_partkey").alias("path"), F.sha2(F.when(F.col("p_partkey") % 97 == 0, "edited").otherwise(part("p_partkey")), 256).alias("hash"))
    found = provenance.replay(recorded, sources, current, supplied, reproduced)
    stale = F.when(~F.col("status").isin("INSPECTED", "TASK_MISMATCH", "TASK_REQUIRED"), F.when(F.size("changed") > 0, F.array_join("changed", ",")))
    return found.select("capsule_hash", "status", stale.alias("changed"))
