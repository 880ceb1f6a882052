"""A repository's graph as one operator: built whole, or from an earlier build and what has changed since.

A unit is a file that edges start from: an importer, a test, a document.  What its edges rest on besides its own
contents is written down as keys: paths that its imports and references may mean, the stem of a test, names that
it mentions, tokens of its own name, and the first part of a module's name.  Keys come from contents alone, so those
of unchanged files are kept; a file that is added, removed or changed (in contents or category) alters keys of the
same kinds.  A unit is derived anew if it has changed itself or holds a key that has been altered; the edges of all
others stay.  The result equals that of a whole build, whatever has changed.

Defined cases: paths are unique in files; imports, symbols and documents of paths that are not in files are
ignored; without files there are no edges; equal edges are merged; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policies as P
from ..sources.shared import materialize
from . import graph

#: What edges rest on, by kind and confidence (an edge of an import also names its specifier).
REASONS = {
    ("FILE_IMPORTS_FILE", 1.0): ["repository-local relative import resolved to one indexed file"],
    ("TEST_RELATES_TO_FILE", 1.0): ["test directly imports source file"],
    ("TEST_RELATES_TO_FILE", 0.86): ["unique normalized basename match", "mirrored test/source directory structure"],
    ("TEST_RELATES_TO_FILE", 0.84): ["normalized basename match", "only candidate with mirrored test/source directory structure"],
    ("TEST_RELATES_TO_FILE", 0.72): ["unique normalized basename match"],
    ("TEST_RELATES_TO_FILE", 0.68): ["imported name matches one unique indexed source symbol"],
    ("DOCUMENT_RELATES_TO_FILE", 1.0): ["document contains exact indexed repository path"],
    ("DOCUMENT_RELATES_TO_FILE", 0.9): ["document code span matches one unique indexed symbol"],
    ("DOCUMENT_RELATES_TO_FILE", 0.82): ["document identifier matches one unique indexed symbol"],
    ("DOCUMENT_RELATES_TO_FILE", 0.6): ["documentation module name matches source path segment"],
}
#: More fixed values, of modules and of endings in imports.
PYTHON_REASON = "repository-root Python import resolved to one module"
SWAPPED = {".ts": "NodeNext .js specifier mapped to .ts source", ".tsx": "NodeNext .js specifier mapped to .tsx source"}
IMPORTED_NAME = 0.68


@dataclass
class Repository:
    """files (path, hash, category), imports (path, ordinal, specifier, names), docs (path, text), symbols (path, name, qualified_name)."""

    files: DataFrame
    imports: DataFrame
    docs: DataFrame
    symbols: DataFrame


@dataclass
class Graph:
    """resolved (path, ordinal, specifier, status, target_path, candidates), edges (with evidence), and keys (path, kind, key, confidence)."""

    resolved: DataFrame
    edges: DataFrame
    keys: DataFrame


def _is_python(path: str = "path") -> Column:
    return F.coalesce(P.parser_language(F.col(path)) == "python", F.lit(False))


def _top(path: str) -> Column:
    return F.regexp_extract(path, r"^([^/.]+)", 1)


def keys(repo: Repository) -> DataFrame:
    """(path, kind, key, confidence) of each unit of the repository; confidence is that of a mention, else null."""
    row = lambda df, kind, key: df.select("path", F.lit(kind).alias("kind"), key.alias("key"))
    script, module = repo.imports.filter(~_is_python()), repo.imports.filter(_is_python())
    out = row(graph.asked_paths(script).filter("asked is not null"), "path", F.explode("asked"))
    base = F.replace("specifier", F.lit("."), F.lit("/"))
    parts = F.split(base, "/")
    packages = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/__init__.py")))
    out = out.unionByName(row(module, "path", F.explode(F.concat(packages, F.array(F.concat(base, F.lit(".py")))))))
    out = out.unionByName(row(module, "top", F.split("specifier", r"\.")[0]))
    tests = repo.files.filter("category = 'test'")
    out = out.unionByName(row(tests, "stem", graph.stem_of(F.col("path"))))
    out = out.unionByName(row(repo.imports.join(tests.select("path"), "path", "left_semi"), "name", F.explode("names"))).distinct()
    return out.withColumn("confidence", F.lit(None).cast("double")).unionByName(graph.mentions(repo.docs))


def _altered(delta: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, key) that a delta (path, old_category, category; null where absent) may have altered, with the symbols before and after."""
    moved = delta.filter(~F.col("category").eqNullSafe(F.col("old_category")))  # added and removed files too
    sources = moved.filter((F.col("category") == "source") | (F.col("old_category") == "source"))
    names = before.unionByName(after).join(delta.select("path"), "path", "left_semi")
    key = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), c.alias("key"))
    out = key(moved, "path", F.col("path")).unionByName(key(moved, "top", _top("path"))).unionByName(key(sources, "stem", graph.stem_of(F.col("path"))))
    out = out.unionByName(key(sources, "token", F.explode(graph.tokens_of(F.col("path")))))
    return out.unionByName(key(names, "name", F.explode(F.array("name", "qualified_name")))).filter("key is not null").distinct()


def _derive(files: DataFrame, imports: DataFrame, said: DataFrame, symbols: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved imports and edges from these imports, keys and tests, against all files and symbols."""
    paths = files.select("path")
    script = graph.resolve_imports(imports.filter(~_is_python()), paths)
    resolved = materialize(script.unionByName(graph.resolve_modules(imports.filter(_is_python()), paths)))
    hit = resolved.filter("status = 'resolved_internal'").select(F.col("path").alias("source_path"), "target_path", "specifier")
    edge = lambda df, kind, confidence, derivation: df.select(F.lit(kind).alias("kind"), "source_path", "target_path", F.lit(confidence).alias("confidence"), F.lit(derivation).alias("derivation"))
    end = F.when(F.lower("specifier").endswith(".js"), F.regexp_extract("target_path", r"(\.tsx?)$", 1))
    swapped = F.when(end == ".ts", F.array(F.lit(SWAPPED[".ts"]))).when(end == ".tsx", F.array(F.lit(SWAPPED[".tsx"]))).otherwise(F.array().cast("array<string>"))
    quoted = F.regexp_extract(F.to_json(F.array("specifier")), r"(?s)^\[(.*)\]$", 1)
    base = F.when(_is_python("source_path"), F.array(F.lit(PYTHON_REASON))).otherwise(F.concat(F.array(F.lit(REASONS["FILE_IMPORTS_FILE", 1.0][0])), swapped))
    imported = hit.select(F.lit("FILE_IMPORTS_FILE").alias("kind"), "source_path", "target_path", F.lit(1.0).alias("confidence"), F.lit("structural").alias("derivation"), F.concat(F.array(F.concat(F.lit("resolved import "), quoted)), base).alias("evidence"))

    all_tests, sources = files.filter("category = 'test'").select("path"), files.filter("category = 'source'")
    named = lambda df, name: df.select(F.col("path").alias(name))
    direct = hit.join(named(all_tests, "source_path"), "source_path", "left_semi").join(named(sources, "target_path"), "target_path", "left_semi")
    kinds = tests.select("path", F.lit("test").alias("category")).unionByName(sources.select("path", "category"))
    own = symbols.join(sources.select("path"), "path", "left_semi")
    open_ = resolved.filter("status in ('unresolved', 'ambiguous')").select("path", "ordinal").join(all_tests, "path", "left_semi")
    wanted = imports.select("path", "ordinal", F.explode("names").alias("name")).join(open_, ["path", "ordinal"], "left_semi").select(F.col("path").alias("source_path"), "name").distinct()
    by_name = wanted.join(graph.unique_names(own.select("name", "path").join(wanted.select("name").distinct(), "name", "left_semi")), "name").withColumnRenamed("path", "target_path")
    found = edge(direct, "TEST_RELATES_TO_FILE", 1.0, "structural").unionByName(graph.link_tests(kinds)).unionByName(edge(by_name, "TEST_RELATES_TO_FILE", IMPORTED_NAME, "heuristic"))
    mentioned = said.filter("confidence is not null")
    asked = mentioned.filter("kind = 'name'").select(F.col("key").alias("name")).distinct()
    names = own.select("path", F.explode(F.array("name", "qualified_name")).alias("name")).join(asked, "name", "left_semi")
    found = found.unionByName(graph.link_mentions(mentioned, files, names))
    reasons = F.create_map(*[x for (kind, c), why in REASONS.items() for x in (F.lit(f"{kind} {c}"), F.array(*[F.lit(w) for w in why]))])
    why = F.try_element_at(reasons, F.concat_ws(" ", "kind", F.col("confidence").cast("string")))
    return resolved, graph.merge_edges(imported.unionByName(found.withColumn("evidence", why)))


def _known(repo: Repository) -> Repository:
    """Without what belongs to no file."""
    keep = lambda df: df.join(repo.files.select("path"), "path", "left_semi")
    return Repository(repo.files, keep(repo.imports), keep(repo.docs), keep(repo.symbols))


def build(repo: Repository) -> Graph:
    """The whole graph of a repository."""
    repo = _known(repo)
    said = materialize(keys(repo))
    resolved, edges = _derive(repo.files, repo.imports, said, repo.symbols, repo.files.filter("category = 'test'").select("path"))
    return Graph(resolved, materialize(edges), said)


def affected(old: Graph, before: Repository, repo: Repository) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path) of the units to derive anew, (path) of the files that stay as they are, and the keys of the repository."""
    a = before.files.select("path", F.col("hash").alias("old_hash"), F.col("category").alias("old_category"))
    both = materialize(a.join(repo.files.select("path", "hash", "category"), "path", "full_outer"))
    same = F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("category").eqNullSafe(F.col("old_category"))
    delta, same = both.filter(~same), both.filter(same).select("path")
    changed = delta.filter("category is not null").select("path")
    fresh = keys(Repository(*[df.join(changed, "path", "left_semi") for df in (repo.files, repo.imports, repo.docs, repo.symbols)]))
    said = materialize(old.keys.join(same, "path", "left_semi").unionByName(fresh))
    touched = said.join(_altered(delta, before.symbols, repo.symbols), ["kind", "key"], "left_semi").select("path")
    return materialize(touched.unionByName(changed).distinct()), same, said


def update(old: Graph, before: Repository, repo: Repository) -> Graph:
    """The graph of a repository from that of the repository before; equal to build(repo)."""
    before, repo = _known(before), _known(repo)
    units, same, said = affected(old, before, repo)
    of = lambda df: df.join(units, "path", "left_semi")
    resolved, edges = _derive(repo.files, of(repo.imports), of(said), repo.symbols, of(repo.files.filter("category = 'test'").select("path")))
    stay = same.join(units, "path", "left_anti")
    kept = old.edges.join(stay.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    return Graph(old.resolved.join(stay, "path", "left_semi").unionByName(resolved), materialize(kept.unionByName(edges)), said)


def inspect(built: Graph, asked: DataFrame) -> DataFrame:
    """(path, section, target, confidence, derivation, edge_id) of the files asked for (path): their imports, what imports them,
    and the tests and documentation at either end."""
    ends = built.edges.select("kind", "source_path", "target_path", "confidence", "derivation", "edge_id")
    section = lambda a, b, imports: ends.select(F.col(a).alias("path"), F.when(F.col("kind") == "FILE_IMPORTS_FILE", imports).when(F.col("kind") == "TEST_RELATES_TO_FILE", "tests").otherwise("documentation").alias("section"), F.col(b).alias("target"), "confidence", "derivation", "edge_id")
    out = section("source_path", "target_path", "imports").unionByName(section("target_path", "source_path", "imported_by"))
    # an edge from a file to itself is listed once, except as import and importer
    return out.distinct().join(asked.select("path").distinct(), "path", "left_semi")


def summary(repo: Repository, built: Graph) -> DataFrame:
    """(part, kind, n): what an index of the repository holds: files by category, symbols, imports by status, edges by kind."""
    count = lambda df, part, kind: df.groupBy(F.lit(part).alias("part"), kind.alias("kind")).agg(F.count("*").alias("n"))
    out = count(repo.files, "files", F.col("category")).unionByName(count(repo.symbols, "symbols", F.lit("all")))
    return out.unionByName(count(built.resolved, "imports", F.col("status"))).unionByName(count(built.edges, "edges", F.col("kind")))
