"""File graphs: resolving imports, linking tests and documents, merging edges, expanding along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policies as P
from ..functions import text as T

#: Endings that an import without one may have, relation factors, decays.
ENDINGS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
FACTORS = {"FILE_IMPORTS_FILE": 0.72, "FILE_IMPORTED_BY": 0.52, "TEST_RELATION": 0.78, "DOCUMENT_RELATION": 0.38}
DECAY = [1.0, 0.58, 0.34]
SEEDS, NEIGHBOURS, NEW_PATHS, INHERITED = 24, 24, 128, 0.32


def join_path(directory: Column, relative: Column) -> Column:
    """The normalised path; one that climbs above the root keeps a leading `..`."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), relative), "/"), lambda s: ~s.isin("", "."))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    step = lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (last(a) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def asked_paths(imports: DataFrame) -> DataFrame:
    """imports (path, ordinal, specifier) with asked, the paths that a relative specifier may mean, or early, the status without any."""
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = imports.select("path", "ordinal", "specifier", join_path(directory, F.col("specifier")).alias("base"))
    relative = F.col("specifier").startswith(".")
    absolute = F.col("specifier").startswith("/") | F.col("specifier").rlike(r"^[A-Za-z]:[\\/]")
    escapes = (F.col("base") == "") | F.col("base").rlike(r"^\.\.(/|$)")
    early = F.when(~relative & absolute, "unsafe").when(~relative, "external").when(escapes, "unsafe")
    stem = lambda k: F.substring(F.col("base"), F.lit(1), F.length("base") - k)
    ext = F.regexp_extract("base", r"[^/]+(\.[^./]*)$", 1)
    bare = F.array(*[F.concat("base", F.lit(x + e)) for e in ENDINGS for x in ("", "/index")])
    swap = F.when(F.lower(ext) == ".js", F.array("base", F.concat(stem(3), F.lit(".ts")), F.concat(stem(3), F.lit(".tsx"))))
    swap = swap.when(F.lower(ext) == ".jsx", F.array("base", F.concat(stem(4), F.lit(".tsx"))))
    swap = swap.when(F.lower(ext) == ".mjs", F.array("base", F.concat(stem(4), F.lit(".mts")))).when(F.lower(ext) == ".cjs", F.array("base", F.concat(stem(4), F.lit(".cts"))))
    return rows.withColumn("early", early).withColumn("asked", F.when(F.col("early").isNull(), F.when(ext == "", bare).otherwise(F.coalesce(swap, F.array("base")))))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, ordinal, specifier) with status, target_path and candidates.

    Relative specifiers are expanded to the paths that they may mean and joined with files (path); one hit
    resolves, several are ambiguous, none is unresolved."""
    rows = asked_paths(imports)
    hits = rows.filter("asked is not null").select("path", "ordinal", F.explode("asked").alias("candidate"))
    hits = hits.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("path", "ordinal").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
    out = rows.join(hits, ["path", "ordinal"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    status = F.coalesce("early", F.when(n == 1, "resolved_internal").when(n > 1, "ambiguous").otherwise("unresolved"))
    return out.select("path", "ordinal", "specifier", status.alias("status"), F.when(status == "resolved_internal", F.get("candidates", F.lit(0))).alias("target_path"), "candidates")


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Python imports (path, ordinal, specifier: absolute dotted names) to module files whose packages all have an __init__.py."""
    name = F.replace("specifier", F.lit("."), F.lit("/"))
    rows = imports.select("path", "ordinal", "specifier", name.alias("base"))
    asked = rows.select("path", "ordinal", "base", F.explode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("candidate"))
    known = files.select(F.col("path").alias("candidate"))
    hits = asked.join(known, "candidate")
    depth = F.split("base", "/")
    packages = hits.select("path", "ordinal", "candidate", F.explode(F.when(F.size(depth) > 1, F.transform(F.sequence(F.lit(1), F.size(depth) - 1), lambda i: F.concat(F.array_join(F.slice(depth, F.lit(1), i), "/"), F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>"))).alias("package"))
    broken = packages.join(known.withColumnRenamed("candidate", "package"), "package", "left_anti").select("path", "ordinal", "candidate").distinct()
    sound = hits.join(broken, ["path", "ordinal", "candidate"], "left_anti").groupBy("path", "ordinal").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
    tops = files.select(F.regexp_extract("path", r"^([^/.]+)", 1).alias("top")).distinct()
    owned = rows.join(tops, F.split("specifier", r"\.")[0] == F.col("top"), "left_semi").select("path", "ordinal", F.lit(True).alias("owned"))
    out = rows.join(sound, ["path", "ordinal"], "left").join(owned, ["path", "ordinal"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    status = F.when(n == 1, "resolved_internal").when(n > 1, "ambiguous").when(F.coalesce("owned", F.lit(False)), "unresolved").otherwise("external")
    return out.select("path", "ordinal", "specifier", status.alias("status"), F.when(n == 1, F.get("candidates", F.lit(0))).alias("target_path"), "candidates")


def stem_of(path: Column) -> Column:
    base = F.regexp_replace(P.name_of(path), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"\.(?:test|spec)$", ""), "^test_", ""), "_test$", "")


def structural_directory(path: Column) -> Column:
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.array_join(F.filter(parts, lambda s: ~F.lower(s).isin("src", "lib", "app", "test", "tests", "__tests__", ".")), "/")


def mirrored(a: Column, b: Column) -> Column:
    a, b = structural_directory(a), structural_directory(b)
    return (a == b) | ((a != "") & b.endswith(F.concat(F.lit("/"), a))) | ((b != "") & a.endswith(F.concat(F.lit("/"), b)))


def link_tests(files: DataFrame) -> DataFrame:
    """Edges from tests to the source with the same stem, of files (path, category): the only one, or the only mirrored one."""
    stems = files.select("path", "category", stem_of(F.col("path")).alias("stem"))
    tests = stems.filter("category = 'test'").select(F.col("path").alias("source_path"), "stem")
    sources = stems.filter("category = 'source'").select(F.col("path").alias("target_path"), "stem")
    pairs = tests.join(sources, "stem").withColumn("mirror", mirrored(F.col("source_path"), F.col("target_path")))
    w = Window.partitionBy("source_path")
    pairs = pairs.withColumn("n", F.count("*").over(w)).withColumn("mirrors", F.sum(F.col("mirror").cast("int")).over(w))
    confidence = F.when((F.col("n") == 1) & F.col("mirror"), 0.86).when(F.col("n") == 1, 0.72).when(F.col("mirror") & (F.col("mirrors") == 1), 0.84)
    return pairs.select(F.lit("TEST_RELATES_TO_FILE").alias("kind"), "source_path", "target_path", confidence.alias("confidence"), F.lit("heuristic").alias("derivation")).filter("confidence is not null")


def unique_names(symbols: DataFrame) -> DataFrame:
    """(name, path) of symbols (name, path) that live in one file only."""
    return symbols.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1").select("name", "path")


# What documents refer to files by, and names of documents that name no module.
PATH_REFERENCE = r"(?:^|[\s`'\"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?=$|[\s`'\"),:\]])"
CODE_SPAN = "`([^`\\r\\n]{1,160})`"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # where a word of ASCII letters, digits and _ begins or ends, whatever other letters stand beside it
CODE_WORD = EDGE + r"[A-Z][A-Za-z0-9_$]{3,}(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*" + EDGE
NO_MODULES = ["adr", "agents", "architecture", "changelog", "contributing", "design", "docs", "license", "readme"]


def mentions(docs: DataFrame, references: int = 500) -> DataFrame:
    """(path, kind, key, confidence): what documents (path, text) refer to by path, by code span or identifier (name), or by module (token)."""
    named = docs.select("path", F.lit("path").alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(PATH_REFERENCE), 1)).alias("at", "key")).filter(F.col("at") < references).drop("at")
    word = lambda pattern, group, confidence: docs.select("path", F.lit("name").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), group)).alias("key"), F.lit(confidence).alias("confidence"))
    base = F.regexp_replace(P.name_of(F.col("path")), r"(?<=.)\.[^.]*$", "")
    tokens = docs.select("path", F.lit("token").alias("kind"), F.explode(F.split(base, "[^a-z0-9]+")).alias("key")).filter((F.length("key") >= 4) & ~F.col("key").isin(NO_MODULES))
    out = named.withColumn("confidence", F.lit(1.0)).unionByName(word(CODE_SPAN, 1, 0.9)).unionByName(word(CODE_WORD, 0, 0.82)).unionByName(tokens.withColumn("confidence", F.lit(0.6)))
    return out.distinct()


def tokens_of(path: Column) -> Column:
    """The distinct segments of a path that a document's module may be named after."""
    return F.array_distinct(F.split(F.lower(path), r"[/.\\_-]+"))


def link_documents(docs: DataFrame, files: DataFrame, symbols: DataFrame, references: int = 500, modules: int = 20) -> DataFrame:
    """Edges from documents (path, text) to files that they name by path, by code span or identifier, or by module."""
    return merge_edges(link_mentions(mentions(docs, references), files, symbols, modules))


def link_mentions(said: DataFrame, files: DataFrame, symbols: DataFrame, modules: int = 20) -> DataFrame:
    """An edge for each of the mentions that names one thing: an indexed path, a name of one file only, or a token of few paths."""
    at = lambda kind, name: said.filter(F.col("kind") == kind).select(F.col("path").alias("source_path"), F.col("key").alias(name), "confidence")
    named = at("path", "target_path")
    by_path = named.join(files.select(F.col("path").alias("target_path")), "target_path", "left_semi").select("source_path", "target_path", "confidence", F.lit("structural").alias("derivation"))
    names = symbols.select("name", "path")
    if "qualified_name" in symbols.columns:
        names = names.unionByName(symbols.select(F.col("qualified_name").alias("name"), "path"))
    by_name = at("name", "name").join(unique_names(names), "name").select("source_path", F.col("path").alias("target_path"), "confidence", F.lit("heuristic").alias("derivation"))
    parts = files.filter("category = 'source'").select(F.col("path").alias("target_path"), F.explode(tokens_of(F.col("path"))).alias("token"))
    few = parts.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") <= modules).select("token")
    hits = at("token", "token").join(few, "token").join(parts, "token")
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("source_path").orderBy("token", "target_path"))).filter(F.col("n") <= modules)
    by_module = hits.select("source_path", "target_path", "confidence", F.lit("heuristic").alias("derivation"))
    out = by_path.unionByName(by_name).unionByName(by_module).filter("source_path != target_path")
    return out.withColumn("kind", F.lit("DOCUMENT_RELATES_TO_FILE"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (kind, source_path, target_path): the highest confidence, structural if any is, the sorted union of
    what the edges (with a column evidence, a list of strings) rest on; with its id."""
    rests = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")] if "evidence" in edges.columns else []
    merged = edges.groupBy("kind", "source_path", "target_path").agg(F.max("confidence").alias("confidence"), F.bool_or(F.col("derivation") == "structural").alias("s"), *rests)
    end = lambda c: F.concat(F.lit("file:"), F.col(c))
    edge_id = T.hashed_id("edge", 24, F.col("kind"), end("source_path"), end("target_path"))
    return merged.select(edge_id.alias("edge_id"), "kind", "source_path", "target_path", "confidence", F.when(F.col("s"), "structural").otherwise("heuristic").alias("derivation"), *(["evidence"] if rests else []))


def adjacency(edges: DataFrame) -> DataFrame:
    """(path, neighbour, relation, confidence, edge_id): each edge from both of its ends."""
    there = F.when(F.col("kind") == "FILE_IMPORTS_FILE", "FILE_IMPORTS_FILE").when(F.col("kind") == "TEST_RELATES_TO_FILE", "TEST_RELATION").otherwise("DOCUMENT_RELATION")
    back = F.when(F.col("kind") == "FILE_IMPORTS_FILE", "FILE_IMPORTED_BY").otherwise(there)
    a = edges.select(F.col("source_path").alias("path"), F.col("target_path").alias("neighbour"), there.alias("relation"), "confidence", "edge_id")
    b = edges.select(F.col("target_path").alias("path"), F.col("source_path").alias("neighbour"), back.alias("relation"), "confidence", "edge_id")
    return a.unionByName(b)


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("path").agg(F.count("*").alias("degree"))


def expand(seeds: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Structural evidence up to two hops from seeds (task_id, path, score, rank).

    Hops are joins with the adjacency cut to each node's 24 first neighbours (by relation, path, edge). The
    traversal order (seed's rank, depth, parent's place, neighbour's place) is a sort key, so the cap on paths
    that are not in known (task_id, path) is a ranking over their first visits."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv]), F.col("relation"))
    near = adjacency(edges).withColumn("factor", factor)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("factor"), "neighbour", "edge_id"))).filter(F.col("place") <= NEIGHBOURS)
    near = near.select(F.col("path").alias("at"), "neighbour", "relation", "factor", "confidence", "place")
    degree = degrees(edges)
    start = seeds.filter(F.col("rank") <= SEEDS).select("task_id", F.col("path").alias("seed"), "score", "rank")
    one = start.join(near, start["seed"] == near["at"]).filter("neighbour != seed").select("task_id", "seed", "score", "rank", F.lit(1).alias("distance"), F.lit(0).alias("parent"), "place", "neighbour", "relation", "factor", "confidence")
    first = one.groupBy("task_id", "seed", "score", "rank", "neighbour").agg(F.min("place").alias("parent"))
    two = first.withColumnRenamed("neighbour", "via").join(near, F.col("via") == near["at"]).filter("neighbour != seed")
    two = two.select("task_id", "seed", "score", "rank", F.lit(2).alias("distance"), "parent", "place", "neighbour", "relation", "factor", "confidence")
    visits = one.unionByName(two)
    if known is not None:
        order = F.struct("rank", "distance", "parent", "place")
        fresh = visits.join(known.select("task_id", F.col("path").alias("neighbour")), ["task_id", "neighbour"], "left_anti").groupBy("task_id", "neighbour").agg(F.min(order).alias("visit"))
        over = fresh.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("visit"))).filter(F.col("n") > NEW_PATHS)
        visits = visits.join(over.select("task_id", "neighbour"), ["task_id", "neighbour"], "left_anti")
    decay = F.when(F.col("distance") == 1, DECAY[1]).otherwise(DECAY[2])
    rows = visits.join(degree.withColumnRenamed("path", "neighbour"), "neighbour")
    weight = T.round6(F.col("score") * INHERITED * decay * F.col("factor") * F.col("confidence") * T.hub_damping(F.col("degree")))
    none = F.lit(None).cast("string")
    return rows.select("task_id", F.col("neighbour").alias("path"), F.col("relation").alias("kind"), F.lit("STRUCTURAL").alias("family"), none.alias("signal"), F.col("neighbour").alias("target"), weight.alias("weight"), "distance", F.col("seed").alias("source"))


def change_evidence(changes: DataFrame) -> DataFrame:
    """Weak evidence (path, kind, weight) of files (path, status, commits) that changed of late."""
    dirty = changes.filter(~F.col("status").isin("clean", "deleted")).select("path", F.lit("GIT_DIRTY").alias("kind"), F.lit(2.0).alias("weight"))
    recent = changes.filter("commits > 0").select("path", F.lit("GIT_RECENCY").alias("kind"), T.round6(F.least(F.lit(3.0), F.log2(F.lit(1.0) + F.col("commits")))).alias("weight"))
    return dirty.unionByName(recent)


def history(log: DataFrame, commits: int = 100) -> DataFrame:
    """(path, commits, last_commit, last_at) over the last commits of a log (commit, at, path)."""
    last = log.select("commit", "at").distinct().orderBy(F.desc("at"), "commit").limit(commits)
    return log.join(last.select("commit"), "commit", "left_semi").groupBy("path").agg(F.count_distinct("commit").alias("commits"), F.max_by("commit", F.struct("at", "commit")).alias("last_commit"), F.max("at").alias("last_at"))
