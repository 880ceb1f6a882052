"""Relations between symbols, and evidence along them.

Relations: relation_id, type, source_path, source_symbol, target_path, target_symbol, confidence, classification.
Symbols: path, symbol_id, name, kind, parent_id, start_line, end_line.  Bindings: path, local_name,
imported_name, kind (NAMED or NAMESPACE), target_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import owners

# Factors and caps of the expansion.
FACTORS = {
    "SYMBOL_REFERENCE": 0.74, "CALLER": 0.86, "INTERFACE": 0.68, "IMPLEMENTATION": 0.82, "TEST_REFERENCE": 0.84, "TEST_IMPORT": 0.72, "TEST_ASSOCIATION": 0.42, "BOUNDED_DEPENDENT": 0.62,
}
CONFIDENCE = {"EXACT": 1.0, "HIGH": 0.86, "MEDIUM": 0.68, "LOW": 0.45}
PER_SEED, PER_KIND, TOTAL, SEEDS, INHERITED, FAMILY_CAP = 16, 8, 256, 24, 0.06, 18.0


def _pick(column: str | Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column) if isinstance(column, str) else column)


def _unique(symbols: DataFrame, *keys: str) -> DataFrame:
    """(keys, target_symbol) of keys that name one symbol."""
    return symbols.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("symbol_id").alias("target_symbol")).filter("_n = 1").drop("_n")


def with_ids(relations: DataFrame) -> DataFrame:
    ids = T.hashed_id("relation", 24, *[F.col(c) for c in ("type", "source_path", "source_symbol", "target_path", "target_symbol", "classification")])
    columns = ["type", "source_path", "source_symbol", "target_path", "target_symbol", "classification"]
    place = ["line"] if "line" in relations.columns else []
    kept = relations.withColumn("relation_id", ids).groupBy("relation_id", *columns)
    # of equal relations the earliest place stays, without places the surest
    least = F.min(F.struct(*place, F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col("confidence")).alias("_sure"), "confidence")).alias("x")
    return kept.agg(least).select("relation_id", *columns[:-1], "x.confidence", "classification", *[f"x.{c}" for c in place])


def calls(call: DataFrame, symbols: DataFrame, bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Relations of direct calls (path, line, form, callee, receiver) whose caller and target are certain.

    The caller is the narrowest symbol around the line. A method of the caller's own class, a function or class
    of the file, a named import or a member of an imported namespace is a target if exactly one fits."""
    own = owners(call.select("path", "line").distinct(), symbols)
    rows = call.join(own, ["path", "line"]).join(symbols.select("symbol_id", F.col("parent_id").alias("class_id")), "symbol_id").withColumnRenamed("symbol_id", "source_symbol")
    methods = _unique(symbols.filter("kind = 'method'").withColumnRenamed("parent_id", "class_id").withColumnRenamed("name", "callee"), "path", "class_id", "callee")
    tops = symbols.filter("parent_id is null")
    local = _unique(tops.filter("kind in ('function', 'class')").withColumnRenamed("name", "callee"), "path", "callee")
    once = bindings.groupBy("path", "local_name", "kind").agg(F.count("*").alias("_n"), F.min("imported_name").alias("imported_name"), F.min("target_path").alias("target_path")).filter("_n = 1").drop("_n")
    exported = _unique(tops.select(F.col("path").alias("target_path"), F.col("name").alias("imported_name"), "symbol_id"), "target_path", "imported_name")
    a = rows.filter("form = 'SELF_MEMBER' and class_id is not null").join(methods, ["path", "class_id", "callee"]).withColumn("target_path", F.col("path"))
    plain = rows.filter("form = 'IDENTIFIER'")
    b = plain.join(local, ["path", "callee"]).withColumn("target_path", F.col("path"))
    rest = plain.join(local.select("path", "callee"), ["path", "callee"], "left_anti")
    c = rest.join(once.filter("kind = 'NAMED'").withColumnRenamed("local_name", "callee").drop("kind"), ["path", "callee"]).join(exported, ["target_path", "imported_name"])
    spaces = once.filter("kind = 'NAMESPACE'").select("path", F.col("local_name").alias("receiver"), "target_path")
    d = rows.filter("form = 'NAMESPACE_MEMBER'").join(spaces, ["path", "receiver"]).join(exported.withColumnRenamed("imported_name", "callee"), ["target_path", "callee"])
    keep = [F.col("path").alias("source_path"), "source_symbol", "target_path", "target_symbol"]
    found = a.select(*keep).unionByName(b.select(*keep)).unionByName(c.select(*keep)).unionByName(d.select(*keep)).filter("source_symbol != target_symbol")
    category = lambda c: files.select(F.col("path").alias(f"{c}_path"), F.col("category").alias(f"{c}_category"))
    found = found.join(category("source"), "source_path").join(category("target"), "target_path")
    tested = (F.col("source_category") == "test") & (F.col("target_category") != "test")
    named = found.withColumn("type", F.when(tested, "TEST_REFERENCES_SYMBOL").otherwise("SYMBOL_REFERENCES_SYMBOL"))
    return with_ids(named.withColumn("confidence", F.lit("EXACT")).withColumn("classification", F.lit("STRUCTURAL_FACT")))


def implementations(clauses: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Relations of implements clauses (path, class_name, interface_name): a local interface first, then an imported one."""
    classes = _unique(symbols.filter("kind = 'class'").withColumnRenamed("name", "class_name"), "path", "class_name").withColumnRenamed("target_symbol", "source_symbol")
    faces = symbols.filter("kind = 'interface'")
    local = _unique(faces.withColumnRenamed("name", "interface_name"), "path", "interface_name").withColumnRenamed("target_symbol", "local_symbol")
    there = _unique(faces.select(F.col("path").alias("target_path"), F.col("name").alias("imported_name"), "symbol_id"), "target_path", "imported_name")
    once = bindings.filter("kind = 'NAMED'").groupBy("path", "local_name").agg(F.count("*").alias("_n"), F.min("imported_name").alias("imported_name"), F.min("target_path").alias("target_path")).filter("_n = 1")
    imported = once.join(there, ["target_path", "imported_name"]).select("path", F.col("local_name").alias("interface_name"), "target_path", "target_symbol")
    rows = clauses.join(classes, ["path", "class_name"]).join(local, ["path", "interface_name"], "left").join(imported, ["path", "interface_name"], "left")
    rows = rows.select(F.lit("SYMBOL_IMPLEMENTS_SYMBOL").alias("type"), F.col("path").alias("source_path"), "source_symbol", F.when(F.col("local_symbol").isNotNull(), F.col("path")).otherwise(F.col("target_path")).alias("target_path"), F.coalesce("local_symbol", "target_symbol").alias("target_symbol"), F.lit("EXACT").alias("confidence"), F.lit("STRUCTURAL_FACT").alias("classification"))
    return with_ids(rows.filter("target_symbol is not null"))


def from_edges(edges: DataFrame) -> DataFrame:
    """File edges (imports and tests) as relations."""
    fact = F.col("derivation") == "structural"
    level = F.when(F.col("confidence") == 1, "EXACT").when(F.col("confidence") >= 0.8, "HIGH").when(F.col("confidence") >= 0.6, "MEDIUM").otherwise("LOW")
    kind = F.when(F.col("kind") == "FILE_IMPORTS_FILE", "FILE_DEPENDS_ON_FILE").when(fact, "TEST_IMPORTS_FILE").otherwise("TEST_ASSOCIATED_WITH_FILE")
    none = F.lit(None).cast("string")
    rows = edges.filter("kind != 'DOCUMENT_RELATES_TO_FILE'").select(kind.alias("type"), "source_path", none.alias("source_symbol"), "target_path", none.alias("target_symbol"), level.alias("confidence"), F.when(fact, "STRUCTURAL_FACT").otherwise("HEURISTIC").alias("classification"))
    return with_ids(rows)


def expand(seeds: DataFrame, relations: DataFrame, direct: DataFrame, relevant: DataFrame | None = None, plan_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Evidence (task_id, path, symbol, kind, weight, relation_id, source) along relations of seeds (task_id, path, score, rank, tier).

    An end with a symbol matches a seed only if that symbol is relevant to it (task_id, path, symbol_id). Caps:
    per seed and kind, then per seed, then per task. Files in direct (task_id, path) get weight 0."""
    first = seeds.filter((F.col("rank") <= SEEDS) & (F.col("tier") <= 2)).select("task_id", F.col("path").alias("seed"), "score", F.col("rank").alias("seed_rank"))
    ends = relations.select(F.col("source_path").alias("p"), F.coalesce("source_symbol", F.lit("")).alias("s")).unionByName(relations.select(F.col("target_path").alias("p"), F.coalesce("target_symbol", F.lit("")).alias("s")))
    degree = ends.groupBy("p", "s").agg(F.count("*").alias("degree"))

    def side(near: str, far: str, forward: bool) -> DataFrame:
        rows = first.join(relations, first["seed"] == relations[f"{near}_path"])
        if relevant is not None:
            known = relevant.select("task_id", F.col("path").alias("seed"), F.col("symbol_id").alias(f"{near}_symbol"), F.lit(True).alias("known"))
            rows = rows.join(known, ["task_id", "seed", f"{near}_symbol"], "left").filter(F.col(f"{near}_symbol").isNull() | F.col("known")).drop("known")
        else:
            rows = rows.filter(F.col(f"{near}_symbol").isNull())
        t = F.col("type")
        kind = (
            F.when(t == "SYMBOL_REFERENCES_SYMBOL", "SYMBOL_REFERENCE" if forward else "CALLER").when(t == "TEST_REFERENCES_SYMBOL", "SYMBOL_REFERENCE" if forward else "TEST_REFERENCE")
            .when(t == "SYMBOL_IMPLEMENTS_SYMBOL", "INTERFACE" if forward else "IMPLEMENTATION").when(t == "TEST_IMPORTS_FILE", "TEST_IMPORT")
            .when(t == "TEST_ASSOCIATED_WITH_FILE", "TEST_ASSOCIATION").otherwise("BOUNDED_DEPENDENT")
        )
        return rows.select("task_id", "seed", "score", "seed_rank", "relation_id", "type", "confidence", "source_path", "target_path", F.lit(0 if forward else 1).alias("way"), kind.alias("kind"), F.col(f"{far}_path").alias("path"), F.col(f"{far}_symbol").alias("symbol"), F.coalesce(F.col(f"{near}_symbol"), F.lit("")).alias("near_symbol"))

    both = side("source", "target", True).unionByName(side("target", "source", False))
    # a relation that matches both ways counts forward
    both = both.withColumn("_w", F.row_number().over(Window.partitionBy("task_id", "seed", "relation_id").orderBy("way"))).filter("_w = 1").drop("_w")
    order = ["type", "source_path", "target_path", "relation_id"]
    cap = F.when(F.col("kind").isin("SYMBOL_REFERENCE", "BOUNDED_DEPENDENT"), PER_SEED).otherwise(PER_KIND)
    group = F.when(F.col("kind").startswith("TEST_"), F.col("kind")).otherwise(F.col("kind"))
    both = both.withColumn("_k", F.row_number().over(Window.partitionBy("task_id", "seed", group).orderBy(*order))).filter(F.col("_k") <= cap)
    both = both.withColumn("_s", F.row_number().over(Window.partitionBy("task_id", "seed").orderBy(*order))).filter(F.col("_s") <= PER_SEED)
    both = both.withColumn("_t", F.row_number().over(Window.partitionBy("task_id").orderBy("seed_rank", *order))).filter(F.col("_t") <= TOTAL)
    far = degree.select(F.col("p").alias("path"), F.col("s").alias("fs"), F.col("degree").alias("fd"))
    near = degree.select(F.col("p").alias("seed"), F.col("s").alias("near_symbol"), F.col("degree").alias("nd"))
    both = both.withColumn("fs", F.coalesce("symbol", F.lit(""))).join(far, ["path", "fs"], "left").join(near, ["seed", "near_symbol"], "left")
    hub = T.hub_damping(F.greatest(F.coalesce("fd", F.lit(1)), F.coalesce("nd", F.lit(1))))
    planned = F.when(F.col("kind").isin(*plan_kinds), 1.08).otherwise(1.0) if plan_kinds else F.lit(1.0)
    weight = F.least(F.lit(FAMILY_CAP), F.col("score") * INHERITED * _pick("kind", FACTORS) * _pick("confidence", CONFIDENCE) * hub * planned)
    found = direct.select("task_id", "path", F.lit(True).alias("_d"))
    both = both.join(found, ["task_id", "path"], "left")
    return both.select("task_id", "path", "symbol", "kind", F.when(F.col("_d"), 0.0).otherwise(T.round6(weight)).alias("weight"), "relation_id", F.col("seed").alias("source"))
