"""From a task's words to a plan: kinds and specificity of its signals, its mode, the roles that its context has, and
the roles that a candidate plays by its evidence. Rule tables joined with the tasks; no path or candidate enters a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import review
from . import signals as S

# Kinds of the second analysis, and which of them are technical.
KINDS = {
    "PATH": "PATH", "FILE_NAME": "FILE_NAME", "QUALIFIED_IDENTIFIER": "QUALIFIED_SYMBOL", "IDENTIFIER": "SYMBOL", "ERROR_LITERAL": "ERROR_IDENTIFIER",
    "CODE_LITERAL": "TECHNICAL_LITERAL", "DOTTED_IDENTIFIER": "TECHNICAL_LITERAL", "NUMBER_LITERAL": "TECHNICAL_LITERAL", "CJK_TERM": "CJK_TERM", "NATURAL_TERM": "NATURAL_TERM",
}
CONFIG_KINDS = ["ERROR_LITERAL", "CODE_LITERAL", "DOTTED_IDENTIFIER", "NUMBER_LITERAL"]
CONFIG_KEY = r"^(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z][a-z0-9]*(?:[.-][a-z0-9_-]+)+)$"
PLAIN_KINDS = ["NATURAL_TERM", "CJK_TERM"]
TEST_FAILURE = r"\b(?:test|spec)\b.{0,32}\b(?:fail|failure|broken|error)\w*\b|\b(?:fail|failure|broken)\w*\b.{0,32}\b(?:test|spec)\b|测试.{0,12}(?:失败|错误)"
# The sections of a mode's context, in order: role, priority, least and most items, evidence that it accepts.
_DIRECT = "IDENTITY VERIFIED_LEXICAL SYMBOL_OWNERSHIP"
_NEAR = "FILE_STRUCTURAL TEST_DOCUMENTATION RELATIONSHIP"
_TESTS = "TEST_DOCUMENTATION FILE_STRUCTURAL RELATIONSHIP"
_INSTRUCTION = ("REPOSITORY_INSTRUCTION", "PREFERRED", 0, 1, _DIRECT)
_GENERAL = [
    ("PRIMARY_IMPLEMENTATION", "REQUIRED", 1, 6, _DIRECT), ("STATE_OWNER", "PREFERRED", 0, 4, f"{_DIRECT} FILE_STRUCTURAL RELATIONSHIP"),
    ("CALLER_OR_DEPENDENT", "PREFERRED", 0, 4, _NEAR), ("TEST", "PREFERRED", 0, 4, _TESTS), ("DOCUMENTATION", "OPTIONAL", 0, 2, "VERIFIED_LEXICAL TEST_DOCUMENTATION"), _INSTRUCTION,
]
SECTIONS = {
    "CONCURRENCY": [
        ("PRIMARY_IMPLEMENTATION", "REQUIRED", 1, 6, _DIRECT), ("STATE_OWNER", "REQUIRED", 1, 4, f"{_DIRECT} FILE_STRUCTURAL RELATIONSHIP"),
        ("CALLER_OR_DEPENDENT", "PREFERRED", 0, 4, _NEAR), ("TEST", "PREFERRED", 0, 4, _TESTS), _INSTRUCTION,
    ],
    "TEST_FAILURE": [
        ("TEST", "REQUIRED", 1, 4, f"{_DIRECT} TEST_DOCUMENTATION RELATIONSHIP"), ("PRIMARY_IMPLEMENTATION", "REQUIRED", 1, 6, f"{_DIRECT} FILE_STRUCTURAL RELATIONSHIP"),
        ("STATE_OWNER", "PREFERRED", 0, 4, "FILE_STRUCTURAL SYMBOL_OWNERSHIP RELATIONSHIP"), _INSTRUCTION,
    ],
    "CONFIGURATION": [
        ("CONFIGURATION", "REQUIRED", 1, 4, f"{_DIRECT} FILE_STRUCTURAL"), ("PRIMARY_IMPLEMENTATION", "REQUIRED", 1, 6, f"{_DIRECT} FILE_STRUCTURAL"),
        ("TEST", "PREFERRED", 0, 4, _TESTS), ("DOCUMENTATION", "OPTIONAL", 0, 2, "VERIFIED_LEXICAL TEST_DOCUMENTATION"), _INSTRUCTION,
    ],
    "ARCHITECTURE": [
        ("DOCUMENTATION", "REQUIRED", 1, 4, f"{_DIRECT} TEST_DOCUMENTATION"), ("PRIMARY_IMPLEMENTATION", "PREFERRED", 0, 6, f"{_DIRECT} FILE_STRUCTURAL"),
        ("TEST", "OPTIONAL", 0, 2, _TESTS), _INSTRUCTION,
    ],
    "EXACT_TARGET": [("PRIMARY_IMPLEMENTATION", "REQUIRED", 1, 6, _DIRECT), ("CALLER_OR_DEPENDENT", "PREFERRED", 0, 4, _NEAR), ("TEST", "PREFERRED", 0, 4, _TESTS), _INSTRUCTION],
    "BEHAVIORAL": _GENERAL,
    "GENERAL": _GENERAL,
}
# What evidence speaks for which role of a pack.
IMPACT = ["CALLER", "SYMBOL_REFERENCE", "INTERFACE", "IMPLEMENTATION", "BOUNDED_DEPENDENT", "FILE_IMPORTED_BY", "FILE_IMPORTS_FILE"]
VALIDATION = ["TEST_REFERENCE", "TEST_IMPORT", "TEST_ASSOCIATION", "TEST_RELATION"]
ROLES = ["PRIMARY", "IMPACT", "VALIDATION", "SUPPORT"]
#: Signals that a plan keeps in focus.
MOST_FOCUS = 32


def analyzed(tasks: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """The signals of tasks (task_id, text) with v2_kind and specificity: EXACT if the task quotes it, TECHNICAL or GENERAL by kind."""
    rows = S.signals(tasks) if signals is None else signals
    quoted = F.transform(F.regexp_extract_all("text", F.lit(S.QUOTED), 2), T.normalize_term)
    about = tasks.select("task_id", quoted.alias("_quoted"), T.speaks_of(F.col("text"), dict(review.CONCEPTS)["CONFIGURATION"]).alias("_config"))
    rows = rows.join(about, "task_id")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    kind = F.when(F.col("_config") & F.col("kind").isin(CONFIG_KINDS) & F.col("value").rlike(CONFIG_KEY), "CONFIG_KEY").otherwise(kind)
    rows = rows.withColumn("v2_kind", kind)
    specificity = F.when(F.array_contains("_quoted", F.col("normalized")), "EXACT").when(~F.col("v2_kind").isin(PLAIN_KINDS), "TECHNICAL").otherwise("GENERAL")
    return rows.withColumn("specificity", specificity).drop("_quoted", "_config")


def modes(tasks: DataFrame, signals: DataFrame) -> DataFrame:
    """(task_id, action, concepts, mode) of tasks (task_id, text) with their analyzed signals."""
    exact = (F.col("specificity") == "EXACT") | F.col("v2_kind").isin("PATH", "QUALIFIED_SYMBOL")
    behaves = ~F.col("low_value") & (F.col("specificity") != "GENERAL")
    asked = signals.groupBy("task_id").agg(F.bool_or(exact).alias("exact"), F.bool_or(behaves).alias("behaves"))
    rows = tasks.select("task_id", "text", review.action_of(F.col("text")).alias("action"), review.concepts_of(F.col("text")).alias("concepts")).join(asked, "task_id", "left")
    has = lambda *names: F.arrays_overlap("concepts", F.array(*[F.lit(n) for n in names]))
    mode = (
        F.when(T.speaks_of(F.col("text"), TEST_FAILURE), "TEST_FAILURE").when(has("CONCURRENCY", "TRANSACTION_OR_LOCK"), "CONCURRENCY").when(has("CONFIGURATION"), "CONFIGURATION")
        .when(has("DOCUMENTATION"), "ARCHITECTURE").when(F.col("exact"), "EXACT_TARGET").when(F.col("behaves"), "BEHAVIORAL").otherwise("GENERAL")
    )
    return rows.select("task_id", "action", "concepts", mode.alias("mode"))


def sections(modes: DataFrame) -> DataFrame:
    """(task_id, place, role, priority, least, most, sources): the sections that a task's mode plans, in order."""
    table = [(m, i, r, p, lo, hi, src.split()) for m, rows in SECTIONS.items() for i, (r, p, lo, hi, src) in enumerate(rows)]
    table = modes.sparkSession.createDataFrame(table, "mode string, place int, role string, priority string, least int, most int, sources array<string>")
    return modes.select("task_id", "mode").join(F.broadcast(table), "mode").drop("mode")


def focus(signals: DataFrame) -> DataFrame:
    """(task_id, focus): the first MOST_FOCUS analyzed signals, by kind and form, that are neither of low value nor plain words with
    several matches (ambiguity COLLIDING)."""
    kept = signals.filter(~F.col("low_value") & ((F.col("specificity") != "GENERAL") | (F.coalesce("ambiguity", F.lit("UNKNOWN")) != "COLLIDING")))
    one = F.struct("kind", "normalized", "origin", T.hashed_id("task_signal", 20, F.col("v2_kind"), F.col("normalized"), F.col("origin"), F.col("derived_from")).alias("id"))
    first = F.slice(F.array_sort(F.collect_list(one)), 1, MOST_FOCUS)
    return kept.groupBy("task_id").agg(F.transform(first, lambda x: x["id"]).alias("focus"))


def pack_plans(modes: DataFrame, neutral: bool = False) -> DataFrame:
    """(task_id, weights, facet): the weight of each role of a pack (0 required, 1 high, 2 normal), and the kind of file that the
    task is after (null: none). A neutral plan has only its primary role."""
    action, mode = F.col("action"), F.col("mode")
    weights = lambda *ws: F.map_from_arrays(F.array(*[F.lit(r) for r in ROLES]), F.array(*[F.lit(w) for w in ws]))
    if neutral:
        return modes.select("task_id", weights(0, 2, 2, 2).alias("weights"), F.lit(None).cast("string").alias("facet"))
    reads = action.isin("UNDERSTAND", "REVIEW") | (mode == "ARCHITECTURE")
    plan = F.when((action == "REFACTOR") | (mode == "CONCURRENCY"), weights(0, 0, 1, 2)).when((action == "TEST") | (mode == "TEST_FAILURE"), weights(0, 1, 0, 2)).when(reads, weights(0, 1, 2, 1)).otherwise(weights(0, 1, 1, 2))
    facet = (
        F.when((mode == "TEST_FAILURE") | (action == "TEST"), "VALIDATION").when(mode == "CONFIGURATION", "CONFIGURATION").when(reads, "DOCUMENTATION")
        .when((mode == "GENERAL") & (action == "CHANGE"), None).when(action.isin("FIX", "CHANGE", "REFACTOR"), "IMPLEMENTATION")
    )
    return modes.select("task_id", plan.alias("weights"), facet.alias("facet"))


def classify(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """candidates (task_id, path, category and more; language: null if unknown) with roles, strong, facet and directness.

    evidence: (task_id, path, kind, family, source, ambiguity). Direct evidence is a name, a verified word or its owner, not
    inherited from another candidate and not of a name with several owners."""
    direct = F.col("source").isNull() & (F.coalesce("ambiguity", F.lit("UNKNOWN")) != "COLLIDING") & ((F.col("family") == "IDENTITY") | F.col("kind").isin("LEXICAL_SYMBOL_OWNERSHIP", "VERIFIED_LEXICAL"))
    any_ = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    found = evidence.groupBy("task_id", "path").agg(
        any_(direct, "strong"), any_(direct & (F.col("family") == "IDENTITY"), "_named"), any_(direct & (F.col("kind") == "LEXICAL_SYMBOL_OWNERSHIP"), "_owned"),
        any_(F.col("kind").isin(IMPACT), "_impact"), any_(F.col("kind").isin(VALIDATION), "_validation"),
    )
    rows = candidates.join(found, ["task_id", "path"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    validation = flag("_validation") | (F.col("category") == "test")
    support = F.col("category").isin("documentation", "configuration") | ~(flag("strong") | flag("_impact") | validation)
    roles = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in zip(ROLES, (flag("strong"), flag("_impact"), validation, support), strict=True)]))
    facet = (
        F.when(F.col("category") == "test", "VALIDATION").when(F.col("category") == "documentation", "DOCUMENTATION").when(F.col("category") == "configuration", "CONFIGURATION")
        .when((F.col("category") == "source") & F.col("language").isNotNull(), "IMPLEMENTATION").otherwise("OTHER")
    )
    directness = F.when(flag("_named"), "IDENTITY").when(flag("_owned"), "OWNED_SYMBOL").when(flag("strong"), "VERIFIED_LEXICAL").otherwise("INDIRECT")
    out = rows.withColumns({"roles": roles, "facet": facet, "directness": directness, "strong": flag("strong")})
    return out.drop("_named", "_owned", "_impact", "_validation")


def role_order(weights: Column) -> Column:
    """The roles of a plan by weight, then as they are listed; those of weight 2 wait for the end and are left out."""
    some = F.filter(F.array(*[F.struct(F.try_element_at(weights, F.lit(r)).alias("w"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(ROLES)]), lambda x: x["w"] < 2)
    return F.transform(F.array_sort(some), lambda x: x["r"])
