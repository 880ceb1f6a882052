"""Provenance: stable ids, integrity checks, explanations, differences, coverage and human controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ["PIN", "EXCLUDE", "PREFER", "FOCUS", "RANGE"]
MAX_CONTROLS = 32


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): how many rows each rule finds; a sound state has none."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, rows)


def dangling(rows: DataFrame, refs: Column, target: DataFrame, key: str) -> DataFrame:
    """(id, ref) of references (an array per row of rows (id, ...)) that target doesn't hold."""
    return rows.select("id", F.explode(refs).alias("ref")).join(target.select(F.col(key).alias("ref")), "ref", "left_anti")


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, changed): rows added, removed, or with columns that differ."""
    a = before.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = after.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.size(differs) > 0, "CHANGED")
    return both.select(key, change.alias("change"), F.when(change == "CHANGED", differs).otherwise(F.array().cast("array<string>")).alias("changed")).filter("change is not null")


def explain(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question, status, disposition): why a path was (not) taken: OK, NOT_CONSIDERED, AMBIGUOUS or INSUFFICIENT_EVIDENCE.

    questions (question, asked: a path or file name); candidates (path, disposition, n_evidence)."""
    base = F.element_at(F.split("path", "/"), -1)
    named = candidates.select("path", "disposition", "n_evidence", F.explode(F.array_distinct(F.array("path", base))).alias("asked"))
    hits = questions.join(named, "asked", "left").groupBy("question", "asked").agg(F.count_distinct("path").alias("n"), F.max("disposition").alias("disposition"), F.max("n_evidence").alias("e"))
    status = F.when(F.col("n") == 0, "NOT_CONSIDERED").when(F.col("n") > 1, "AMBIGUOUS").when(F.coalesce("e", F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE").otherwise("OK")
    return hits.select("question", status.alias("status"), F.when(status == "OK", F.col("disposition")).alias("disposition"))


def lints(candidates: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(code, entity) of three coverage checks over candidates (path, rank, role, selected, reason) and exclusions (path)."""
    roles = candidates.groupBy("role").agg(F.count("*").alias("n"), F.count_if("selected").alias("s"))
    a = roles.filter("n > 0 and s = 0").select(F.lit("AVAILABLE_ROLE_NOT_SELECTED").alias("code"), F.col("role").alias("entity"))
    b = candidates.filter((F.col("rank") == 1) & F.col("reason").isin("BUDGET_EXHAUSTED", "GLOBAL_BUDGET")).select(F.lit("TOP_CANDIDATE_BUDGET_LOSS").alias("code"), F.col("path").alias("entity"))
    return a.unionByName(b).unionByName(exclusions.select(F.lit("SOURCE_UNAVAILABLE").alias("code"), F.col("path").alias("entity")))


def stale_sources(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded sources (path, hash) that are no longer there as recorded."""
    return recorded.join(current, ["path", "hash"], "left_anti")


def replay(recorded: DataFrame, sources: DataFrame, current: DataFrame, supplied: DataFrame, reproduced: DataFrame, indexed: bool = True) -> DataFrame:
    """(capsule_hash, status, reproduced_hash, payload_matches, changed): what running recorded capsules again shows.

    recorded: (capsule_hash, task, task_hash, strategy, payload_hash, inspect_only), task being null if it was not kept; sources:
    (capsule_hash, path, hash) of each; current: (path, hash) now; supplied: (capsule_hash, task) given for the run; reproduced:
    (capsule_hash, reproduced_hash, strategy, payload_hash), a row for each that could be compiled again; indexed: is there an
    active generation. The first that applies: INSPECTED, TASK_MISMATCH, TASK_REQUIRED, SOURCE_CHANGED, CANNOT_REPRODUCE,
    STRATEGY_UNAVAILABLE, EXACT_MATCH, PAYLOAD_MATCH_PROVENANCE_CHANGED, PAYLOAD_CHANGED."""
    stale = stale_sources(sources, current).groupBy("capsule_hash").agg(F.array_sort(F.collect_set("path")).alias("stale"))
    given = supplied.select("capsule_hash", F.col("task").alias("given"))
    again = reproduced.select("capsule_hash", "reproduced_hash", F.col("strategy").alias("again"), F.col("payload_hash").alias("payload"), F.lit(True).alias("ran"))
    rows = recorded.join(given, "capsule_hash", "left").join(stale, "capsule_hash", "left").join(again, "capsule_hash", "left")
    known = F.sha2(F.coalesce("given", "task"), 256) == F.col("task_hash")
    same = F.col("payload").eqNullSafe(F.col("payload_hash"))
    status = (
        F.when(F.col("inspect_only"), "INSPECTED").when(F.col("given").isNotNull() & ~known, "TASK_MISMATCH").when(~F.coalesce(known, F.lit(False)), "TASK_REQUIRED")
        .when(F.col("stale").isNotNull(), "SOURCE_CHANGED").when(F.lit(not indexed) | F.col("ran").isNull(), "CANNOT_REPRODUCE").when(~F.col("again").eqNullSafe(F.col("strategy")), "STRATEGY_UNAVAILABLE")
        .when(F.col("reproduced_hash") == F.col("capsule_hash"), "EXACT_MATCH").when(same, "PAYLOAD_MATCH_PROVENANCE_CHANGED").otherwise("PAYLOAD_CHANGED")
    )
    ran = status.isin("EXACT_MATCH", "PAYLOAD_MATCH_PROVENANCE_CHANGED", "PAYLOAD_CHANGED")
    changed = F.when(status == "SOURCE_CHANGED", F.col("stale")).otherwise(F.array().cast("array<string>"))
    return rows.select("capsule_hash", status.alias("status"), F.when(ran, F.col("reproduced_hash")).alias("reproduced_hash"), F.when(ran, same).alias("payload_matches"), changed.alias("changed"))


def invalid_controls(controls: DataFrame) -> DataFrame:
    """(path, problem) of controls (kind, path, start_line, end_line): unknown kinds, duplicates, conflicts, bad ranges, and
    more than MAX_CONTROLS of them (without a path)."""
    bad = controls.filter(~F.col("kind").isin(CONTROLS)).select("path", F.lit("UNKNOWN_KIND").alias("problem"))
    twice = controls.groupBy("kind", "path", "start_line", "end_line").count().filter("count > 1").select("path", F.lit("DUPLICATE").alias("problem"))
    both = controls.groupBy("path").agg(F.bool_or(F.col("kind") == "EXCLUDE").alias("x"), F.bool_or(F.col("kind") != "EXCLUDE").alias("o")).filter("x and o").select("path", F.lit("CONFLICT").alias("problem"))
    span = controls.filter((F.col("kind") == "RANGE") & ~F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False))).select("path", F.lit("BAD_RANGE").alias("problem"))
    many = controls.agg(F.count("*").alias("n")).filter(F.col("n") > MAX_CONTROLS).select(F.lit(None).cast("string").alias("path"), F.lit("TOO_MANY").alias("problem"))
    return bad.unionByName(twice).unionByName(both).unionByName(span).unionByName(many)


def apply_controls(candidates: DataFrame, controls: DataFrame) -> DataFrame:
    """candidates (task_id, path and more) with excluded, mandatory and control_order, by controls (task_id, kind, path).

    PIN and RANGE make a path mandatory (order 0); PREFER names a path and FOCUS a path or folder (order 1); others come
    after (order 2). EXCLUDE takes a path out."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    named = candidates.select("task_id", "path", F.explode(above).alias("at")).join(controls.select("task_id", F.col("path").alias("at"), "kind"), ["task_id", "at"])
    named = named.filter((F.col("at") == F.col("path")) | (F.col("kind") == "FOCUS"))
    kinds = named.groupBy("task_id", "path").agg(*[F.bool_or(F.col("kind").isin(ks)).alias(c) for c, ks in (("excluded", ["EXCLUDE"]), ("mandatory", ["PIN", "RANGE"]), ("preferred", ["PREFER", "FOCUS"]))])
    out = candidates.join(kinds, ["task_id", "path"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    order = F.when(flag("mandatory"), 0).when(flag("preferred"), 1).otherwise(2)
    return out.select(*candidates.columns, flag("excluded").alias("excluded"), flag("mandatory").alias("mandatory"), order.alias("control_order"))


def unmet_controls(candidates: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls (task_id, kind, path) that name no candidate (task_id, path); a FOCUS may name a folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    paths = candidates.select("task_id", "path", F.explode(above).alias("at"))
    folders = paths.select("task_id", F.col("at").alias("path")).distinct()
    focus = controls.filter("kind = 'FOCUS'").join(folders, ["task_id", "path"], "left_anti")
    return controls.filter("kind != 'FOCUS'").join(candidates.select("task_id", "path"), ["task_id", "path"], "left_anti").unionByName(focus)
