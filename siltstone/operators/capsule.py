"""Capsules: a compilation's facts as one hashed document per task, and the checks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import provenance


def canonical_json(value: Column) -> Column:
    """JSON with sorted keys and without nulls."""
    return F.to_json(F.parse_json(F.to_json(value)))


def build(candidates: DataFrame, contributions: DataFrame, selected: DataFrame, budget: int) -> DataFrame:
    """(task_id, capsule, capsule_hash) from candidates (task_id, path, rank, score), contributions (task_id, path,
    kind, family, value) and selected (task_id, path, level, tokens); every list in a stated order."""
    ident = T.hashed_id("candidate", 24, F.col("path"))
    c = candidates.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), ident.alias("id"), "path", "score"))).alias("candidates"))
    w = contributions.filter("value > 0").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(ident.alias("candidate"), "family", "kind", F.col("value").alias("value")))).alias("contributions"))
    s = selected.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(ident.alias("candidate"), "level", "tokens"))).alias("selected"), F.sum("tokens").alias("used"))
    rows = c.join(w, "task_id", "left").join(s, "task_id", "left").withColumn("budget", F.struct(F.lit(budget).alias("requested"), F.coalesce("used", F.lit(0)).alias("used"), (F.lit(budget) - F.coalesce("used", F.lit(0))).alias("unused")))
    document = F.struct("candidates", F.coalesce("contributions", F.array().cast(w.schema["contributions"].dataType)).alias("contributions"), F.coalesce("selected", F.array().cast(s.schema["selected"].dataType)).alias("selected"), "budget")
    rows = rows.select("task_id", document.alias("capsule"))
    return rows.withColumn("capsule_hash", F.sha2(canonical_json(F.col("capsule")), 256))


def check(capsules: DataFrame) -> DataFrame:
    """(check, violations): references, sums, order, budget and hash of capsules."""
    c = capsules.select("task_id", "capsule.*", "capsule", "capsule_hash")
    known = c.select("task_id", F.explode("candidates").alias("x")).select("task_id", F.col("x.id").alias("candidate"), F.col("x.score").alias("score"), F.col("x.rank").alias("rank"))
    parts = c.select("task_id", F.explode("contributions").alias("x")).select("task_id", "x.candidate", "x.value")
    chosen = c.select("task_id", F.explode("selected").alias("x")).select("task_id", "x.candidate", "x.tokens")
    sums = parts.groupBy("task_id", "candidate").agg(F.sum("value").alias("total")).join(known, ["task_id", "candidate"])
    return provenance.violations({
        "contribution_without_candidate": parts.join(known, ["task_id", "candidate"], "left_anti"),
        "selection_without_candidate": chosen.join(known, ["task_id", "candidate"], "left_anti"),
        "score_is_not_the_sum": sums.filter(F.abs(F.col("total") - F.col("score")) > 1e-4),
        "rank_repeats": known.groupBy("task_id", "rank").count().filter("count > 1"),
        "over_budget": c.filter("budget.used > budget.requested or budget.unused != budget.requested - budget.used"),
        "hash_differs": c.filter(F.col("capsule_hash") != F.sha2(canonical_json(F.col("capsule")), 256)),
    })
