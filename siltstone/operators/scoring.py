"""Evidence to scores: deduplication, ordered capped sums, fusion and ranking.

Evidence rows: task_id, path, kind, family, signal, target, weight, distance, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id, round6

# Weights and caps of the two scorers.
WEIGHTS = {
    "EXACT_QUALIFIED_SYMBOL": 120, "EXACT_PATH": 110, "EXACT_SYMBOL": 100, "EXACT_BASENAME": 82, "TECHNICAL_LEXICAL": 58,
    "SYMBOL_COMPONENT": 42, "IMPORT_MODULE": 34, "PATH_COMPONENT": 30, "LEXICAL": (28, 8, 4), "GIT_DIRTY": 2, "GIT_RECENCY": 3,
}
FAMILY_CAPS = {"IDENTITY": 150, "LEXICAL": 120, "STRUCTURAL": 65, "GIT": 5}
LEXICAL_SIGNAL_CAP = 50
OWNERSHIP = 44
PER_SIGNAL, MAX_DIRECT, PER_SYMBOL, PRIMARY, FINAL = 32, 64, 16, 200, 256
LEXICAL_FILES = 120
WEIGHTS_2 = {
    "EXACT_QUALIFIED_SYMBOL": 180, "EXACT_PATH": 175, "EXACT_SYMBOL": 150, "EXACT_BASENAME": 135, "AMBIGUOUS_SYMBOL": 30, "SYMBOL_COMPONENT": 32,
    "IMPORT_MODULE": 28, "PATH_COMPONENT": 24, "TECHNICAL_LEXICAL": 82, "GENERAL_LEXICAL": 30, "GIT_DIRTY": 1, "GIT_RECENCY": 2,
}
REPEATED_2 = (0.16, 0.08)
FAMILY_CAPS_2 = {"IDENTITY": 190, "LEXICAL": 120, "SYMBOL": 64, "STRUCTURAL": 55, "RELATIONSHIP": 18, "GIT": 3}
#: Rows of evidence that a candidate keeps by where they come from, in all, and of what other candidates lend it (fixed values).
SOURCE_CAPS_2 = {"IDENTITY": 24, "VERIFIED_LEXICAL": 32, "SYMBOL_OWNERSHIP": 32, "FILE_STRUCTURAL": 32, "TEST_DOCUMENTATION": 32, "RELATIONSHIP": 32, "GIT": 4}
TOTAL_2, EXPANSION_2 = 96, 32
SIGNAL_CAP_2, SIGNAL_BONUS, MAX_SIGNAL_BONUS, FAMILY_BONUS, MAX_FAMILY_BONUS = 92, 4, 20, 8, 24


def _by(column: str, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column))


def family_order(families: list[str]) -> Column:
    return _by("family", {f: i for i, f in enumerate(families)})


def deduplicate(evidence: DataFrame) -> DataFrame:
    """One row per (kind, family, signal, target, distance, source) of a candidate: that of most weight."""
    return evidence.groupBy("task_id", "path", "kind", "family", "signal", "target", "distance", "source").agg(F.max("weight").alias("weight"))


def _ordered() -> list:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [family_order(list(FAMILY_CAPS)), F.desc("weight"), F.col("kind"), text("signal"), F.col("target"), text("source"), F.coalesce("distance", F.lit(0))]


def contributions(evidence: DataFrame) -> DataFrame:
    """Deduplicated evidence with `value`: what is left of its weight under the caps, in evidence order.

    A row's share of a running sum clamped at a cap is the clamped sum up to it less that before it; the
    signal's clamp comes first, the family's second."""
    rows = deduplicate(evidence)
    clamp = lambda x, cap: F.least(cap, x)
    own = Window.partitionBy("task_id", "path", "family", "signal").orderBy(*_ordered())
    total = F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, 0))
    lexical = clamp(total, F.lit(float(LEXICAL_SIGNAL_CAP))) - clamp(total - F.col("weight"), F.lit(float(LEXICAL_SIGNAL_CAP)))
    rows = rows.withColumn("share", F.when(F.col("family") == "LEXICAL", lexical).otherwise(F.col("weight")))
    family = Window.partitionBy("task_id", "path", "family").orderBy(*_ordered()).rowsBetween(Window.unboundedPreceding, 0)
    upto, cap = F.sum("share").over(family), _by("family", FAMILY_CAPS).cast("double")
    return rows.withColumn("value", F.greatest(F.lit(0.0), clamp(upto, cap) - clamp(upto - F.col("share"), cap))).drop("share")


def score(evidence: DataFrame) -> DataFrame:
    """(task_id, path, score): the sum of the contributions.

    In the sum the order cancels out: a clamped running sum ends at the clamped total, so two plain
    aggregations give it without any sort."""
    rows = deduplicate(evidence)
    signal = F.when(F.col("family") == "LEXICAL", F.coalesce("signal", F.lit("")))
    by_signal = rows.groupBy("task_id", "path", "family", signal.alias("s")).agg(F.sum("weight").alias("w"))
    capped = F.when(F.col("family") == "LEXICAL", F.least("w", F.lit(float(LEXICAL_SIGNAL_CAP)))).otherwise(F.col("w"))
    by_family = by_signal.groupBy("task_id", "path", "family").agg(F.sum(capped).alias("w"))
    capped = F.least("w", _by("family", FAMILY_CAPS).cast("double"))
    return by_family.groupBy("task_id", "path").agg(round6(F.sum(capped)).alias("score"))


def top(scored: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The k first rows of each task, numbered."""
    ranked = scored.withColumn(name, F.row_number().over(Window.partitionBy("task_id").orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def ties(ranked: DataFrame, *limits: int) -> DataFrame:
    """(task_id, k, ties): of the k first of a task's ranked (task_id, rank, score), those that share a score with one before them."""
    cut = ranked.select("task_id", "rank", "score", F.explode(F.array(*[F.lit(k) for k in limits])).alias("k"))
    within = F.when(F.col("rank") <= F.col("k"), F.col("rank"))
    each = cut.groupBy("task_id", "k", "score").agg(F.greatest(F.count(within) - 1, F.lit(0)).alias("ties"))
    return each.groupBy("task_id", "k").agg(F.sum("ties").alias("ties"))


def fold_score(evidence: DataFrame) -> DataFrame:
    """(task_id, path, score, tier, signals, families) by the second scorer.

    Evidence: task_id, path, id, kind, family, signal, symbol, weight. Signals share one budget across
    families, so the order matters: a fold over each candidate's sorted evidence (96 rows at most)."""
    names = list(FAMILY_CAPS_2)
    order = F.element_at(F.create_map(*[F.lit(x) for f, i in zip(["IDENTITY", "LEXICAL", "SYMBOL", "RELATIONSHIP", "STRUCTURAL", "GIT"], range(6), strict=True) for x in (f, i)]), F.col("family"))
    once = evidence.groupBy("task_id", "path", "id").agg(*[F.max_by(c, "weight").alias(c) for c in ("kind", "family", "signal", "symbol")], F.max("weight").alias("weight"))
    row = F.struct(order.alias("o"), (-F.col("weight")).alias("n"), "kind", F.coalesce("signal", F.lit("")).alias("signal"), F.coalesce("symbol", F.lit("")).alias("symbol"), "id", "family", "weight")
    exact = F.when(F.col("kind").isin("EXACT_QUALIFIED_SYMBOL", "EXACT_PATH"), 0).when(F.col("kind").isin("EXACT_SYMBOL", "EXACT_BASENAME"), 1)
    tier = exact.when(F.col("kind").isin("LEXICAL_SYMBOL_OWNERSHIP", "VERIFIED_LEXICAL") & (F.col("weight") >= 30), 2).when(F.col("family").isin("IDENTITY", "LEXICAL", "SYMBOL"), 3).when(F.col("family").isin("RELATIONSHIP", "STRUCTURAL"), 4).otherwise(5)
    direct = ~F.col("family").isin("STRUCTURAL", "RELATIONSHIP", "GIT")
    agreeing = F.when(~F.col("family").isin("GIT", "RELATIONSHIP"), F.when(F.col("family") == "SYMBOL", "LEXICAL").otherwise(F.col("family")))
    lists = once.groupBy("task_id", "path").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min(tier).alias("tier"),
        F.count_distinct(F.when(direct, F.col("signal"))).alias("signals"), F.count_distinct(agreeing).alias("families"),
    )
    zero = F.struct(F.lit(0.0).alias("total"), F.create_map(*[F.lit(x) for f in names for x in (f, float(FAMILY_CAPS_2[f]))]).alias("family"), F.create_map().cast("map<string,double>").alias("signal"))

    def step(state: Column, x: Column) -> Column:
        left = F.coalesce(F.try_element_at(state["signal"], x["signal"]), F.lit(float(SIGNAL_CAP_2)))
        open_ = F.try_element_at(state["family"], x["family"])
        value = F.greatest(F.lit(0.0), F.least(open_, F.when(x["signal"] == "", F.lit(float("inf"))).otherwise(left), x["weight"]))
        put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))
        spent = F.when(x["signal"] == "", state["signal"]).otherwise(put(state["signal"], x["signal"], left - value))
        return F.struct((state["total"] + round6(value)).alias("total"), put(state["family"], x["family"], open_ - value).alias("family"), spent.alias("signal"))

    total = F.aggregate("rows", zero, step, lambda s: s["total"])
    bonus = lambda n, each, most: F.least(F.lit(most), F.greatest(F.lit(0), F.col(n) - 1) * each)
    value = total + bonus("signals", SIGNAL_BONUS, MAX_SIGNAL_BONUS) + bonus("families", FAMILY_BONUS, MAX_FAMILY_BONUS)
    return lists.select("task_id", "path", round6(value).alias("score"), "tier", "signals", "families")


def bounded(evidence: DataFrame, caps: dict[str, int], total: int) -> DataFrame:
    """At most caps[source_kind] rows of each source of a candidate and `total` in all, by weight and id."""
    own = Window.partitionBy("task_id", "path", "source_kind").orderBy(F.desc("weight"), "id")
    kept = evidence.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= F.coalesce(_by("source_kind", caps), F.lit(0))).drop("_n")
    every = Window.partitionBy("task_id", "path").orderBy(F.desc("weight"), "id")
    return kept.withColumn("_n", F.row_number().over(every)).filter(F.col("_n") <= total).drop("_n")


def git_2(rows: DataFrame) -> DataFrame:
    """Git evidence (task_id, path, id, kind, family, weight) of candidates (task_id, path, status, commits): files that differ from
    the last commit, and files in recent commits, by the logarithm of their number."""
    dirty = F.when(~F.col("status").isin("clean", "deleted"), F.struct(F.lit("GIT_DIRTY").alias("kind"), F.lit(float(WEIGHTS_2["GIT_DIRTY"])).alias("weight")))
    recent = round6(F.least(F.lit(float(WEIGHTS_2["GIT_RECENCY"])), F.log2(F.lit(1.0) + F.col("commits"))))
    recent = F.when(F.col("commits") > 0, F.struct(F.lit("GIT_RECENCY").alias("kind"), recent.alias("weight")))
    out = rows.select("task_id", "path", F.explode(F.array_compact(F.array(dirty, recent))).alias("e"))
    return out.select("task_id", "path", hashed_id("evidence", 24, F.col("e.kind"), F.col("path")).alias("id"), "e.kind", F.lit("GIT").alias("family"), "e.weight")


def source_of(kind: Column, family: Column) -> Column:
    """Where evidence of the second search comes from."""
    return (
        F.when(family == "GIT", "GIT").when(family == "RELATIONSHIP", "RELATIONSHIP").when(kind.isin("TEST_RELATION", "DOCUMENT_RELATION"), "TEST_DOCUMENTATION").when(family == "STRUCTURAL", "FILE_STRUCTURAL")
        .when(kind == "VERIFIED_LEXICAL", "VERIFIED_LEXICAL").when(kind == "LEXICAL_SYMBOL_OWNERSHIP", "SYMBOL_OWNERSHIP").otherwise("IDENTITY")
    )


def fused(evidence: DataFrame) -> DataFrame:
    """Evidence (task_id, path, id, kind, family, weight and more) under the caps of its sources, then of direct and lent rows."""
    rows = bounded(evidence.withColumn("source_kind", source_of(F.col("kind"), F.col("family"))), SOURCE_CAPS_2, TOTAL_2)
    lent = F.when(F.col("source_kind").isin("FILE_STRUCTURAL", "TEST_DOCUMENTATION", "RELATIONSHIP"), "LENT").otherwise("DIRECT")
    return bounded(rows.withColumn("source_kind", lent), {"DIRECT": MAX_DIRECT, "LENT": EXPANSION_2}, TOTAL_2).drop("source_kind")
