"""Evaluation of retrieval and packing against gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round6
from .provenance import violations

CUTOFFS = [1, 3, 5, 10, 20]


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, None).otherwise(round6(numerator / denominator))


def recall_at(ranked: DataFrame, gold: DataFrame, cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """(task_id, k, recall, required_recall) of ranked (task_id, path, rank) for gold (task_id, path, importance)."""
    hits = gold.join(ranked.select("task_id", "path", "rank"), ["task_id", "path"], "left")
    hits = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs])))
    hit, need = (F.col("rank") <= F.col("k")).cast("int"), (F.col("importance") == "REQUIRED").cast("int")
    sums = hits.groupBy("task_id", "k").agg(F.coalesce(F.sum(hit), F.lit(0)).alias("h"), F.count("*").alias("n"), F.coalesce(F.sum(hit * need), F.lit(0)).alias("rh"), F.sum(need).alias("rn"))
    return sums.select("task_id", "k", ratio(F.col("h"), F.col("n")).alias("recall"), ratio(F.col("rh"), F.col("rn")).alias("required_recall"))


def weighted_recall(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """(task_id, recall): required gold weighs 2, supporting 1."""
    weight = F.when(F.col("importance") == "REQUIRED", 2).otherwise(1)
    hits = gold.join(selected.select("task_id", "path").distinct().withColumn("hit", F.lit(1)), ["task_id", "path"], "left")
    sums = hits.groupBy("task_id").agg(F.sum(weight * F.coalesce("hit", F.lit(0))).alias("h"), F.sum(weight).alias("n"))
    return sums.select("task_id", ratio(F.col("h"), F.col("n")).alias("recall"))


def matched_recall(points: DataFrame, target: float) -> DataFrame:
    """(system, tasks, mean_tokens): each task's fewest tokens at which a system (task_id, recall, tokens) reaches the target."""
    least = points.filter(F.col("recall") >= target).groupBy("system", "task_id").agg(F.min("tokens").alias("t"))
    return least.groupBy("system").agg(F.count("*").alias("tasks"), round6(F.avg("t")).alias("mean_tokens"))


def win_tie_loss(points: DataFrame, left: str, right: str) -> DataFrame:
    """(wins, ties, losses) of one system against another by recall on the same task."""
    a = points.filter(F.col("system") == left).select("task_id", F.col("recall").alias("a"))
    pairs = a.join(points.filter(F.col("system") == right).select("task_id", F.col("recall").alias("b")), "task_id")
    return pairs.agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") < F.col("b")).alias("losses"))


def summary(points: DataFrame, *by: str) -> DataFrame:
    """Mean (nulls left out), median and 95th percentile of recall by group."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), round6(F.avg("recall")).alias("mean"), round6(F.percentile("recall", F.lit(0.5))).alias("median"), round6(F.percentile("recall", F.lit(0.95))).alias("p95"))


#: Languages whose files are analysed (fixed values).
SUPPORTED = ["typescript", "javascript", "tsx", "jsx", "python", "mixed"]
NEAR = 20


def failures(gold: DataFrame, ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(task_id, path, cause) of required gold files that are not selected: never in the first 20, or lost in packing."""
    need = gold.filter("importance = 'REQUIRED'").join(selected.select("task_id", "path"), ["task_id", "path"], "left_anti")
    near = ranked.filter(F.col("rank") <= NEAR).select("task_id", "path", F.lit(True).alias("near"))
    return need.join(near.distinct(), ["task_id", "path"], "left").select("task_id", "path", F.when(F.col("near"), "PACKING_DROP").otherwise("RETRIEVAL_MISS").alias("cause"))


def attribution(tasks: DataFrame, gold: DataFrame, ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(task_id, outcome, primary_cause, causes) of tasks (task_id, status, whole_file_left_out, languages).

    A task fails if required gold is not selected; causes are all that apply, sorted, and the primary one is the first of a
    cascade over the stages: what retrieval never found, what no budget allowed, what packing dropped, what is unsupported."""
    lost = failures(gold, ranked, selected).groupBy("task_id").agg(F.collect_set("cause").alias("lost"))
    rows = tasks.join(lost, "task_id", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    limit = F.coalesce((F.col("status") == "NO_CONTEXT") | F.col("whole_file_left_out"), F.lit(False))
    foreign = F.coalesce(F.exists("languages", lambda x: ~x.isin(SUPPORTED)), F.lit(False))
    causes = F.array_sort(F.array_compact(F.concat(F.col("lost"), F.array(F.when(limit, F.lit("BUDGET_LIMIT")), F.when(foreign, F.lit("UNSUPPORTED"))))))
    causes = F.when(F.size("lost") > 0, causes).otherwise(F.array().cast("array<string>"))
    rows = rows.select("task_id", causes.alias("causes"))
    order = F.array(*[F.lit(x) for x in ("RETRIEVAL_MISS", "BUDGET_LIMIT", "PACKING_DROP", "UNSUPPORTED")])
    first = F.get(F.array_intersect(order, F.col("causes")), F.lit(0))
    outcome = F.when(F.size("causes") == 0, "SUCCESS").when(F.array_contains("causes", "RETRIEVAL_MISS"), "FAILURE").otherwise("WEAKNESS")
    return rows.select("task_id", outcome.alias("outcome"), F.coalesce(first, F.lit("NO_PRIMARY_FAILURE")).alias("primary_cause"), "causes")


def failure_matrix(attributed: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, primary_cause, tasks, share): how the tasks of each group (task_id, group) end, and what part of the group that is."""
    rows = attributed.join(groups, "task_id").groupBy("group", "primary_cause").agg(F.count("*").alias("tasks"))
    total = rows.groupBy("group").agg(F.sum("tasks").alias("total"))
    return rows.join(total, "group").select("group", "primary_cause", "tasks", ratio(F.col("tasks"), F.col("total")).alias("share"))


def matrix_violations(attributed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(check, violations) of a failure matrix (task_id, outcome, primary_cause, causes) over all tasks (task_id)."""
    success = F.col("outcome") == "SUCCESS"
    return violations({
        "task_unknown": attributed.join(tasks, "task_id", "left_anti"),
        "task_not_classified": tasks.join(attributed, "task_id", "left_anti"),
        "task_classified_twice": attributed.groupBy("task_id").count().filter("count > 1"),
        "success_with_a_cause": attributed.filter(success != (F.col("primary_cause") == "NO_PRIMARY_FAILURE")),
        "primary_not_among_causes": attributed.filter(~success & ~F.array_contains("causes", F.col("primary_cause"))),
    })
