"""The composite retrieval plan: signals, direct evidence, expansion, change evidence, final ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policies as P
from ..operators import evidence as E
from ..operators import graph, scoring
from ..operators.signals import signals as signals_of
from ..sources.shared import materialize


def search(tasks: DataFrame, files: DataFrame, symbols: DataFrame | None = None, imports: DataFrame | None = None, edges: DataFrame | None = None, changes: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(task_id, rank, path, score, origin) for tasks (task_id, text) over files (path, text, category).

    Files that aren't searched are left out before any join. Direct evidence ranks 200 candidates; the first 24
    are expanded along the edges (their score before change evidence counts); then all are ranked again."""
    asked = materialize(signals_of(tasks))
    files = files.filter(~F.col("category").isin("generated", "dependency", "binary_asset"))
    informs = asked.filter("not low_value and length(normalized) >= 2").select("task_id").distinct()
    asked = asked.join(informs, "task_id", "left_semi")
    # evidence is read several times below, so it is computed once
    direct = materialize(E.direct(materialize(asked), files, symbols, imports, scoring.PRIMARY))
    category = files.select("path", "category")
    order = [F.desc("score"), P.category_priority(F.col("category")), F.col("path")]
    primary = scoring.top(scoring.score(direct).join(category, "path"), scoring.PRIMARY, *order)
    primary = materialize(primary)
    kept = primary.select("task_id", "path")
    evidence = direct.join(kept, ["task_id", "path"], "left_semi")
    if edges is not None:
        more = graph.expand(primary.select("task_id", "path", "score", "rank"), edges, known=kept)
        evidence = evidence.unionByName(more.join(category.select("path"), "path", "left_semi").select(*evidence.columns))
    evidence = materialize(evidence)
    origin = evidence.groupBy("task_id", "path").agg(F.bool_or(F.col("family") != "STRUCTURAL").alias("d"), F.bool_or(F.col("family") == "STRUCTURAL").alias("s"))
    named = F.when(F.col("d") & F.col("s"), "DIRECT_AND_EXPANDED").when(F.col("d"), "DIRECT").otherwise("EXPANDED")
    if changes is not None:
        weak = evidence.select("task_id", "path").distinct().join(graph.change_evidence(changes), "path")
        none = F.lit(None).cast("string")
        evidence = evidence.unionByName(weak.select("task_id", "path", "kind", F.lit("GIT").alias("family"), none.alias("signal"), F.col("path").alias("target"), "weight", F.lit(0).alias("distance"), none.alias("source")))
    final = scoring.score(evidence).join(origin.select("task_id", "path", named.alias("origin")), ["task_id", "path"]).join(category, "path")
    by_origin = F.when(F.col("origin") == "DIRECT_AND_EXPANDED", 0).when(F.col("origin") == "DIRECT", 1).otherwise(2)
    ranked = scoring.top(final, min(limit, scoring.FINAL), F.desc("score"), by_origin, P.category_priority(F.col("category")), F.col("path"))
    return ranked.select("task_id", "rank", "path", "score", "origin")


def baseline(tasks: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """(task_id, rank, path, score) of the plain lexical baseline."""
    files = files.filter(~F.col("category").isin("generated", "dependency", "binary_asset"))
    scored = E.baseline_first(materialize(signals_of(tasks)), files, limit)
    return scoring.top(scored, limit, F.desc("score"), F.col("turn"), F.col("path")).select("task_id", "rank", "path", "score")
