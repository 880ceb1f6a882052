"""Measures of line ranges by sweeps over their ends.

A sweep is one ordered window per key: no range is paired with another, so a file with many ranges on both sides
costs a sort of its ends, not their product. Ranges hold both of their lines; rows whose range is null or empty
(start_line < 1 or end_line < start_line) take no part, and the others need no order and may overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import ratio


def _sound(ranges: DataFrame) -> DataFrame:
    return ranges.filter("start_line >= 1 and end_line >= start_line")


def _reach(rows: DataFrame, cover: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """rows with _far: how far the ranges of cover reach that start no later than the line `at` of the row."""
    ends = _sound(cover).select(*keys, F.col("start_line").alias("_at"), F.lit(0).alias("_asks"), F.col("end_line").alias("_reach"))
    both = rows.withColumns({"_at": F.col(at), "_asks": F.lit(1)}).unionByName(ends, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_far", F.max("_reach").over(upto)).filter("_asks = 1").drop("_at", "_asks", "_reach")


def inside(rows: DataFrame, cover: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, start_line, end_line and more) with inside: whether one range of cover (keys, start_line, end_line) holds all of
    it, and met: whether any has a line of it."""
    sound = F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False))
    flag = lambda far, line: sound & F.coalesce(F.col(far) >= F.col(line), F.lit(False))
    out = _reach(rows, cover, keys, "start_line").withColumn("inside", flag("_far", "end_line")).drop("_far")
    return _reach(out, cover, keys, "end_line").withColumn("met", flag("_far", "start_line")).drop("_far")


def common(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, start_line, end_line): the longest stretches of lines that ranges of both sides cover."""
    def ends(ranges: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
        both = F.explode(F.array(F.struct(F.col("start_line").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_line") + 1).alias("at"), F.lit(-1).alias("d"))))
        return _sound(ranges).select(*keys, both.alias("x")).select(*keys, "x.at", (F.col("x.d") * l).alias("l"), (F.col("x.d") * r).alias("r"))

    steps = ends(left, 1, 0).unionByName(ends(right, 0, 1)).groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    both = (F.sum("l").over(upto) > 0) & (F.sum("r").over(upto) > 0)
    steps = steps.withColumn("both", both).withColumn("turns", F.col("both") != F.coalesce(F.lag("both").over(order), F.lit(False)))
    steps = steps.filter("turns").withColumn("next", F.lead("at").over(order))
    return steps.filter("both").select(*keys, F.col("at").alias("start_line"), (F.col("next") - 1).alias("end_line"))


def tokens(ranges: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """ranges (keys with path, start_line, end_line) with tokens: those of their lines in files (path, lines)."""
    shown = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return ranges.join(files.select("path", "lines"), "path").select(*keys, "start_line", "end_line", T.estimate_tokens(shown).alias("tokens"))


def token_precision(selected: DataFrame, gold_files: DataFrame, gold_ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, content_tokens, relevant_tokens, precision, noise) for selected (task_id, path, start_line, end_line), gold files
    (task_id, path) and gold ranges (task_id, path, start_line, end_line: those of symbols and lines); files: (path, lines).

    All of what is selected in a gold file without gold ranges is relevant, nothing in other files, and else the
    lines that both cover. No selection: no precision."""
    merged = common(selected, selected, "task_id", "path")
    content = tokens(merged, files, "task_id", "path")
    gold = gold_files.select("task_id", "path").distinct()
    ranged = gold_ranges.select("task_id", "path").distinct().withColumn("ranged", F.lit(True))
    kinds = gold.join(ranged, ["task_id", "path"], "left").withColumn("ranged", F.coalesce("ranged", F.lit(False)))
    sums = content.join(kinds, ["task_id", "path"], "left").groupBy("task_id").agg(F.sum("tokens").alias("content"), F.sum(F.when(~F.col("ranged"), F.col("tokens")).otherwise(0)).alias("whole"))
    shared = tokens(common(merged, gold_ranges.join(gold, ["task_id", "path"], "left_semi"), "task_id", "path"), files, "task_id", "path")
    part = shared.groupBy("task_id").agg(F.sum("tokens").alias("part"))
    out = sums.join(part, "task_id", "left").withColumn("relevant", F.col("whole") + F.coalesce("part", F.lit(0)))
    precision = ratio(F.col("relevant"), F.col("content"))
    return out.select("task_id", F.col("content").alias("content_tokens"), F.col("relevant").alias("relevant_tokens"), precision.alias("precision"), T.round6(1 - precision).alias("noise"))


def gold_recall(gold: DataFrame, selected: DataFrame) -> DataFrame:
    """(task_id, recall, required_recall) of gold (task_id, path, start_line, end_line, importance): whole files have no lines.

    A file is found if anything of it is selected (task_id, path, start_line, end_line), a range if one selected stretch holds
    all of it; required gold weighs 2, supporting 1 (and only required counts in required_recall, once each)."""
    merged = common(selected, selected, "task_id", "path")
    files = gold.filter("start_line is null").join(merged.select("task_id", "path").distinct().withColumn("hit", F.lit(1)), ["task_id", "path"], "left")
    spans = inside(gold.filter("start_line is not null"), merged, "task_id", "path").withColumn("hit", F.col("inside").cast("int"))
    rows = files.select("task_id", "importance", "hit").unionByName(spans.select("task_id", "importance", "hit")).withColumn("hit", F.coalesce("hit", F.lit(0)))
    need = (F.col("importance") == "REQUIRED").cast("int")
    sums = rows.groupBy("task_id").agg(F.sum(F.col("hit") * (1 + need)).alias("h"), F.sum(1 + need).alias("n"), F.sum(F.col("hit") * need).alias("rh"), F.sum(need).alias("rn"))
    return sums.select("task_id", ratio(F.col("h"), F.col("n")).alias("recall"), ratio(F.col("rh"), F.col("rn")).alias("required_recall"))
