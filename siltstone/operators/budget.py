"""An ordered choice under a limit of rows and of bytes, without sorting a task's rows in one place.

Rows are taken in order; a row that would exceed the bytes is passed over and later, smaller ones may still fit.
Rows are sorted by ranges of (task, turn, path), so that a large task lies in many ranges. A round adds up the ranges,
takes whole ranges up to the limit and rows of the range at the limit, and passes over the row that doesn't fit.
What remains are later rows that are no larger than what is left; each round takes some of them, until none remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Files that a task looks into, and their bytes (fixed values).
MOST_FILES, MOST_BYTES = 10_000, 64 << 20


def within(rows: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows (task_id, path, turn, size) with taken: in order of turn (null last), then path. A null size counts as 0; rows
    without a task take no part."""
    order = [F.asc_nulls_last("turn"), F.asc("path"), F.asc("size")]
    rows = rows.filter("task_id is not null").select("task_id", "path", "turn", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    dealt = rows.repartitionByRange("task_id", *order).withColumn("part", F.spark_partition_id())
    rest = materialize(dealt)
    room = rest.select("task_id").distinct().select("task_id", F.lit(most_bytes).cast("long").alias("room"), F.lit(most_files).cast("long").alias("left"))
    settled: list[DataFrame] = []
    while True:
        parts = rest.groupBy("task_id", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        before = Window.partitionBy("task_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("bytes0", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).join(room, "task_id")
        fits = (F.col("bytes0") + F.col("bytes") <= F.col("room")) & (F.col("n0") + F.col("n") <= F.col("left"))
        parts = materialize(parts.withColumn("kind", F.when(fits, "whole").when((F.col("bytes0") <= F.col("room")) & (F.col("n0") < F.col("left")), "edge").otherwise("after")))
        first = parts.filter("kind = 'edge'").groupBy("task_id").agg(F.min("part").alias("edge"))
        known = rest.join(parts.select("task_id", "part", "bytes0", "n0", "kind", "room", "left"), ["task_id", "part"]).join(first, "task_id", "left")
        whole = known.filter((F.col("kind") == "whole") & (F.col("edge").isNull() | (F.col("part") < F.col("edge")))).withColumn("taken", F.lit(True))
        # only the range at the limit is sorted
        upto = Window.partitionBy("task_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        edge = known.filter(F.col("part") == F.col("edge")).withColumn("at", F.row_number().over(Window.partitionBy("task_id", "part").orderBy(*order)))
        edge = edge.withColumn("taken", (F.col("bytes0") + F.sum("size").over(upto) <= F.col("room")) & (F.col("n0") + F.col("at") <= F.col("left"))).drop("at")
        later = known.filter(F.when(F.col("edge").isNull(), F.col("kind") != "whole").otherwise(F.col("part") > F.col("edge"))).withColumn("taken", F.lit(False))
        judged = materialize(whole.unionByName(edge).unionByName(later).select(*rest.columns, "taken"))
        spent = judged.filter("taken").groupBy("task_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        room = materialize(room.join(spent, "task_id", "left").select("task_id", (F.col("room") - F.coalesce("bytes", F.lit(0))).alias("room"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")))
        open_ = judged.filter("not taken").join(room, "task_id").withColumn("open", (F.col("size") <= F.col("room")) & (F.col("left") > 0)).drop("room", "left")
        open_ = materialize(open_)
        settled += [judged.filter("taken"), open_.filter("not open").drop("open")]
        rest = open_.filter("open").drop("open", "taken")
        if rest.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("task_id", "path", "turn", "size", "taken")
