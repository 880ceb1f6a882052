"""Hard negatives by norm-bucketed search.

Vectors are cut to integers (floor of 256 times each component).  An anchor's positives are its best other rows
of the same label; each positive's score opens a window, and the best rows of other labels inside it are the hard
negatives.  Both are one search: for windows of an anchor, the k best rows whose score lies inside.

Candidates are sorted by norm: levels of one per cent each (at most some 70,000, as doubles end there), which are
dealt into shards of bounded size, and blocks of descending norm inside a shard.  By Cauchy-Schwarz no score in a
shard or block exceeds the anchor's norm times the largest norm there.  An anchor is sent only to shards that can
reach the lower limit of one of its windows, which are a prefix of all shards; inside a shard the windows that no
further block can reach, by their lower limit or by their k-th score so far, are closed, and an anchor without open
windows is done.  The shards' best are merged by a ranking window.

Defined cases: rows with a null id or label, and vectors that are null or hold a null or non-finite component (also
after scaling), take no part; a missing component counts as 0; an anchor's own rows (all with its id) are neither
positives nor negatives; an anchor repeated with the same label and vector is answered once; repeated rows take a rank
each, ties go to the smaller id; scores beyond 64 bits count as the end of that range; an anchor without positives,
or a window without rows, gives no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tiles

SHARD_ROWS, BLOCK_ROWS = 16384, 1024
#: Anchors that meet a block together.
AT_ONCE = 64
LEVEL = math.log(1.01)
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Longer norms count as this one: with any other it bounds more than 64-bit scores.
LONGEST = 1.7e308
#: Norms are rounded doubles: bounds are this much wider.
SLACK = 1 + 1e-9


class Shard:
    """Candidates in blocks of descending norm."""

    def __init__(self, rows: pa.Table):
        norm = rows.column("norm").to_numpy()
        order = np.argsort(-norm, kind="stable")
        self.ids, self.norm = rows.column("vec_id").to_numpy()[order], norm[order]
        self.labels = rows.column("label").to_numpy()[order]
        self.vectors = tiles.matrix(rows.column("v"))[order]

    def search(self, anchors: list[dict], vectors: np.ndarray, same: bool, k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, row numbers, scores) of the k best rows by score, then id, for each window of each anchor."""
        none = np.zeros(0, np.int64)
        limits = [_limits(x["scores"]) for x in anchors]
        floor = [[low for low, _ in x] for x in limits]
        best = [[(none, none) for _ in x] for x in limits]
        self.read = 0  # pairs of an anchor and a block
        for at in range(0, len(self.ids), BLOCK_ROWS):
            to = at + BLOCK_ROWS
            most = [x["norm"] * self.norm[at] * SLACK for x in anchors]
            open_ = [[j for j, (low, high) in enumerate(limits[i]) if low <= high and most[i] >= floor[i][j]] for i in range(len(anchors))]
            asking = [i for i, js in enumerate(open_) if js]
            if not asking:
                break
            self.read += len(asking)
            all_scores = tiles.inner(vectors[asking], self.vectors[at:to])
            for i, scores in zip(asking, all_scores, strict=True):
                allowed = (self.labels[at:to] == anchors[i]["label"]) == same
                allowed &= self.ids[at:to] != anchors[i]["vec_id"]
                for j in open_[i]:
                    fits = np.flatnonzero(allowed & (scores >= floor[i][j]) & (scores <= limits[i][j][1]))
                    if not len(fits):
                        continue
                    rows, found = np.concatenate([best[i][j][0], at + fits]), np.concatenate([best[i][j][1], scores[fits]])
                    first = np.lexsort((self.ids[rows], -found))[:k]
                    best[i][j] = rows[first], found[first]
                    if len(first) == k:
                        floor[i][j] = max(floor[i][j], int(found[first[-1]]))
        return [(i, j, *x) for i, own in enumerate(best) for j, x in enumerate(own)]


def _limits(scores: list[int | None]) -> list[tuple[int, int]]:
    """The least and greatest score of each window, in whole numbers; no score: no limits."""
    return [(-(2**63), 2**63 - 1) if p is None else (-(-LOW * p // 100), HIGH * p // 100) for p in scores]


def _search(candidates: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(a, turn, rank, vec_id, score): the k best rows for each window of anchors (shard, a, vec_id, label, norm, v, turns, scores)."""
    id_type = candidates.schema["vec_id"].dataType.simpleString()

    def reply(shard: Shard, asked: pa.Table) -> pa.Table:
        a, turn, none = [], [], np.zeros(0, np.int64)
        rows, scores = [none], [none]
        vectors = tiles.matrix(asked.column("v"), shard.vectors.shape[1])
        anchors = asked.drop_columns(["v"]).to_pylist()
        for first in range(0, len(anchors), AT_ONCE):
            some = anchors[first : first + AT_ONCE]
            for i, j, at, found in shard.search(some, vectors[first : first + AT_ONCE], same, k):
                a += [some[i]["a"]] * len(at)
                turn += [some[i]["turns"][j]] * len(at)
                rows.append(at)
                scores.append(found)
        ids = pa.array(shard.ids[np.concatenate(rows)], asked.schema.field("vec_id").type)
        return pa.table({"a": pa.array(a, pa.int64()), "turn": pa.array(turn, pa.int32()), "vec_id": ids, "score": pa.array(np.concatenate(scores))})

    found = tiles.answer(candidates, anchors, Shard, reply, f"a long, turn int, vec_id {id_type}, score long")
    order = Window.partitionBy("a", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vectors (vec_id, embedding, label);
    is_anchor: a condition on vec_id."""
    rows = vectors.filter("vec_id is not null and label is not null").select("vec_id", "label", tiles.scaled("embedding").alias("v")).filter("v is not null")
    norm = F.least(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(LONGEST))
    rows = rows.withColumn("norm", norm).withColumn("level", F.when(F.col("norm") >= 1, F.floor(F.log("norm") / LEVEL)).otherwise(-1).cast("int"))
    rows = common.materialize(rows)
    # a row per level, of which doubles allow some 70,000
    levels = rows.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("level")).collect()
    first, upto = {}, []
    shards = 0
    for x in levels:
        first[x["level"]] = (shards, -(-x["n"] // SHARD_ROWS))
        shards += first[x["level"]][1]
        upto.append({"most": x["most"], "shards": shards})
    where = vectors.sparkSession.createDataFrame([(level, at, n) for level, (at, n) in first.items()], "level int, first int, salts int")
    candidates = rows.join(F.broadcast(where), "level").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "salts")).cast("int").alias("shard"), "vec_id", "label", "norm", "v")
    anchors = rows.filter(is_anchor).select(F.xxhash64("vec_id", "label", "v").alias("a"), "vec_id", "label", "norm", "v").dropDuplicates(["a", "vec_id", "label"])
    anchors = common.materialize(anchors)
    any_ = anchors.withColumn("turns", F.array(F.lit(0))).withColumn("scores", F.array(F.lit(None).cast("long")))
    best = _search(candidates, tiles.to_all(any_, shards), True, positives)
    best = common.materialize(best.select("a", F.col("rank").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))).alias("w"))  # at most `positives` each
    asked = anchors.join(windows, "a").withColumn("turns", F.col("w.turn")).withColumn("scores", F.col("w.positive_score")).drop("w")
    # windows below a negative score are empty, and the shards that can reach the lowest limit are the first ones
    low = F.array_min(F.filter("scores", lambda p: p >= 0)) * (LOW / 100)
    reach = F.from_json(F.lit(json.dumps(upto)), "array<struct<most:double,shards:int>>")
    reach = F.array_max(F.transform(F.filter(reach, lambda x: F.col("norm") * x["most"] * SLACK >= low), lambda x: x["shards"]))
    found = _search(candidates, tiles.to_all(asked, F.coalesce(reach, F.lit(0))), False, negatives)
    out = found.select("a", "turn", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["a", "turn"])
    out = out.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
