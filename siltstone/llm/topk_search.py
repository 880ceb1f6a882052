"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are cut to integers (floor of 256 times each component) and dealt by id into shards; a shard
keeps one list per dimension, sorted by value.  A query walks all its lists at once, from the end that
suits its sign, scores in full whatever appears for the first time, and stops as soon as no unseen vector
can reach the k-th best score: the bound is the inner product with the values last read.  Ties can still
win by their id, so it stops only when the bound is strictly below.  The shards' best are merged by a
ranking window.  A shard is sorted once, and all queries are streamed past it.

Defined cases: vectors that are null or hold a null or non-finite component (also after scaling) take no
part, nor do rows with a null id; a missing component counts as 0, so an empty vector scores 0 with everything; a query's
own rows (all with its id) are no candidates; a query row repeated with the same vector is answered once;
fewer than k candidates give fewer rows; ties go to the smaller id, then repeated rows take a rank each;
an empty table gives an empty result; other columns are ignored.  Scores are exact; those beyond 64 bits
count as the end of that range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tiles

SHARD_ROWS = 8192
FIRST_DEPTH = 32


class Lists:
    """The sorted lists of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, 0)

    def search(self, own, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, depth read) of the k best rows by score, then id."""
        m = len(self.ids)
        seen = self.ids == own
        dims = np.flatnonzero(query)
        down = query[dims] > 0
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, to = 0, min(m, FIRST_DEPTH)
        while at < m:
            place = np.arange(at, to)[:, None] if len(dims) else None
            fresh = np.zeros(m, bool)
            if len(dims):
                fresh[self.order[np.where(down, m - 1 - place, place), dims]] = True
            else:  # every score is 0, and ids decide
                fresh[:], to = True, m
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, tiles.inner(self.vectors[fresh], query[None, :])[:, 0]])
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(dims) and len(rows) == k:
                with np.errstate(over="ignore", invalid="ignore"):
                    last = self.values[np.where(down, m - to, to - 1), dims] * query[dims]
                    bound = last.sum() + 1e-12 * np.abs(last).sum()  # sums of large values are rounded
                if scores.min() > bound:
                    break
            at, to = to, min(m, 2 * to)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best], to


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors (vec_id, embedding); is_query: a condition on vec_id."""
    sound = vectors.filter("vec_id is not null").select("vec_id", tiles.scaled("embedding").alias("v")).filter("v is not null")
    queries = sound.filter(is_query).dropDuplicates(["vec_id", "v"])
    shards = -(-sound.count() // SHARD_ROWS)
    # equal rows are dealt out too, by their place
    place = F.monotonically_increasing_id()
    held = sound.withColumn("shard", F.pmod(F.xxhash64("vec_id", place), F.lit(max(1, shards))).cast("int"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def build(rows: pa.Table) -> Lists:
        return Lists(rows.column("vec_id").to_numpy(), tiles.matrix(rows.column("v")))

    def search(lists: Lists, asked: pa.Table) -> pa.Table:
        found = ([], [], [])
        width = lists.vectors.shape[1]
        for own, query in zip(asked.column("vec_id").to_pylist(), tiles.matrix(asked.column("v"), width)[:, :width], strict=True):
            rows, scores, _ = lists.search(own, query, k)
            found[0].extend([own] * len(rows))
            found[1].extend(lists.ids[rows].tolist())
            found[2].extend(scores.tolist())
        id_type = asked.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(found[0], id_type), "vec_id": pa.array(found[1], id_type), "score": pa.array(found[2], pa.int64())})

    best = tiles.answer(held, tiles.to_all(queries, shards), build, search, f"query_id {kind}, vec_id {kind}, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
