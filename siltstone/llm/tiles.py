"""Shards of bounded size that answer questions streamed past them, and exact integer vectors.

A shard's rows come first in its partition and its questions after them, so that a task holds one shard and one
Arrow batch of questions, however many questions there are; a shard's rows move once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def answer(held: DataFrame, asked: DataFrame, build: Callable[[pa.Table], object], reply: Callable[[object, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What reply(build(rows of a shard), questions) gives for all shards; held and asked have a column `shard` (int)."""
    common.bound_batches(held.sparkSession)
    rest = lambda df: F.struct(*[c for c in df.columns if c != "shard"])
    kind = lambda df: df.select(rest(df).alias("x")).schema["x"].dataType
    rows = held.select("shard", F.lit(0).alias("asks"), rest(held).alias("x"), F.lit(None).cast(kind(asked)).alias("y"))
    rows = rows.unionByName(asked.select("shard", F.lit(1).alias("asks"), F.lit(None).cast(kind(held)).alias("x"), rest(asked).alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, built = None, [], None
        for batch in batches:
            shard, asks = (batch.column(c).to_numpy() for c in ("shard", "asks"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if a == z:
                    continue
                if shard[a] != at:
                    at, parts, built = shard[a], [], None
                if not asks[a]:
                    parts.append(pa.RecordBatch.from_struct_array(batch.column("x").slice(a, z - a)))
                    continue
                if built is None and parts:
                    built, parts = build(pa.Table.from_batches(parts)), []
                if built is not None:
                    questions = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column("y").slice(a, z - a))])
                    yield from reply(built, questions).to_batches()

    return rows.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(run, schema)


def to_all(asked: DataFrame, shards: int | Column) -> DataFrame:
    """A copy of each question for each of the first `shards` shards."""
    last = (F.lit(shards) if isinstance(shards, int) else shards) - 1
    return asked.withColumn("shard", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))


def scaled(embedding: str) -> Column:
    """floor(256 * x) of each component x as double; null if the vector is null or a component null or (so scaled) not finite."""
    y = F.transform(embedding, lambda x: F.lit(256.0) * x.cast("double"))
    whole = F.transform(y, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))  # larger ones are whole
    sound = F.forall(y, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(sound, whole)


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors as rows, missing components as 0."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(width or 0, sizes.max(initial=0))))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


_WHOLE = np.frompyfunc(int, 1, 1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held to the range of 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    longest = [max(1.0, float(np.abs(x).max(initial=0.0))) for x in (a, b)]
    if longest[0] * longest[1] * max(width, 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        safe = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1) < 2.0**52  # no partial sum can exceed 2^53
        out[safe] = np.where(safe, a @ b.T, 0)[safe].astype(np.int64)
    for i, j in zip(*np.nonzero(~safe), strict=True):
        total = int(sum(_WHOLE(a[i]) * _WHOLE(b[j])))
        out[i, j] = max(1 - 2**63, min(2**63 - 1, total))  # so that it can be negated
    return out
