"""Quality classification by a convolutional network on bytes, in numpy.

Filters of WIDTH bytes run over the whole text, a byte at a time; a filter is a table of a weight per place and byte, so a
convolution is WIDTH lookups.  Activations are max-pooled over overlapping chunks of two blocks each, and
the chunks are combined by maximum and by mean into one logistic unit: a junk line anywhere shows in the
maximum, its share of the text in the mean.  Training is plain back-propagation with Adam on a bounded
sample of labelled texts; scoring runs inside Arrow batches, a bounded number of bytes at a time.

Defined cases: null and empty texts have no activation and get the score of the bias alone; labels that
are null are left out; a text labelled twice counts twice; if nothing or only one label is known, the
score is the labels' mean (0.5 for none); repeated rows agree; an empty table gives an empty result;
columns of the input that have a result's name are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, FILTERS = 6, 16
#: Positions of a block; a chunk is two blocks, so chunks overlap by half.
BLOCK = 128
#: Bounds of the training sample: texts (by least hash; whole), passes over it.
MAX_TEXTS, EPOCHS = 1200, 12
THRESHOLD = 0.7


@dataclass
class Network:
    """tables[place, byte, filter], the filters' bias, and the weights of [maximum, mean] with their bias."""

    tables: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Of one text, zero-padded to WIDTH: positions x filters."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        n = len(data) - WIDTH + 1
        out = np.broadcast_to(self.shift, (n, FILTERS)).copy()
        for k in range(WIDTH):
            out += self.tables[k][data[k : k + n]]
        return out

    def features(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' maximum and mean, and the chunk values with the positions that they come from."""
        act = self.activations(data)
        n = len(act)
        starts = np.arange(0, n, BLOCK)
        top = np.maximum.reduceat(act, starts, axis=0)
        if len(starts) > 1:
            top = np.maximum(top[:-1], top[1:])
        chunk = np.maximum(top, 0)
        return np.concatenate([chunk.max(0), chunk.mean(0)]), chunk, act

    def score(self, data: np.ndarray) -> float:
        z = self.bias
        if len(data):
            z = z + float(self.features(data)[0] @ self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(net: Network, data: np.ndarray, label: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the logistic loss of one text, by tables, shift, weights and bias; it reaches the positions of the chunk maxima only."""
    tables, shift = np.zeros_like(net.tables), np.zeros_like(net.shift)
    if not len(data):
        return tables, shift, np.zeros_like(net.weights), 1 / (1 + np.exp(-net.bias)) - label
    feat, chunk, act = net.features(data)
    error = 1 / (1 + np.exp(-np.clip(feat @ net.weights + net.bias, -30, 30))) - label
    g = np.repeat((error * net.weights[FILTERS:] / len(chunk))[None], len(chunk), 0)
    g[chunk.argmax(0), np.arange(FILTERS)] += error * net.weights[:FILTERS]
    g *= chunk > 0
    begin = np.arange(len(chunk)) * BLOCK
    where = np.array([a + act[a : a + 2 * BLOCK].argmax(0) for a in begin])
    padded = data if len(data) >= WIDTH else np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    column = np.broadcast_to(np.arange(FILTERS), where.shape)
    for k in range(WIDTH):
        np.add.at(tables[k], (padded[where + k], column), g)
    return tables, g.sum(0), error * feat, error


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Network(net.tables * 0, net.shift, net.weights * 0, float(np.log(p / (1 - p))))
    data = [np.frombuffer(t, np.uint8) for t in texts]
    params = [net.tables, net.shift, net.weights, np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 16
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            net.bias = float(params[3][0])
            for i in order[at : at + batch]:
                for sum_, part in zip(grads, gradient(net, data[i], y[i]), strict=True):
                    sum_ += part / batch
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype) + (1e-5 * p).astype(p.dtype)
    net.bias = float(params[3][0])
    return net


def fit(labelled: DataFrame, max_texts: int = MAX_TEXTS) -> Network:
    """Learn from columns text and quality; the sample is the max_texts rows of least text hash."""
    rows = labelled.filter("quality is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int").alias("quality"))
    n = rows.select("quality").count()
    h = F.xxhash64("text")
    if n > 2 * max_texts:  # thin out by hash first, so that few rows are sorted; twice as many as needed stay on average
        rows = rows.filter(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 2 * max_texts / n))
    rows = rows.orderBy(F.pmod(h, F.lit(1 << 20)), "text", "quality").limit(max_texts).collect()
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows])


def score(spark: SparkSession, df: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of df's, if None) with score (0 to 1: the chance of label 1)."""
    common.bound_batches(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c != "score"]
    source = "text" if "text" in keep else "__text"  # a kept text travels once
    shared = spark.sparkContext.broadcast(net)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, z, data, offsets in common.text_slices(batch.column(source)):
                for i in range(z - a):
                    out[a + i] = net.score(data[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out)], names=schema.names)

    return df.select(*keep, *([] if "text" in keep else [F.col("text").alias(source)])).mapInArrow(apply, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", common.held_out().alias("held_out"))
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    # texts of a bounded number of labelled ids: the ids are thinned before any text is moved
    wanted = labels.filter(~common.held_out() & F.col("quality").isNotNull())
    n = wanted.count()
    if n > 2 * MAX_TEXTS:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 2 * MAX_TEXTS / n))
    net = fit(docs.filter("not held_out").join(wanted, "doc_id"))
    scored = score(spark, docs, net, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
