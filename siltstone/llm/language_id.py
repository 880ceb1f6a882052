"""Language identification by prediction by partial matching (PPM) on bytes.

Each language has a context tree of variable order: contexts of up to `ORDER` bytes with the counts of
the byte that followed.  A byte's code length is that of PPM with escape method C and exclusion: the
longest known context predicts it or escapes to the next shorter one, down to a uniform order -1.  The
statistics are frozen after training, so the code length of any (context, byte) is a constant; training
computes them all once, as a table over the union of the languages' trees, and scoring is a walk down
the tree and a lookup per byte.  A text goes to the language that codes it in the fewest bits.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that
sorts first; rows are judged one by one, so repeated rows agree; an empty table gives an empty result;
with nothing to learn from every text is `und`.  Columns of the input that have a result's name are
replaced by it.
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

ORDER = 3
#: Bounds of the model: training texts per language (about; distinct ones, picked by hash), contexts, bytes of table.
MAX_TEXTS = 1000
MAX_CONTEXTS = 16_384
MAX_TABLE_BYTES = 64 << 20
PAD = 10


@dataclass
class PpmModel:
    """child[node, class]: the node of the context one byte longer; bits[node * classes + class, language]."""

    languages: list[str]
    classes: np.ndarray
    child: np.ndarray
    bits: np.ndarray


def _context_bytes(data: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """The byte `back` places before each byte of its text; PAD before the start."""
    out = np.full(len(data), PAD, np.uint8)
    out[back:] = data[:-back]
    for k in range(back):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = PAD
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column("text").filter(pa.array(langs == lang))
            for _, _, data, offsets in common.text_slices(texts):
                code, out = np.zeros(len(data), np.int64), []
                for order in range(ORDER + 1):
                    if order:
                        code |= _context_bytes(data, offsets, order).astype(np.int64) << (8 * (order - 1))
                    found, n = np.unique((code << 8) | data, return_counts=True)
                    out.append((np.full(len(found), order, np.int32), found >> 8, (found & 255).astype(np.int32), n))
                parts = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts[0]), pa.string()), *map(pa.array, parts)], names=["lang", "depth", "context", "byte", "n"])


def sample_texts(labelled: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """About max_texts distinct (lang, text) rows per language, picked by the text's hash; all if there are fewer."""
    labelled = labelled.select("lang", "text").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return labelled
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, max_texts / n))])
    h = F.xxhash64("text")
    return labelled.filter(F.pmod(h, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).groupBy("lang", h.alias("h")).agg(F.min("text").alias("text")).drop("h")


def fit(labelled: DataFrame, max_texts: int = MAX_TEXTS, max_contexts: int = MAX_CONTEXTS) -> PpmModel:
    """Learn from the columns text and lang.  Counting is a Spark job; the driver gets the pruned counts."""
    counts = common.materialize(
        sample_texts(labelled, max_texts)
        .mapInArrow(_count, "lang string, depth int, context long, byte int, n long")
        .groupBy("lang", "depth", "context", "byte")
        .agg(F.sum("n").alias("n"))
    )
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    symbols = sorted(r["byte"] for r in counts.select("byte").distinct().collect())
    kept = max(1, min(max_contexts, MAX_TABLE_BYTES // max(1, 4 * (len(symbols) + 1) * len(languages))))
    contexts = counts.filter("depth > 0").groupBy("depth", "context").agg(F.sum("n").alias("total"))
    contexts = contexts.orderBy(F.desc("total"), "depth", "context").limit(kept)
    rows = counts.join(contexts, ["depth", "context"], "left_semi").unionByName(counts.filter("depth = 0")).toArrow()
    rows = rows.set_column(rows.schema.get_field_index("lang"), "lang", rows.column("lang").dictionary_encode())
    return compile_model(languages, rows.to_pandas())


def compile_model(languages: list[str], counts) -> PpmModel:
    """Code lengths of every (node, byte) from counts (pandas: lang, depth, context, byte, n)."""
    symbols = np.unique(counts["byte"].to_numpy(np.int64)) if len(counts) else np.zeros(0, np.int64)
    width = len(symbols) + 1  # the last class: bytes never seen
    classes = np.full(256, width - 1, np.uint8 if width <= 256 else np.int64)
    classes[symbols] = np.arange(len(symbols))
    shift = 8 * ORDER
    keys = (counts["depth"].to_numpy(np.int64) << shift) | counts["context"].to_numpy(np.int64)
    nodes = np.unique(np.append(keys, 0))
    while True:
        depth, context = nodes >> shift, nodes & ((1 << shift) - 1)
        back = np.maximum(depth - 1, 0)
        up = (back << shift) | (context & ((1 << 8 * back) - 1))
        # a context's count never exceeds its parent's, but the cut may break ties between them: keep whole chains only
        held = np.isin(up, nodes)
        if held.all():
            break
        nodes = nodes[held]
    parent, dead = np.searchsorted(nodes, up), len(nodes)
    child = np.full((dead + 1, width), dead, np.int32)
    deep = np.flatnonzero(depth)
    child[parent[deep], classes[context[deep] >> 8 * back[deep]]] = deep
    bits = np.zeros((dead, width, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        key = keys[(counts["lang"] == lang).to_numpy()]
        at = np.minimum(np.searchsorted(nodes, key), dead - 1)
        at = np.where(nodes[at] == key, at, -1)
        n = np.zeros((dead, width))
        n[at[at >= 0], classes[own["byte"].to_numpy(np.int64)[at >= 0]]] = own["n"].to_numpy()[at >= 0]
        chance, carry, seen, cur = np.zeros((dead, width)), np.ones((dead, 1)), np.zeros((dead, width), bool), np.arange(dead)
        for _ in range(ORDER + 1):
            c = np.where(seen, 0, n[cur])
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            chance += carry * c / np.maximum(total + kinds, 1)
            carry *= np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
            seen |= c > 0
            cur = parent[cur]
        chance += np.where(seen, 0, carry / np.maximum(256 - seen.sum(1, keepdims=True), 1))
        bits[:, :, j] = -np.log2(np.maximum(chance, 1e-300))
    return PpmModel(languages, classes, child, bits.reshape(dead * width, len(languages)))


def code_lengths(model: PpmModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) in each language (columns)."""
    width = model.child.shape[1]
    flat, dead = model.child.reshape(-1), len(model.child) - 1
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(data):
        return out
    cur = best = np.zeros(len(data), np.int32)
    for back in range(1, ORDER + 1):
        cur = flat[cur * np.int32(width) + model.classes[_context_bytes(data, offsets, back)]]
        best = np.where(cur != dead, cur, best)
    bits = model.bits[best * np.int32(width) + model.classes[data]]
    full = np.flatnonzero(np.diff(offsets))
    for j in range(out.shape[1]):
        out[full, j] = np.add.reduceat(bits[:, j], offsets[:-1][full], dtype=np.float64)
    return out


def identify(spark: SparkSession, df: DataFrame, model: PpmModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of df's, if None) with lang_pred, score (0 to 1: the chance of the language
    among those learned, all equally likely before) and bits_per_byte (of the best language; null if und)."""
    common.bound_batches(spark)
    names = {"lang_pred", "score", "bits_per_byte"}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = "text" if "text" in keep else "__text"  # a kept text travels once
    shared = spark.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    assert len(fields) == len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model.languages, "und"], object)
        for batch in batches:
            texts, letter = batch.column(source), batch.column("__letter").to_numpy(zero_copy_only=False)
            pred, chance, per = np.full(len(texts), len(langs) - 1), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if model.languages:
                for a, z, data, offsets in common.text_slices(texts):
                    bits = code_lengths(model, data, offsets)
                    pred[a:z] = bits.argmin(1)
                    least = bits.min(1)
                    chance[a:z] = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                    per[a:z] = least / np.maximum(np.diff(offsets), 1)
            no = ~letter.astype(bool)
            pred[no], chance[no], per[no] = len(langs) - 1, 0, np.nan
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs[pred], pa.string()), pa.array(chance), pa.array(per, mask=np.isnan(per))], names=schema.names)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    return df.select(*keep, *([] if "text" in keep else [F.col("text").alias(source)]), letter.alias("__letter")).mapInArrow(score, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~common.held_out()))
    docs = docs.select("doc_id", "text", common.held_out().alias("held_out"))
    return identify(spark, docs, model, keep=["doc_id", "held_out"])
