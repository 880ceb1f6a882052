"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text is a weighted set: its elements are shingles of five words, weighted by how often they occur (a
text of one to four words is one shingle).  Two texts are linked if their weighted Jaccard similarity
(sum of least weights over sum of greatest) is 0.8 or more; classes are the components of the links.

Signatures: the plane weight x rank of each element is cut into unit squares, and a hash of (element,
square) throws a Poisson(1) number of darts into each, every dart with a rank and a coordinate.  A text
sees the darts under its weights; the earliest dart of each coordinate is its signature, so two texts
agree in a coordinate with a chance equal to their similarity.  Only ranks up to about (k ln k + 2k) /
total weight are looked at, and further ones just for the coordinates that are still empty.

Joining: texts that agree in a whole band of coordinates share a bucket.  Equal texts count once.  Each
bucket is linked as a star around its most central text, not as all pairs; each link is verified on the
texts.  A text that the star leaves in another component is compared with those texts of its bucket that
two exact bounds still allow: the triangle inequality (1 - similarity is a metric), and the weight that
no other such text has any part in, which cannot be shared; and whose sketches (four bits of each
coordinate) agree as only one pair in some ten thousand at similarity 0.8 does not.
With 28 bands of 6, a pair at similarity 0.8 shares a bucket with chance 0.9998.

Defined cases: texts that are null or have no word have no shingle, and each row is its own class, named
by its id; rows are documents, so two texts under one id, or under null ids, each belong to the class of
their text; a class is named by its least id (null if it has none), so ties need no breaking; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 28, 6
K = BANDS * ROWS
#: 64-bit words of a sketch, four bits of each coordinate, and the bits that may differ: those of similarity 0.66.
SKETCH = -(-K // 16)
APART = int(64 * SKETCH * (1 - 0.66) / 2)
#: Members of a star that one task verifies with one copy of the centre's text.
STAR = 512

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_DART = np.uint64(0xD1342543DE82EF95)
_SQUARE = np.uint64(0x2545F4914F6CDD1D)
_u52 = np.uint64(52)
#: A uniform 64-bit number is at least the c-th of these with the chance of c darts or more (Poisson, mean 1).
_MORE = [np.uint64(min(2**64 - 1, int(2**64 * sum(math.exp(-1) / math.factorial(i) for i in range(c))))) for c in range(1, 18)]


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each unit of weight: the n-th occurrence of a shingle in its text. Sorted within a text."""
    _, _, hashes, first = common.words(data, offsets)
    size = np.diff(first)
    index = np.repeat(np.arange(len(size)), np.maximum(size - SHINGLE + 1, 0))
    start = np.repeat(first[:-1], np.maximum(size - SHINGLE + 1, 0))
    ends = np.cumsum(np.maximum(size - SHINGLE + 1, 0))
    within = np.arange(len(index)) - np.repeat(ends - np.maximum(size - SHINGLE + 1, 0), np.maximum(size - SHINGLE + 1, 0))
    found = common.grams(hashes, SHINGLE)[start + within] if len(index) else np.zeros(0, np.uint64)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(few):
        short = np.array([common.grams(hashes[first[t] : first[t + 1]], int(size[t]))[0] + np.uint64(size[t]) for t in few], np.uint64)
        at = np.searchsorted(index, few)
        index, found = np.insert(index, at, few), np.insert(found, at, short)
    bounds = np.searchsorted(index, np.arange(len(size) + 1))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        found[a:z].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (index[1:] != index[:-1])
    place = np.arange(len(found))
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return index, common.mix(found + nth.astype(np.uint64) * _GOLD)


def throw(signature: np.ndarray, index: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Lower each text's signature by its darts of rank low to high (of its text)."""
    k = signature.shape[1]
    flat = signature.reshape(-1)
    from_, to = np.floor(low).astype(np.int64), np.ceil(high).astype(np.int64)
    squares = np.maximum(to - from_, 0)[index]
    of = np.repeat(np.arange(len(index)), squares)
    square = np.arange(len(of)) - np.repeat(np.cumsum(squares) - squares, squares) + from_[index[of]]
    text = index[of]
    seed = common.mix(cell[of] + square.astype(np.uint64) * _SQUARE)
    at = np.arange(len(of))
    for c, more in enumerate(_MORE):
        at = at[seed[at] >= more]
        if not len(at):
            break
        dart = common.mix(seed[at] + np.uint64((c + 1) * int(_DART) % 2**64))
        where = text[at]
        rank = square[at] + (dart >> np.uint64(12)).astype(np.float64) / 2.0**52
        near = (rank >= low[where]) & (rank < high[where])
        value = (square[at][near].astype(np.uint64) << _u52) | (dart[near] >> np.uint64(12))
        coordinate = ((dart[near] & np.uint64(4095)) * np.uint64(k)) >> np.uint64(12)
        np.minimum.at(flat, where[near] * k + coordinate.astype(np.int64), value)


def signatures(index: np.ndarray, cell: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """A row of k coordinates per text; all ones (2^64 - 1) for a text without cells."""
    none = np.uint64(2**64 - 1)
    out = np.full((texts, k), none, np.uint64)
    weight = np.bincount(index, minlength=texts)
    low, high = np.zeros(texts), (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    high = np.where(high > 1, np.ceil(high), high)
    todo = weight > 0
    while todo.any():
        pick = todo[index]
        throw(out, index[pick], cell[pick], low, high)
        todo = (out == none).any(1) & (weight > 0)
        low, high = high, np.where(high < 1, np.minimum(2 * high, 1), 2 * high)
    return out


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list per row; null where not full."""
    ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(rows.astype(np.int64).reshape(-1)), mask=pa.array(~full))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, sketches, weights = [], [], []
        for a, z, data, offsets in common.text_slices(batch.column("text")):
            index, cell = cells(data, offsets)
            signature = signatures(index, cell, z - a)
            full = np.isin(np.arange(z - a), index)
            bands = np.zeros((z - a, BANDS), np.uint64)
            for r in range(ROWS):
                bands = common.mix(bands * _GOLD + signature[:, r::ROWS])
            bands = common.mix(bands + np.arange(BANDS, dtype=np.uint64))  # a bucket's key names its band too
            nibbles = np.zeros((z - a, SKETCH * 16), np.uint64)
            nibbles[:, :K] = common.mix(signature) >> np.uint64(60)
            shift = np.arange(0, 64, 4, dtype=np.uint64)
            parts.append(_lists(bands, full))
            weights.append(np.bincount(index, minlength=z - a))
            sketches.append(_lists((nibbles.reshape(z - a, SKETCH, 16) << shift).sum(2, dtype=np.uint64), full))
        columns = [pa.chunked_array(x, pa.list_(pa.int64())).combine_chunks() for x in (parts, sketches)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns, pa.array(np.concatenate(weights) if weights else [], pa.int64())], names=["doc_id", "key", "bands", "sketch", "weight"])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, z, data, offsets in common.text_slices(texts):
        index, cell = cells(data, offsets)
        bounds = np.searchsorted(index, np.arange(z - a + 1))
        out += [cell[p:q] for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _star(rows: pa.Table) -> pa.Table:
    """One star: the centre's row and up to about STAR members; the similarity of each to the centre."""
    centre = rows.column("centre").to_numpy()
    left, members = _sets(rows.filter(pa.array(centre)).column("text").slice(0, 1)), rows.filter(pa.array(~centre))
    found = []
    for at in range(0, members.num_rows if left else 0, 64):
        for right in _sets(members.column("text").slice(at, 64)):
            both = np.sort(np.concatenate([left[0], right]))
            shared = int((both[1:] == both[:-1]).sum())
            found.append(shared / max(len(both) - shared, 1))
    return pa.table({"a": members.column("a").slice(0, len(found)), "b": members.column("id").slice(0, len(found)), "similarity": pa.array(found, pa.float64())})


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b), a written table, of ids of texts (id, text). A centre with many partners is dealt out by salt."""
    kind = pairs.schema["a"].dataType.simpleString()
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(common.held(stars, common.few(pairs)), "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("id"), F.lit(False).alias("centre"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(True).alias("centre"))
    rows = members.unionByName(centres).join(texts, "id")
    return rows.groupBy("a", "salt").applyInArrow(_star, f"a {kind}, b {kind}, similarity double")


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, data, offsets in common.text_slices(batch.column("text")):
            index, cell = cells(data, offsets)
            ids = batch.column("id").slice(a, z - a).take(pa.array(index))
            yield pa.RecordBatch.from_arrays([ids, pa.array((cell >> np.uint64(24)).astype(np.int64))], names=["id", "cell"])


def own_weight(texts: DataFrame) -> DataFrame:
    """(rep, own): how much of a text's weight no other of the texts (id, text) has any part in.

    Cells go by 40 bits of their hash: a collision can only lower `own`, which then still bounds."""
    kind = texts.schema["id"].dataType.simpleString()
    cell = texts.mapInArrow(_weights, f"id {kind}, cell long")
    cell = cell.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    return cell.filter("n = 1").groupBy("rep").agg(F.count("*").alias("own"))


#: Nodes made up for texts whose least id is null, or is that of another text too, lie above all ids.
_MADE = 1 << 62


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, key, root) of the rows of docs (doc_id, text) with words, key being the text's md5; (doc_id) of the
    others; and whether every root is the least id of its class."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.withColumn("key", F.md5("text"))
    signed = common.materialize(named.mapInArrow(_bands, f"doc_id {kind}, key string, bands array<long>, sketch array<long>, weight long"))
    alone = signed.filter("bands is null").select("doc_id")
    signed = signed.filter("bands is not null")
    # equal texts count once, under their least id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "bands", "sketch", "weight"))
    reps = common.materialize(signed.groupBy("key").agg(first.alias("x")).select("key", F.col("x.doc_id").alias("least"), "x.bands", "x.sketch", "x.weight"))
    made = F.lit(_MADE) + F.pmod(F.xxhash64("key"), F.lit(1 << 61))
    # a text's own row is that of its least id; the copies stay where they are
    reps = reps.withColumn("row", F.coalesce(F.col("least").cast("long"), made)).withColumn("x", F.xxhash64("key", "row"))
    twice = reps.groupBy("least").agg(F.count("*").alias("n")).filter("least is not null and n > 1").select("least", F.lit(True).alias("shared"))
    if twice.isEmpty():
        reps = reps.withColumn("rep", F.col("row")).drop("least")
    else:
        reps = reps.join(twice, "least", "left").withColumn("rep", F.when(F.col("shared").isNull(), F.col("row"))).withColumn("rep", F.coalesce("rep", made)).drop("least", "shared")
        reps = common.materialize(reps)

    buckets = reps.select("rep", "row", "x", F.explode("bands").alias("h"))
    shared = buckets.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # one row per text that shares a bucket, with its buckets (BANDS at most)
    met = buckets.join(shared, "h").groupBy("rep", "row", "x").agg(F.sum("n").alias("central"), F.collect_list("h").alias("hs"))
    met = common.materialize(met)
    few, fewer = common.few(met), common.few(met, common.HELD // BANDS)  # of rows per text, and per text and bucket
    buckets = met.select("rep", "central", F.explode("hs").alias("h"))
    leaders = buckets.groupBy("h").agg(F.min(F.struct(-F.col("central"), "rep")).getField("rep").alias("a"))
    buckets = common.materialize(buckets.join(common.held(leaders, fewer), "h").select("h", "rep", "a"))
    row = F.coalesce(F.col("doc_id").cast("long"), made)
    texts = named.filter("text is not null").select(row.alias("row"), "key", "text").select("row", F.xxhash64("key", "row").alias("x"), "text")
    # a key has one id, so copies under one id go where the join has put them
    texts = texts.join(common.held(met.select("row", "x", F.col("rep").alias("id")), few), ["x", "row"])
    texts = common.materialize(texts.dropDuplicates(["id"]).select("id", "text"))

    pairs = common.materialize(buckets.filter("rep != a").select("a", F.col("rep").alias("b")).distinct())
    judged = common.materialize(verify(pairs, texts))
    links = judged.filter(F.col("similarity") >= SIMILAR).select("a", "b")
    roots = common.materialize(components(links))
    # what a star left apart: other components in the same bucket, if the bounds allow a link
    at = buckets.join(common.held(roots, few), buckets["rep"] == roots["node"], "left").select("h", "rep", "a", F.coalesce("root", "rep").alias("root"))
    at = common.materialize(at)
    split = at.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("h")
    at = common.materialize(at.join(common.held(split, fewer), "h"))
    sketch = [f"s{i}_" for i in range(SKETCH)]
    words = [F.col("sketch")[i].alias(s) for i, s in enumerate(sketch)]
    apart = reps.select("rep", "bands", "weight", *words).join(common.held(at.select("rep"), fewer), "rep", "left_semi")
    apart = common.materialize(apart)
    texts = common.materialize(texts.join(common.held(apart.select(F.col("rep").alias("id")), few), "id", "left_semi"))
    held, bound = texts, apart.withColumn("most", F.col("weight"))
    for _ in range(2):  # without the texts that can link to none, the others share less
        bound = bound.join(common.held(own_weight(held), few), "rep", "left").withColumn("most", F.col("weight") - F.coalesce("own", F.lit(0))).drop("own")
        bound = common.materialize(bound.filter(F.col("most") >= SIMILAR * F.col("weight") - 1e-9))
        held = texts.join(common.held(bound.select(F.col("rep").alias("id")), few), "id", "left_semi")
    at = at.filter("rep != a").join(common.held(bound, fewer), "rep").join(common.held(judged.withColumnRenamed("b", "rep"), fewer), ["a", "rep"])
    at = common.materialize(at.select("h", "rep", "root", "similarity", "weight", "most", "bands", *sketch))
    other = at.select("h", *[F.col(c).alias(f"{c}2") for c in at.columns[1:]])
    rest = at.join(other, "h").filter((F.col("rep") < F.col("rep2")) & (F.col("root") != F.col("root2")))
    rest = rest.filter(F.abs(F.col("similarity") - F.col("similarity2")) <= 1 - SIMILAR + 1e-9)
    rest = rest.filter(F.least("most", "most2") * (1 + SIMILAR) >= SIMILAR * (F.col("weight") + F.col("weight2")) - 1e-9)
    differ = sum(F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}2"))) for x in sketch)
    once = F.col("h") == F.array_min(F.array_intersect("bands", "bands2"))  # a pair comes up in its first bucket only
    rest = rest.filter(differ <= APART).filter(once)
    rest = common.materialize(rest.select(F.col("rep").alias("a"), F.col("rep2").alias("b")))
    more = rest if rest.isEmpty() else verify(rest, texts).filter(F.col("similarity") >= SIMILAR).select("a", "b")
    for end in ("a", "b"):  # only the classes that the new links join take rounds
        more = more.join(common.held(roots.withColumnRenamed("node", end), few), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = reps.select("rep", "key").join(common.held(roots, few), reps["rep"] == roots["node"], "left").select("key", F.coalesce("root", "rep").alias("root"))
    found = found.join(common.held(top, few), "root", "left").select("key", F.coalesce("top", "root").alias("root"))
    out = signed.select("doc_id", "key").join(found, "key")
    return out, alone, reps.filter(F.col("rep") >= _MADE).isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row per row of docs; class_id is the least id of its class."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out, alone, named = _classes(docs)
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"))
    if named:
        return out.select("doc_id", F.col("root").cast(kind).alias("class_id")).unionByName(alone)
    out = common.materialize(out.drop("key"))
    least = common.materialize(out.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return out.join(least, "root").select("doc_id", "class_id").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs (doc_id, text and more) per class: that of the least id, then text, then the rest of the row."""
    out, _, _ = _classes(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    kept = out.groupBy("root").agg(least.alias("x")).select(F.coalesce(F.col("x.doc_id").cast("long"), F.lit(0)).alias("i"), F.col("x.doc_id").isNull().alias("n"), F.col("x.key").alias("k"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"), F.md5("text").alias("k"))
    some = F.coalesce(F.col("row.text").rlike(common.WORD), F.lit(False))
    best = rows.filter(some).join(kept, ["i", "n", "k"]).groupBy("i", "n", "k").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return best.select("row").unionByName(rows.filter(~some).select("row")).select("row.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
