"""SimHash near-duplicates: fingerprints of word shingles, linked by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it.  Fingerprints at
Hamming distance `radius` or less are linked, and classes are the components of the links.

Covering tables: every bit position is given a non-zero vector of radius + 1 bits, all vectors about equally
often.  Each non-zero vector v of radius + 1 bits makes a table whose mask keeps the positions that have an
odd inner product with v.  At most `radius` differing positions span less than the whole space, so some v is
orthogonal to all of them: its mask leaves every difference out, and the pair shares that table's key.  For
radius 2 that is seven tables with 36 or 37 bits each, and no pair is missed, whatever the fingerprints are.

Inside a bucket nothing is compared with everything.  Fingerprints are distinct there (copies count once), and
each is compared with the bucket's least.  Only buckets that this leaves in several parts go on: two fingerprints
lie within `radius`, which is even, exactly if some key lies within radius / 2 of both, so each fingerprint names
all keys that close to it in the bits which the mask left out; those that name a key are linked to the least one.
That costs a fixed number of rows per fingerprint (28 or 29 for radius 2), however large the bucket.

Defined cases: null texts and texts without a word have fingerprint zero and are linked like any other; a text
of fewer words than a shingle is one shingle; rows are documents of their own, so rows that share an id or have
none belong to the component of their text; a component is named by its least id (null if it has none); an
empty table gives an empty result; other columns are ignored, whatever their names.  Texts are walked piece by
piece, so that memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 3
RADIUS = 2
BITS = 64
SEED = 42


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes as a signed 64-bit integer; only A-Z are lower-cased."""
    votes, n, tail = np.zeros(BITS, np.int64), 0, []
    hashed = lambda runs: np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)], np.uint64)
    for piece in common.pieces(text, common.SPACE):
        words = tail + piece.lower().split()
        hashes = hashed(zip(*[words[i:] for i in range(shingle)], strict=False))
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n, tail = n + len(hashes), words[max(0, len(words) - shingle + 1) :]
    if not n and tail:
        votes, n = np.unpackbits(hashed([tail]).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text)."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer() if x.is_valid else b"", shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the covering tables: bit positions that have an odd inner product with the table's vector."""
    vectors = range(1, 1 << (radius + 1))
    own = [vectors[i % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(own) if (x & v).bit_count() % 2) for v in vectors]


def _long(x: int) -> Column:
    return F.lit(x - (1 << BITS) if x >> (BITS - 1) else x).cast("long")


def _near(x: Column, y: Column, radius: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= radius


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints (fp): enough pairs within radius to connect all that are linked."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    tables = masks(radius)
    key = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for t, m in enumerate(tables)]))
    rows = distinct.select("fp", key.alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a != z")
    rows = common.materialize(rows.join(shared.drop("z"), ["t", "key"]))
    direct = rows.filter((F.col("fp") != F.col("a")) & _near(F.col("fp"), F.col("a"), radius)).select("a", F.col("fp").alias("b"))
    split = rows.groupBy("t", "key").agg(F.min(_near(F.col("fp"), F.col("a"), radius)).alias("whole")).filter(~F.col("whole"))
    # keys within half the radius, as differences in the bits that a table's mask leaves out
    flips = []
    for m in tables:
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        flips.append([sum(c) for n in range(radius // 2 + 1) for c in combinations(free, n)])
    around = F.element_at(F.array(*[F.array(*[_long(x) for x in xs]) for xs in flips]), F.col("t") + 1)
    rest = rows.join(split.select("t", "key"), ["t", "key"]).select("t", "fp", F.explode(around).alias("flip"))
    rest = common.materialize(rest.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")))
    least = rest.groupBy("t", "near").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a != z")
    apart = rest.join(least.drop("z"), ["t", "near"]).filter("fp != a").select("a", F.col("fp").alias("b"))
    return direct.unionByName(apart).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of docs; fingerprint in 16 hexadecimal digits."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = common.materialize(fingerprints(docs, shingle))
    least = common.materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = common.materialize(components(links(least.select("fp"), radius)))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.materialize(named)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(names, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(found, "fp").select("doc_id", digits, "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
