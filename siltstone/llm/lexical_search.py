"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

`index` deals documents into shards and keeps, for each term of a shard, blocks of BLOCK postings: the documents (as
gaps, packed to the bits of the largest) and their counts (likewise), with the block's last document and its greatest
impact outside.  `search` sends each question to each shard.  There a cursor per term walks its list: cursors are
sorted by their document, and the first whose running sum of greatest list impacts beats the k-th score names the
pivot; block pointers move to the pivot without decompression, and only if the blocks' greatest impacts together beat
the k-th score is anything unpacked.  If they don't, all cursors go past the end of the nearest of those blocks.
Documents are then scored SPAN at a time: all postings of the next SPAN documents, as arrays.  The shards' best are
merged by a ranking window.

Scores are whole numbers (see `impact`), so no bound is rounded.  The index holds the terms that it is asked for, which go
to the workers as a dictionary; questions with more terms than PART_TERMS are answered in batches, each with an index of
its own.  Statistics (documents, words, documents that hold a term) come from all documents.

Defined cases: null texts and texts without a term are not counted and match nothing; a question without terms, or whose
terms occur nowhere, has no rows; rows are documents, so repeated rows take a rank each and share an id; equal scores go
by id, null last; a question's repeated terms count each time; a question row repeated with the same text is answered
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, tiles

K = 20
#: Postings of a block, documents that are scored together.
BLOCK, SPAN = 128, 1024
#: A shard's documents and postings, about.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Terms, and bytes of terms, of one dictionary that goes to the workers (unless one question alone has more).
PART_TERMS, PART_BYTES = 1 << 18, 1 << 24
#: A term is a longest run of letters A-Z, digits and characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_APART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: str) -> Column:
    """The terms of a text, in order, with repeats."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: tf is its count in the document, m the document's length factor."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers packed to the bits of the largest, after a byte that tells how many bits."""
    width = int(values.max(initial=0)).bit_length()
    bits = values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
    return bytes([width]) + np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n * width).reshape(n, width)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64))


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, n, term array, tf array) of docs (row, doc_id, text): n terms in all, counts of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, counts, ends = [], [], [], [0]
            for x in batch.column("text"):
                found: Counter = Counter()
                for piece in common.pieces(x.as_buffer() if x.is_valid else b"", _APART):
                    found.update(map(known.value.get, _TERM_BYTES.findall(piece.lower())))
                n.append(found.total())
                found.pop(None, None)
                ids += found.keys()
                counts += found.values()
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _blocks(rows: pa.Table) -> pa.Table:
    """The posting lists of one shard: for each term its blocks, and under term -1 the documents' ids and length factors."""
    ids = rows.column("doc_id").combine_chunks()
    by_id = np.lexsort((rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    rows = rows.take(pa.array(by_id))
    m = rows.column("m").to_numpy()
    lists = rows.column("terms").combine_chunks()
    doc = np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy())
    term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy()
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    gain = impact(tf, m[doc])
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    out: dict[str, list] = {"term": [-1], "last": [[]], "most": [m.tolist()], "docs": [[]], "tfs": [[]]}
    for a, z in zip(starts, [*starts[1:], len(term)], strict=True):
        cuts = range(a, z, BLOCK)
        out["term"].append(int(term[a]))
        out["last"].append([int(doc[min(c + BLOCK, z) - 1]) for c in cuts])
        out["most"].append(np.maximum.reduceat(gain[a:z], np.arange(0, z - a, BLOCK)).tolist())
        out["docs"].append([pack(np.diff(doc[c : min(c + BLOCK, z)], prepend=doc[c - 1] if c > a else -1) - 1) for c in cuts])
        out["tfs"].append([pack(tf[c : min(c + BLOCK, z)] - 1) for c in cuts])
    id_list = [rows.column("doc_id").to_pylist()] + [[]] * (len(out["term"]) - 1)
    shard = [rows.column("shard")[0].as_py()] * len(out["term"])
    types = {"term": pa.int32(), "last": pa.list_(pa.int32()), "most": pa.list_(pa.int64()), "docs": pa.list_(pa.binary()), "tfs": pa.list_(pa.binary())}
    return pa.table({"shard": pa.array(shard, pa.int32()), "ids": pa.array(id_list, pa.list_(rows.schema.field("doc_id").type)), "n": pa.array([len(m)] + [int(z - a) for a, z in zip(starts, [*starts[1:], len(term)], strict=True)], pa.int32())} | {c: pa.array(x, types[c]) for c, x in out.items()})


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[DataFrame, DataFrame, int, int]:
    """The posting table of docs (doc_id, text) for the terms of a vocabulary (UTF-8, lower case, with numbers from 0 on);
    (term, df) of each; how many documents have a term of any kind, and how many terms they have."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    counted = common.materialize(_counted(rows, vocabulary).filter("n > 0"))
    about = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.sum(F.size("terms")).alias("postings")).first()
    n, words = about["docs"], about["words"] or 0
    df = common.materialize(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    shards = max(1, -(-n // SHARD_DOCS), -(-(about["postings"] or 0) // SHARD_POSTINGS))
    factor = F.lit(75) + F.expr(f"(25 * n * {n}L) div {max(words, 1)}L")
    # equal rows are dealt out too: the row number within a partition is no part of the result, only of the dealing
    shard = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = counted.filter(F.size("terms") > 0).select(shard.alias("shard"), "row", "doc_id", factor.cast("long").alias("m"), "terms", "tfs")
    schema = f"shard int, ids array<{kind}>, n int, term int, last array<int>, most array<long>, docs array<binary>, tfs array<binary>"
    return common.materialize(dealt.groupBy("shard").applyInArrow(_blocks, schema)), df, n, words


class List:
    """One term's blocks. Unpacked blocks are kept: a shard has a bounded number of postings."""

    __slots__ = ("last", "most", "n", "packed", "top", "unpacked")

    def __init__(self, row: dict):
        self.last, self.most, self.packed, self.n = row["last"], row["most"], list(zip(row["docs"], row["tfs"], strict=True)), row["n"]
        self.top, self.unpacked = max(self.most), [None] * len(self.last)

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block i."""
        if self.unpacked[i] is None:
            n = min(BLOCK, self.n - i * BLOCK)
            docs, tfs = self.packed[i]
            at = np.cumsum(unpack(docs, n) + 1) + (self.last[i - 1] if i else -1)
            self.unpacked[i] = at, impact(unpack(tfs, n) + 1, m[at])
        return self.unpacked[i]


class Shard:
    """The lists of one shard."""

    def __init__(self, rows: pa.Table):
        found = {x["term"]: x for x in rows.to_pylist()}
        own = found.pop(-1)
        self.ids, self.m = own["ids"], np.array(own["most"], np.int64)
        self.lists = {term: List(x) for term, x in found.items()}

    def search(self, weights: dict[int, int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best documents with a score above 0, by score, then document; weights by term."""
        lists, scale, at = [], [], []
        for term, weight in weights.items():
            if weight > 0 and term in self.lists:
                lists.append(self.lists[term])
                scale.append(weight)
                at.append(0)  # the least document that may be in the list and is not settled
        tops = [x.top * w for x, w in zip(lists, scale, strict=True)]
        end = len(self.m)
        docs, scores, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        blocks = [0] * len(lists)  # the block that may hold `at`
        order = list(range(len(lists)))
        while order:
            order.sort(key=at.__getitem__)
            total, pivot = 0, -1
            for place, i in enumerate(order):
                total += tops[i]
                if total > bar:
                    pivot = place
                    break
            if pivot < 0:
                break
            doc = at[order[pivot]]
            while pivot + 1 < len(order) and at[order[pivot + 1]] == doc:
                pivot += 1
            # shallow moves: the blocks that may hold the pivot, by their ends alone
            bound, near = 0, end - 1
            for i in order[: pivot + 1]:
                x = lists[i]
                b = blocks[i]
                if x.last[b] < doc:
                    blocks[i] = b = bisect_left(x.last, doc, b + 1)
                if b < len(x.last):
                    bound += x.most[b] * scale[i]
                    near = min(near, x.last[b])
            if pivot + 1 < len(order):
                near = min(near, at[order[pivot + 1]] - 1)
            if bound > bar:
                to = min(end, doc + SPAN)
                docs, scores, bar = self._score(lists, scale, blocks, order, at, doc, to, docs, scores, bar, k)
            else:
                to = near + 1
            moved = []
            for i in order:
                if at[i] < to:
                    x, b = lists[i], blocks[i]
                    if b < len(x.last) and x.last[b] < to:
                        blocks[i] = b = bisect_left(x.last, to, b + 1)
                    if b == len(x.last):
                        continue
                    at[i] = to  # or the next document, where it is known without unpacking
                    if x.unpacked[b] is not None:
                        known = x.unpacked[b][0]
                        at[i] = int(known[np.searchsorted(known, to)])
                moved.append(i)
            order = moved
        best = np.lexsort((docs, -scores))[:k]
        return docs[best], scores[best]

    def _score(self, lists, scale, blocks, order, at, first, to, docs, scores, bar, k):
        """Score all documents from first up to `to`, and keep the k best."""
        total = np.zeros(to - first, np.int64)
        for i in order:
            if at[i] >= to:
                break
            x, b = lists[i], blocks[i]
            if b < len(x.last) and x.last[b] < first:
                b = bisect_left(x.last, first, b + 1)
            while b < len(x.last):
                found, gains = x.block(b, self.m)
                a, z = np.searchsorted(found, (first, to))
                total[found[a:z] - first] += gains[a:z] * scale[i]
                if x.last[b] >= to - 1:
                    break
                b += 1
        fresh = np.flatnonzero(total > bar)
        docs, scores = np.concatenate([docs, fresh + first]), np.concatenate([scores, total[fresh]])
        if len(docs) >= k:
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            bar = int(scores[-1])  # later documents have greater ids, so they must beat it
        return docs, scores, bar


def _reply(id_type: pa.DataType, k: int):
    def reply(shard: Shard, asked: pa.Table) -> pa.Table:
        q, ids, scores = [], [], []
        for x in asked.to_pylist():
            docs, found = shard.search({w["term"]: w["weight"] for w in x["weights"]}, k)
            q += [x["q"]] * len(docs)
            ids += [shard.ids[d] for d in docs]
            scores += found.tolist()
        return pa.table({"q": pa.array(q, pa.int64()), "doc_id": pa.array(ids, id_type), "score": pa.array(scores, pa.int64())})

    return reply


def search(docs: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each of questions (item_id, text)."""
    docs = docs.select("doc_id", "text")
    items = questions.select("item_id", "text").dropDuplicates().withColumn("q", F.xxhash64("item_id", "text"))
    asked = items.select("q", F.explode(terms("text")).alias("word")).groupBy("q", "word").agg(F.count("*").alias("n"))
    asked = common.materialize(asked)
    about = asked.select("word").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    batches = 1
    if about["n"] > PART_TERMS or about["bytes"] > PART_BYTES:
        about = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
        batches = max(-(-about["n"] // PART_TERMS), -(-about["bytes"] // PART_BYTES))
    found = None
    for i in range(batches):
        some = _batch(docs, asked.filter(F.pmod("q", F.lit(batches)) == i), k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _batch(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score): the k best of each shard for asked (q, word, n)."""
    spark = docs.sparkSession
    words = sorted(r["word"] for r in asked.select("word").distinct().collect())
    rows, df, n, _ = index(docs, {w.encode(): i for i, w in enumerate(words)})
    numbers = spark.createDataFrame(list(enumerate(words)), "term int, word string")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("n")
    weights = asked.join(numbers, "word").join(df, "term").withColumn("weight", weight).filter("weight > 0")
    asked = weights.groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("weights"))
    shards = rows.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0]
    field = docs.schema["doc_id"]
    id_type = to_arrow_type(field.dataType)
    return tiles.answer(rows, tiles.to_all(asked, shards), Shard, _reply(id_type, k), f"q long, doc_id {field.dataType.simpleString()}, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM d),
m AS (SELECT r, doc_id, 75 + (25 * n * n_docs) // l AS m FROM d, s),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*) AS c FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, p.r, m.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON p.r = m.r GROUP BY item_id, p.r, m.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20
"""
