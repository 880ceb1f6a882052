"""Substring deduplication: remove every word inside a window of 35 words that occurs elsewhere too.

Each window is owned by its anchor, the least hash among its runs of five words (the leftmost of equal
ones), so equal windows have equal anchors.  The windows that share an anchor in a text make up one
passage of at most 65 words.  Passages are dealt out to shards by anchor: equal windows meet in one
shard, no window is in two passages, and a shard is bounded in words.  Equal passages are counted, not
repeated, and anchors that occur once are dropped before any words move.  Each shard builds a compressed
FM-index (fm_index.py) and streams the documents' passages against it: backward search gives matching
statistics, and stretches whose windows occur twice or more are reported.

An anchor with more than HOT_WORDS words of passages would fill a shard by itself; its windows are dealt
out one by one, by the hash of the window, and equal ones are counted first.  Rows of the heaviest anchors
(HEAVY at most, so they can be broadcast) are dealt out by salt in every join by anchor.

Defined cases: a null text has no words; texts shorter than a window keep all words; repeated rows repeat
each other's windows; rows are told apart by id and text, so two texts under one id (or under a null id)
are two documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fm_index import repeated_windows

WINDOW = 35
ANCHOR = 5
SHARD_WORDS = 1 << 19
HOT_WORDS = 1 << 16
#: Anchors with more than one HEAVY-th of all passages are dealt out to so many tasks.
HEAVY, SALTS = 1024, 128
#: Passages or windows in a batch of contents.
CONTENTS = 1 << 13


def _passages(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first word in the text, words, hash) of each passage, and the words' hashes and bounds."""
    _, _, hashes, first = common.words(data, offsets)
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5 + (hashes, first)
    grams = common.grams(hashes, ANCHOR)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, window - ANCHOR + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n], least[wide - span : wide - span + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[window - 1 :])  # windows within one text
    if not len(at):
        return (np.zeros(0, np.int64),) * 5 + (hashes, first)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    begin = at[fresh]
    end = np.append(at[np.flatnonzero(fresh)[1:] - 1], at[-1]) + window
    up, down = common._power(len(hashes) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) * up[:-1])])
    whole = common.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return text[begin], grams[anchor[begin]], begin - first[text[begin]], end - begin, whole, hashes, first


def _list_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
        for a, z, data, offsets in common.text_slices(batch.column("text")):
            text, anchor, start, size, whole, _, _ = _passages(data, offsets, WINDOW)
            columns = [anchor.astype(np.int64), whole.astype(np.int64), ids[a:z][text], marks[a:z][text], (start << 16) | size]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "passage", "id", "mark", "place"])


def _listed(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each entry of a column of lists of structs, and the entries' fields."""
    flat = pc.list_flatten(lists)
    return pc.list_parent_indices(lists).to_numpy(), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of wanted passages; of hot ones, the words of each window, under the window's hash."""
    names = ["route", "anchor", "passage", "skip", "n", "words", "hot"]
    for batch in batches:
        row, wanted = _listed(batch.column("wanted"))
        for a, z, data, offsets in common.text_slices(batch.column("text")):
            _, _, hashes, first = common.words(data, offsets)
            p, q = np.searchsorted(row, [a, z])
            own = {k: v[p:q] for k, v in wanted.items()}
            hot, place = own["hot"].astype(bool), own["place"]
            start, size = first[row[p:q] - a] + (place >> 16), place & 0xFFFF
            for part in (False, True):
                at = np.flatnonzero(hot == part)
                windows = np.maximum(size[at] - WINDOW + 1, 0) if part else np.ones(len(at), np.int64)
                of = np.repeat(at, windows)
                skip = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                for i in range(0, len(of), CONTENTS):
                    some, by = of[i : i + CONTENTS], skip[i : i + CONTENTS]
                    length = np.full(len(some), WINDOW) if part else size[some]
                    ends = np.concatenate([[0], np.cumsum(length)])
                    words = hashes[np.repeat(start[some] + by - ends[:-1], length) + np.arange(ends[-1])]
                    route = common.grams(words, WINDOW)[ends[:-1]].astype(np.int64) if part else own["anchor"][some]
                    held = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(words)])
                    columns = [route, own["anchor"][some], own["passage"][some], by, own["n"][some]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], held, pa.array(np.full(len(some), part))], names=names)


def _search(shard: pa.Table) -> pa.Table:
    words = shard.column("words").combine_chunks()
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(words.buffers()[2] or b"", np.uint64, count=int(ends[-1] - ends[0]) // 8, offset=int(ends[0]))
    which, first, past = repeated_windows(flat, (ends - ends[0]).astype(np.int64) // 8, shard.column("n").to_numpy() > 1, WINDOW)
    return pa.table({"route": shard.column("route").take(pa.array(which)), "passage": shard.column("passage").take(pa.array(which)), "first": pa.array(first), "past": pa.array(past)})


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, mark, spans): stretches of words (first, past) that windows occurring twice or more cover, of texts
    (id, mark, text): two rows of one id and mark hold the same text."""
    common.bound_batches(texts.sparkSession)
    texts = texts.filter("text is not null")
    size = F.col("place").bitwiseAND(0xFFFF)
    listed = common.materialize(texts.mapInArrow(_list_passages, "anchor long, passage long, id long, mark long, place long"))
    repeated = common.materialize(listed.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(size).alias("words")).filter("n > 1"))
    heavy = F.broadcast(repeated.filter(F.col("n") > listed.count() // HEAVY).select("anchor", F.lit(SALTS).alias("salts")))
    salted = lambda df: df.join(heavy, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    hot = salted(repeated).select("anchor", (F.col("words") > HOT_WORDS).alias("hot"), every)
    dealt = salted(listed).withColumn("salt", F.pmod(F.xxhash64("id", "mark", "place"), "salts")).drop("salts")
    listed = common.materialize(dealt.join(hot, ["anchor", "salt"]))
    passages = listed.groupBy("anchor", "passage").agg(F.count("*").alias("n"), F.bool_or("hot").alias("hot"), F.min(F.struct("id", "mark", "place")).alias("at"))
    wanted = common.materialize(passages.select("anchor", "passage", "n", "hot", "at.*"))
    shards = int((wanted.agg(F.sum(size)).first()[0] or 0) // SHARD_WORDS) + 1
    wanted = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "passage", "n", "place", "hot")).alias("wanted"))
    contents = texts.dropDuplicates(["id", "mark"]).join(wanted, ["id", "mark"]).select("text", "wanted")
    contents = common.materialize(contents.mapInArrow(_contents, "route long, anchor long, passage long, skip long, n long, words binary, hot boolean"))
    windows = contents.filter("hot").groupBy("route").agg(F.sum("n").alias("n"), F.min("words").alias("words")).withColumn("passage", F.lit(0).cast("long"))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    routed = contents.filter("not hot").select("route", "passage", "n", "words", shard).unionByName(windows.select("route", "passage", "n", "words", shard))
    found = common.materialize(routed.groupBy("shard").applyInArrow(_search, "route long, passage long, first long, past long"))
    cold = contents.filter("not hot").select(F.col("route").alias("anchor"), "passage").join(found.withColumnRenamed("route", "anchor"), ["anchor", "passage"])
    warm = contents.filter("hot").select("route", "anchor", "passage", "skip").join(found.drop("passage"), "route")
    spans = cold.unionByName(warm.select("anchor", "passage", (F.col("first") + F.col("skip")).alias("first"), (F.col("past") + F.col("skip")).alias("past")))
    spans = common.materialize(spans.groupBy("anchor", "passage").agg(F.collect_set(F.struct("first", "past")).alias("spans")))
    spans = salted(spans).select("anchor", "passage", "spans", every)
    start = F.shiftright("place", 16)
    shift = F.transform("spans", lambda x: F.struct((x["first"] + start).alias("first"), (x["past"] + start).alias("past")))
    own = listed.join(spans, ["anchor", "passage", "salt"]).select("id", "mark", shift.alias("spans"))
    return common.materialize(own.groupBy("id", "mark").agg(F.flatten(F.collect_set("spans")).alias("spans")))  # a set: repeated rows add nothing


def _keep(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """n_words and n_removed of each row, the bytes of the kept texts, and where each of these starts (one more at the end)."""
    row, spans = _listed(batch.column("spans"))
    for a, z, data, offsets in common.text_slices(batch.column("text")):
        first, past, _, bounds = common.words(data, offsets)
        n = np.diff(bounds)
        p, q = np.searchsorted(row, [a, z])
        text = row[p:q] - a
        change = np.zeros(len(first) + 1, np.int64)
        for name, by in (("first", 1), ("past", -1)):
            change += by * np.bincount(bounds[text] + np.minimum(spans[name][p:q], n[text]), minlength=len(change))
        keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        text = np.searchsorted(bounds, keep, "right") - 1
        inner = np.append(text[1:] == text[:-1], False)[: len(keep)]  # a kept word follows in this text, after the byte that becomes a space
        edge = np.zeros(len(data) + 1, np.int8)
        edge[first[keep]] += 1
        edge[past[keep] + inner] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        spaced = data.copy()
        spaced[past[keep[inner]]] = 0x20
        yield n, n - np.bincount(text, minlength=z - a), spaced[inside], np.concatenate([[0], np.cumsum(inside)])[offsets]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the kept text of each row."""
    for batch in batches:
        words, removed, kept = [], [], []
        for n, gone, data, at in _keep(batch):
            words.append(n), removed.append(gone)
            kept.append(pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]))
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, removed)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), *columns, pa.chunked_array(kept, pa.string()).combine_chunks()], names=["id", "doc_id", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, removed, digest = [], [], []
        for n, gone, data, at in _keep(batch):
            words.append(n), removed.append(gone)
            digest += [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, removed)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text", *common.row_id("doc_id", "text"))
    return texts.join(repeated_spans(texts.drop("doc_id")), ["id", "mark"], "left").select("id", "doc_id", "text", "spans")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by one space, a row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs).mapInArrow(_cut, f"id long, doc_id {kind}, n_words long, n_removed long, kept string").drop("id")


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from `text`; a text that loses nothing stays as it is, null included."""
    rest = [c for c in docs.columns if c != "text"]
    # the row travels beside its text in one struct, so that no column's name can clash
    rows = docs.select(*common.row_id("doc_id", "text"), "text", F.struct(*rest).alias("rest"))
    rows = rows.join(repeated_spans(rows.drop("rest")), ["id", "mark"], "left")
    kind = rows.schema["rest"].dataType.simpleString()
    same, cut = rows.filter("spans is null").select("text", "rest"), rows.filter("spans is not null")
    cut = cut.select("id", F.col("rest").alias("doc_id"), "text", "spans").mapInArrow(_cut, f"id long, doc_id {kind}, n_words long, n_removed long, kept string").select(F.col("kept").alias("text"), F.col("doc_id").alias("rest"))
    return same.unionByName(cut).select("rest.*", "text").select(*docs.columns)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return _with_spans(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
e AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, words[i] AS word,
             CASE WHEN i + 34 <= len(words) THEN md5(array_to_string(words[i:i + 34], ' ')) END AS window_md5 FROM e),
c AS (SELECT *, CASE WHEN window_md5 IS NOT NULL AND count(*) OVER (PARTITION BY window_md5) > 1 THEN 1 ELSE 0 END AS again FROM g),
k AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""
