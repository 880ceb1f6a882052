"""Top-k search, mixing, WARC and the pipeline: against plain versions, round trips, and the defined cases."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.llm import mixing, topk_search, warc


def plain_top(rows, every, k=5):
    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_all_scores(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, []), (405, [0.0] * 8), (406, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == plain_top(rows, 5)
    assert topk_search.top_k(df.filter("false"), F.col("vec_id") % 5 == 0).count() == 0
    few = topk_search.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert sorted(r["rank"] for r in few.collect()) == [1, 2]


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(0, 20, (5000, 3)))
    vectors[17] = [500, 500, 500]
    lists = topk_search.Lists(np.arange(5000), vectors)
    rows, scores, depth = lists.search(-1, np.array([3.0, 2.0, 1.0]), 1)
    assert rows.tolist() == [17] and scores[0] == 3000 and depth < 5000


def test_topk_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 16)
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 6)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # ties
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()
    cut = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for q in [i for i in cut if i % 10 == 0]:
        want = sorted((-int(cut[q] @ v), i) for i, v in cut.items() if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_topk_of_values_beyond_doubles_that_hold_whole_numbers(spark):
    rng = random.Random(13)
    rows = [(i, [rng.choice([1e300, 1e17, 3e12, 2.0**45, 1.5]) * rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(70, [1e306] * 5)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0).collect()
    cut = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i < 70}
    for q in [i for i in cut if i % 4 == 0]:
        scores = {i: max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(cut[q], v, strict=True)))) for i, v in cut.items() if i != q}
        want = sorted((-s, i) for i, s in scores.items())[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_mix_keeps_sources_with_control_characters(spark):
    rows = [(1, "a b c", "x\u000by"), (2, "a b", 'q"\\'), (3, "c d e", "é\u2028"), (4, "a", "plain"), (5, "b c", "x\u000by")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5] and {r["doc_id"]: r["source_size"] for r in got}[1] == 5


def test_targets_stop_at_twice_their_source():
    assert mixing.targets({"a": 10, "b": 100}, {"a": 5, "b": 2}, 165) == pytest.approx({"a": 20, "b": 145})
    assert mixing.targets({"a": 0, "b": 4}, {"a": 5, "b": 2}, 6) == pytest.approx({"a": 0, "b": 6})


def test_flow_serves_overlapping_sources_at_least_cost():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    taken = mixing.route(patterns, {"a": 100, "b": 60})
    words = lambda routed: {p: sum(x.values()) for p, x in routed.items()}
    assert sum(words(taken).values()) == pytest.approx(160)
    assert words(taken)[("a", "b")] == pytest.approx(50) and words(taken)[("b",)] == pytest.approx(10)  # no repetition is needed
    assert [sum(x.get(s, 0) for x in taken.values()) for s in "ab"] == pytest.approx([100, 60])
    more = mixing.route(patterns, {"a": 100, "b": 110})
    assert sum(words(more).values()) == pytest.approx(210) and all(x <= 2 * patterns[p] + 1e-6 for p, x in words(more).items())


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), rng.choice(["s1", "s2", "s3", None])) for i in range(600)]
    rows += [(900, None, "s1"), (901, "", "empty"), (None, "a b c", "s2"), (None, "a b c", "s2"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    per = {}
    for r in got:
        per.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in per.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= max(3, 0.01 * target)
    assert sum(t for _, t in per) == pytest.approx(1.5 * sum(s for s, _ in per), rel=1e-6)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(df.filter("false")).count() == 0


def folder(spark):
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="warc-")


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "é" * 1000), (4, "http://a/\n4", None), (5, "u", ""), (6, "u", "<p>one</p>"), (None, "n", "<p>one</p>"), (6, "u", "<p>one</p>"), (7, "long", "ab" * 300_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    where = folder(spark)
    got = {(r["page_id"], r["url"]): r for r in warc.load(spark, where, warc.write(pages, where)).collect()}
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    for i, _, html in PAGES:
        r = next(v for (k, _), v in got.items() if k == i)
        assert r["payload_digest"] == digest(html) and r["payload_bytes"] == len((html or "").encode())
    kinds = {k[0]: (v["record_type"], v["refers_to"]) for k, v in got.items()}
    assert kinds[1] == kinds[2] == ("revisit", 6) and kinds[6] == ("response", None) and kinds[None] == ("response", None)
    assert kinds[4] == ("revisit", 5) and kinds[5] == ("response", None)
    assert got[7, "long"]["payload"] == b"ab" * 300_000 and (4, "http://a/%0A4") in got
    empty = warc.write(pages.filter("false"), where)
    assert warc.load(spark, where, empty).count() == 0
    least = {r["page_id"]: r["record_type"] for r in warc.load(spark, where, warc.write(pages.filter("page_id in (1, 2)"), where, least=1000)).collect()}
    assert least == {1: "response", 2: "response"}


def archive(records, dictionary=b" some shared bytes of pages <p></p> "):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return struct.pack("<II", warc.MAGIC, len(dictionary)) + dictionary + b"".join(packer.compress(r) for r in records)


def test_reader_validates():
    good = warc.record(1, "u", b"<p>x</p>", 8, base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode(), None)
    data = archive([good, good])
    assert [r["payload"] for r in warc.read(data)] == [b"<p>x</p>"] * 2
    squeezed = zstandard.ZstdCompressor().compress(b" some shared bytes of pages <p></p> ")
    inner = archive([good])
    assert len(list(warc.read(struct.pack("<II", warc.MAGIC, len(squeezed)) + squeezed + inner[8 + 36 :]))) == 1
    for bad in (data[:-3], data[4:], b"", archive([good[:-2]]), archive([good.replace(b"<p>x", b"<p>y")]), archive([good.replace(b"WARC/1.1", b"WARC/9.9")]), archive([good.replace(b"WARC-Date", b"WARC-Gone")]), data + b"tail"):
        with pytest.raises(warc.InvalidArchive):
            list(warc.read(bad))


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline
    from siltstone.llm import common, near_dedup

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, sf))
        assert after.columns == columns and after.count() <= before
        if name == "near_dedup":
            classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(classes.values())
        docs, before = after, after.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == before and sum(r["taken"] for r in last) > 0
