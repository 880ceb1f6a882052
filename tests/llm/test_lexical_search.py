"""Ranked lexical search: against plain scores of all documents, packing, skipping, and the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import lexical_search


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in counted:
            m = 75 + (25 * c.total() * n_docs) // words
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_equals_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 150)
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    monkeypatch.setattr(lexical_search, "SPAN", 16)
    rng = random.Random(7)
    vocab = ["t%d" % i for i in range(200)] + ["Ähre", "ährE", "日本語", "x" * 200]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: rng.choice([" ", "--", "\n"]).join(rng.choices(vocab, weight, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, "... !?"), (None, "t5 t5 t6"), (None, "t5 t5 t6"), (3, docs[3][1]), (4, "Another TEXT t7 under one id"), (700, text(5000))]
    docs += [(800 + i, docs[9][1]) for i in range(40)]  # ties
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "t0 t0 T0 t150"), (93, "t1"), (None, "t5 T6 t5"), (5, "t2"), (94, docs[9][1])]
    items.append(items[0])
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("q", F.lit(1))
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = plain(docs, items, 7)
    got = sorted((tuple(r) for r in lexical_search.search(docs_df, items_df, 7).collect()), key=repr)
    assert got == want and len(got) > 150
    monkeypatch.setattr(lexical_search, "PART_TERMS", 40)  # questions in batches
    assert sorted((tuple(r) for r in lexical_search.search(docs_df, items_df, 7).collect()), key=repr) == want
    assert lexical_search.search(docs_df.filter("false"), items_df).count() == 0
    assert lexical_search.search(docs_df, items_df.filter("false")).count() == 0


def test_packed_blocks():
    rng = np.random.default_rng(1)
    for values in ([0], [0] * 128, [5], [2**40, 0, 1], rng.integers(0, 1000, 128)):
        values = np.array(values, np.int64)
        assert lexical_search.unpack(lexical_search.pack(values), len(values)).tolist() == values.tolist()
    assert len(lexical_search.pack(np.full(128, 7))) == 1 + 128 * 3 // 8


def test_blocks_below_the_bar_stay_packed():
    n = 20000
    rng = np.random.default_rng(2)
    tfs = rng.integers(1, 4, n)
    tfs[100:120] = 50  # early documents that nothing later beats
    rows = pa.table({"shard": pa.array([0] * n, pa.int32()), "row": np.arange(n), "doc_id": np.arange(n), "m": np.full(n, 100), "terms": pa.array([[0]] * n, pa.list_(pa.int32())), "tfs": pa.array([[int(x)] for x in tfs], pa.list_(pa.int64()))})
    shard = lexical_search.Shard(lexical_search._blocks(rows))
    docs, scores = shard.search({0: 3}, 20)
    assert docs.tolist() == list(range(100, 120)) and set(scores.tolist()) == {3 * (50 * 10**9 // (50000 + 1200))}
    unpacked = [x is not None for x in shard.lists[0].unpacked]
    assert sum(unpacked) <= lexical_search.SPAN // lexical_search.BLOCK + 1 < len(unpacked) / 10
