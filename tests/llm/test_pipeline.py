"""The pipeline's stages against plain versions, with nulls, repeated rows, shared ids and clashing columns."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_dedup import ITEM, WORDS, edit, plain_classes, plain_cut, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark):
    rng = random.Random(21)
    passage, base = prose(rng, 60), prose(rng, 150)
    rows = [(i, prose(rng, 40) + " " + passage + " " + prose(rng, 20), "en", "a", 1) for i in range(6)]
    rows += [(10 + i, edit(rng, base, i % 3), "en", "b", 1) for i in range(6)]
    rows += [(20, prose(rng, 30) + " " + ITEM, "en", "b", 1), (21, prose(rng, 50), "en", None, 1), (None, prose(rng, 45), "en", "a", 1), (None, prose(rng, 46), None, "a", None)]
    rows += [(22, prose(rng, 40), "en", "a", 1), (22, prose(rng, 41), "en", "a", 1), rows[0], (23, "x " * 30_000, "en", "a", 1), (24, None, "en", "a", 1), (25, "", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "mark", "row", "key", "spans", "taken"):
        df = df.withColumn(name, F.lit("clash"))
    return rows, df


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_equal_plain_versions(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline.common, "table", lambda spark, sf, name: bench)
    rows, docs = fixture(spark)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    named = {k: (r[0], r[1]) for k, r in enumerate(sorted({(r[0], r[1]) for r in rows if r[1] and WORDS.findall(r[1])}, key=lambda x: (x[0] is None, x[0] or 0, x[1])))}
    classes = plain_classes([(k, t) for k, (_, t) in named.items()])
    want = [named[k] for k in set(classes.values())] + [(24, None), (25, "")]
    assert texts(kept) == sorted(want, key=str)
    kept = corpus_pipeline.common.materialize(kept)

    cut = stages["substring_dedup"](spark, kept, "")
    assert cut.columns == docs.columns
    gone = {(i, n): k for i, n, k, _ in plain_cut(want)}
    plain = []
    for i, t in want:
        words = WORDS.findall(t or "")
        plain.append((i, len(words) - gone[i, len(words)]))
    assert sorted(((i, len(WORDS.findall(t or ""))) for i, t in texts(cut)), key=str) == sorted(plain, key=str)
    assert {(i, t) for i, t in want if not gone[i, len(WORDS.findall(t or ""))]} <= set(texts(cut))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)
    cut = corpus_pipeline.common.materialize(cut)

    clean = stages["decontamination"](spark, cut, "")
    assert clean.columns == docs.columns and texts(clean) == [x for x in texts(cut) if x[0] != 20]
    clean = corpus_pipeline.common.materialize(clean)

    mixed = stages["mixing"](spark, clean, "").collect()
    sizes = sorted(((i, len(WORDS.findall(t or ""))) for i, t in texts(clean)), key=str)
    assert sorted(((r["doc_id"], r["size"]) for r in mixed), key=str) == sizes
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixed)


def test_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline.common, "table", lambda spark, sf, name: bench)
    _, docs = fixture(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0
