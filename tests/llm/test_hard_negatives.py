"""Hard negatives: against plain scores, pruning by norm, exact large values, and the defined cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import hard_negatives, tiles


def plain(rows, every):
    clamp = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(256.0 * x) for x in v):
            continue
        sound.append((i, [math.floor(256.0 * x) for x in v], label))
    out = []
    for own, a, label in {(i, tuple(v), lab) for i, v, lab in sound if i % every == 0}:
        scored = [(clamp(sum(x * y for x, y in zip(a, v, strict=False))), i, lab) for i, v, lab in sound if i != own]
        for p, pid, _ in sorted((x for x in scored if x[2] == label), key=lambda x: (-x[0], x[1]))[:5]:
            fits = sorted((-s, i) for s, i, lab in scored if lab != label and 30 * p <= 100 * s <= 90 * p)[:10]
            out += [(own, pid, n + 1, i, p, -s) for n, (s, i) in enumerate(fits)]
    return sorted(out)


def test_equals_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rng = random.Random(4)
    rows = []
    for i in range(400):  # norms over several orders of size, and directions that score high
        length = 10 ** rng.uniform(-2, 2)
        rows.append((i, [length * (0.3 + rng.gauss(0, 0.5)) for _ in range(6)], rng.randrange(3)))
    rows += [(500 + i, rows[7][1], i % 3) for i in range(30)]  # ties
    rows += [(20, rows[20][1], rows[20][2]), (21, rows[21][1], rows[21][2])]  # repeated rows
    rows += [(600, None, 1), (620, [None] * 6, 1), (640, [float("nan")] * 6, 1), (660, [float("inf")] + [0.0] * 5, 1), (680, [1e306] * 6, 1), (700, [], 1), (720, [0.0] * 6, 2), (740, [1.0, 2.0], 2), (None, [1.0] * 6, 0), (760, [1.0] * 6, None), (780, [1.0] * 6, 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("clash")).withColumn("norm", F.lit(1))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    assert got == plain(rows, 20) and len(got) > 300
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_values_beyond_doubles_that_hold_whole_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e17, 1e300, 3e12, 1.5, -2e13]) * rng.random() for _ in range(4)], i % 2) for i in range(40)]
    rows += [(100 + i, [float(2**30) * rng.random() for _ in range(4)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == plain(rows, 10)
    a = np.array([[2.0**60, -1.0], [3.0, 5.0]])
    assert tiles.inner(a, a).tolist() == [[2**63 - 1, 3 * 2**60 - 5], [3 * 2**60 - 5, 34]]


def test_blocks_are_pruned_by_norm():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    v = np.floor(rng.normal(0, 1, (8192, 4)) * np.geomspace(5000, 5, 8192)[:, None])
    rows = pa.table({"vec_id": np.arange(8192), "label": np.ones(8192, np.int32), "norm": np.linalg.norm(v, axis=1), "v": pa.array(v.tolist())})
    shard = hard_negatives.Shard(rows)
    q = np.array([100.0, 50, 25, 10])
    found = shard.search([{"vec_id": -1, "label": 1, "norm": float(np.linalg.norm(q)), "scores": [None]}], q[None], True, 5)
    want = sorted(((-int(x @ q), i) for i, x in enumerate(v)))[:5]
    assert [(-int(s), int(shard.ids[i])) for i, s in zip(found[0][2], found[0][3], strict=True)] == want
    assert shard.read < 8192 / hard_negatives.BLOCK_ROWS
