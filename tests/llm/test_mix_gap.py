"""Mixing where a very long document stands at the cut."""

import hashlib
import random

from siltstone.llm import mixing


def walk(rows, want):
    """Ids taken of (id, size): in hash order, all that still fit, then the one that comes closest if it helps."""
    taken, gap = set(), want
    rows = sorted(rows, key=lambda r: hashlib.md5(f":{r[0]}".encode()).hexdigest())
    for i, n in rows:
        if 0 < n <= gap:
            taken.add(i)
            gap -= n
    left = [(abs(gap - n), hashlib.md5(f":{i}".encode()).hexdigest(), i) for i, n in rows if i not in taken and abs(gap - n) < gap]
    return taken | ({min(left)[2]} if left else set())


def test_a_giant_document_at_the_cut_leaves_no_gap(spark):
    rng = random.Random(4)
    for giant in (7, 150, 299):
        rows = [(i, rng.randrange(10, 70)) for i in range(300)]
        # the giant stands at a place in hash order before, around or after the cut
        order = sorted(range(300), key=lambda i: hashlib.md5(f":{i}".encode()).hexdigest())
        rows[order[giant]] = (order[giant], 10_000)
        total = sum(n for _, n in rows)
        want = 0.35 * total
        sized = spark.createDataFrame([(i, "s", hashlib.md5(f":{i}".encode()).hexdigest(), n) for i, n in rows], "doc_id long, pattern string, h string, size long")
        got = mixing.select(sized, spark.createDataFrame([("s", want, total)], "pattern string, words double, size long")).collect()
        assert len(got) == 300 and {r["doc_id"] for r in got if r["taken"]} == walk(rows, want)
        assert all(r["taken"] in (0, r["size"]) for r in got)
        assert abs(sum(r["taken"] for r in got) - want) < 70


def taken_of(rows, want):
    """Words taken of rows (id, size) in hash order, repeated rows one by one."""
    gap, left = want, []
    for i, n in sorted(rows, key=lambda r: (hashlib.md5(f":{r[0]}".encode()).hexdigest(), r)):
        if 0 < n <= gap:
            gap -= n
        else:
            left.append(n)
    return want - gap + (min(left, key=lambda n: abs(gap - n)) if left and min(abs(gap - n) for n in left) < gap else 0)


def test_repeated_rows_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 2)  # equal rows are written out in several parts too
    for rows in ([(1, 8)] * 5 + [(2, 1)] * 4, [(None, 8)] * 5 + [(3, 3)] * 7, [(9, 5)] * 50):
        total = sum(n for _, n in rows)
        df = spark.createDataFrame([(i, " ".join(["w"] * n), "s") for i, n in rows], "doc_id long, text string, source string")
        got = mixing.mix_sources(df).collect()
        assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"]) == sorted((i, n) for i, n in rows if i) and len(got) == len(rows)
        extra = sum(r["taken"] for r in got) - total  # the target is 150 % of the words, so each is taken once at least
        if all(i for i, _ in rows):
            assert extra == taken_of(rows, 0.5 * total)
        assert abs(extra - 0.5 * total) < 8


def test_patterns_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}") for i in range(80)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == want


def test_overlapping_sources_share_by_flow(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b", "a", "b"] if i % 3 == 1 else []) for i in range(90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), weights=(1, 4, 1), total=0.5).collect()
    target = {s["source"]: s["target"] for r in got for s in r["sources"]}
    credit = dict.fromkeys(target, 0.0)
    for r in got:
        for s in r["sources"]:
            credit[s["source"]] += r["taken"] * s["share"]
    assert target == {"a": 75.0, "b": 300.0, None: 75.0}
    assert all(abs(credit[s] - target[s]) <= 10 for s in target) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {tuple(s["source"] for s in r["sources"]) for r in got} == {("a",), ("a", "b"), (None,)}
