"""Sweeps over line ranges and the ordered budget, against plain loops."""

import random

from siltstone.operators import budget, intervals


def test_inside_met_and_common(spark):
    rng = random.Random(1)
    ranges = lambda n: [(k, s, s + rng.randrange(-1, 9)) for k, s in ((rng.choice("ab"), rng.randrange(0, 60)) for _ in range(n))]
    rows, cover = ranges(80) + [("c", 1, 5), ("a", None, 3)], ranges(25) + [("a", 3, None)]
    schema = "path string, start_line int, end_line int"
    sound = lambda x: x[1] is not None and x[2] is not None and 1 <= x[1] <= x[2]
    held = [c for c in cover if sound(c)]
    want = sorted((str(r), sound(r) and any(c[0] == r[0] and c[1] <= r[1] and c[2] >= r[2] for c in held), sound(r) and any(c[0] == r[0] and c[1] <= r[2] and c[2] >= r[1] for c in held)) for r in rows)
    got = intervals.inside(spark.createDataFrame(rows, schema), spark.createDataFrame(cover, schema), "path").collect()
    assert sorted((str((r["path"], r["start_line"], r["end_line"])), r["inside"], r["met"]) for r in got) == want
    lines = lambda xs: {(x[0], n) for x in xs if sound(x) for n in range(x[1], x[2] + 1)}
    both = lines(rows) & lines(cover)
    found = [tuple(r) for r in intervals.common(spark.createDataFrame(rows, schema), spark.createDataFrame(cover, schema), "path").collect()]
    assert lines(found) == both and sum(e - s + 1 for _, s, e in found) == len(both)
    assert all((p, s - 1) not in both and (p, e + 1) not in both for p, s, e in found)


def test_precision_and_recall(spark):
    files = spark.createDataFrame([(p, [f"line {i} of {p}" for i in range(1, 11)]) for p in "abc"], "path string, lines array<string>")
    span = "task_id int, path string, start_line int, end_line int"
    selected = spark.createDataFrame([(1, "a", 1, 4), (1, "a", 3, 6), (1, "b", 2, 3), (1, "c", 1, 1), (2, "c", 1, 2)], span)
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "task_id int, path string")
    spans = spark.createDataFrame([(1, "a", 5, 8), (1, "a", 2, 2), (1, "c", 1, 1)], span)
    size = lambda p, s, e: len("\n".join(f"line {i} of {p}" for i in range(s, e + 1)).replace("\n", ""))
    cost = lambda p, s, e: -(-size(p, s, e) // 3) + (e - s) + 1
    got = {r["task_id"]: r for r in intervals.token_precision(selected, gold, spans, files).collect()}
    content, relevant = cost("a", 1, 6) + cost("b", 2, 3) + cost("c", 1, 1), cost("a", 5, 6) + cost("a", 2, 2) + cost("b", 2, 3)
    assert (got[1]["content_tokens"], got[1]["relevant_tokens"]) == (content, relevant)
    assert got[1]["precision"] == round(relevant / content, 6) and got[2]["precision"] == 0 and got[2]["noise"] == 1
    asked = spark.createDataFrame([(1, "a", None, None, "REQUIRED"), (1, "a", 2, 6, "SUPPORTING"), (1, "a", 5, 7, "REQUIRED"), (1, "b", 2, 3, "SUPPORTING"), (3, "a", None, None, "SUPPORTING")], span + ", importance string")
    assert {tuple(r) for r in intervals.gold_recall(asked, selected).collect()} == {(1, round(4 / 6, 6), 0.5), (3, 0.0, None)}


def plain_budget(rows, most_files, most_bytes):
    out, state = [], {}
    for task, path, turn, size in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0, r[1])):
        n, spent = state.get(task, (0, 0))
        fits = n < most_files and spent + (size or 0) <= most_bytes
        if fits:
            state[task] = (n + 1, spent + (size or 0))
        out.append((task, path, fits))
    return sorted(out)


def test_budget_passes_over_what_does_not_fit(spark):
    rng = random.Random(2)
    rows = [(t, f"f{i:04}", rng.choice([None, None, 1, 2]), rng.choice([0, 1, 5, 50, 400])) for t in range(3) for i in range(300)] + [(9, "only", None, 10**6), (8, "null", None, None)]
    df = spark.createDataFrame(rows, "task_id int, path string, turn int, size long")
    for most_files, most_bytes in ((20, 3000), (1000, 3000), (7, 10**9), (0, 10), (10, 0)):
        got = sorted((r["task_id"], r["path"], r["taken"]) for r in budget.within(df, most_files, most_bytes).collect())
        assert got == plain_budget(rows, most_files, most_bytes), (most_files, most_bytes)
    assert budget.within(df.filter("false")).count() == 0
