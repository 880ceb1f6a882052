"""Tree hashes, capsule histories, failure attribution."""

import datetime

from siltstone.operators import evaluate, hash_tree
from siltstone.sources import store


def test_a_changed_file_alters_its_folders_only(spark):
    files = [("a/b/x", "1"), ("a/b/y", "2"), ("a/z", "3"), ("c/w", "4"), ("top", "5")]
    tree = lambda rows: {r["path"]: (r["depth"], r["files"], r["hash"]) for r in hash_tree.folders(spark.createDataFrame(rows, "path string, hash string")).collect()}
    before, again = tree(files), tree(files[::-1] + [("a/z", "9"), ("n", None)])
    assert before == again and {p: v[:2] for p, v in before.items()} == {"": (0, 5), "a": (1, 3), "a/b": (2, 2), "c": (1, 1)}
    after = tree([("a/b/x", "other")] + files[1:])
    assert {p for p in before if before[p][2] != after[p][2]} == {"", "a", "a/b"}
    renamed = tree([("a/b/v", "1")] + files[1:])
    assert {p for p in before if before[p][2] != renamed[p][2]} == {"", "a", "a/b"} and tree([]) == {}


def test_history_is_saved_once_and_within_its_caps(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [("a", day(1), "x" * 10), ("b", day(2), "x" * 50), ("a", day(3), "x" * 10), ("c", day(3), "x" * 30), ("d", day(4), "x" * 500), ("e", day(5), "x" * 5), ("k", day(1), "x")]
    new = spark.createDataFrame(rows, "id string, saved_at timestamp, body string")
    history = spark.createDataFrame([("k", day(1), 10), ("l", day(2), 20)], "id string, saved_at timestamp, bytes long")
    run = lambda h, **caps: sorted((r["id"], r["outcome"]) for r in store.save(h, new, **caps).collect())
    assert run(history, most_entries=5, most_bytes=85, most_each=100) == [("a", "KNOWN"), ("a", "SAVED"), ("b", "FULL"), ("c", "SAVED"), ("d", "TOO_LARGE"), ("e", "SAVED"), ("k", "KNOWN")]
    assert run(history, most_entries=3)[1] == ("a", "SAVED") and ("b", "FULL") in run(history, most_entries=3)
    saved = store.save(history, new).filter("outcome = 'SAVED'").select("id", "saved_at", "bytes")
    later = history.unionByName(saved)
    assert {o for _, o in run(later)} == {"KNOWN"}  # again: nothing is added
    assert [r["id"] for r in store.prune(later, 3).collect()] == ["e", "d", "c"]
    assert sorted(r["id"] for r in store.prune(later, 3, 100).collect()) == ["b", "c", "e"] and store.prune(later, 0).count() == 0
    assert tuple(store.stats(later).first()) == (7, 10 + 20 + 10 + 50 + 30 + 500 + 5)


def test_failures_are_attributed(spark):
    gold = spark.createDataFrame([(1, "a", "REQUIRED"), (1, "b", "REQUIRED"), (2, "a", "REQUIRED"), (3, "a", "REQUIRED"), (4, "a", "SUPPORTING")], "task_id int, path string, importance string")
    ranked = spark.createDataFrame([(1, "a", 3), (1, "b", 21), (2, "a", 20), (3, "a", 1)], "task_id int, path string, rank int")
    selected = spark.createDataFrame([(3, "a")], "task_id int, path string")
    tasks = spark.createDataFrame([(1, "COMPLETE", False, ["go"]), (2, "NO_CONTEXT", None, ["python"]), (3, "NO_CONTEXT", True, ["go"]), (4, "COMPLETE", False, None), (5, "COMPLETE", False, [])], "task_id int, status string, whole_file_left_out boolean, languages array<string>")
    found = evaluate.attribution(tasks, gold, ranked, selected)
    assert {r["task_id"]: (r["outcome"], r["primary_cause"], r["causes"]) for r in found.collect()} == {
        1: ("FAILURE", "RETRIEVAL_MISS", ["PACKING_DROP", "RETRIEVAL_MISS", "UNSUPPORTED"]), 2: ("WEAKNESS", "BUDGET_LIMIT", ["BUDGET_LIMIT", "PACKING_DROP"]),
        3: ("SUCCESS", "NO_PRIMARY_FAILURE", []), 4: ("SUCCESS", "NO_PRIMARY_FAILURE", []), 5: ("SUCCESS", "NO_PRIMARY_FAILURE", []),
    }
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "task_id int, group string")
    assert {tuple(r) for r in evaluate.failure_matrix(found, groups).collect()} == {("x", "RETRIEVAL_MISS", 1, 0.5), ("x", "BUDGET_LIMIT", 1, 0.5), ("y", "NO_PRIMARY_FAILURE", 1, 1.0)}
    assert all(r["violations"] == 0 for r in evaluate.matrix_violations(found, tasks.select("task_id")).collect())
    broken = found.filter("task_id != 5").unionByName(found.filter("task_id = 1"))
    assert {r["check"] for r in evaluate.matrix_violations(broken, tasks.select("task_id")).filter("violations > 0").collect()} == {"task_not_classified", "task_classified_twice"}
