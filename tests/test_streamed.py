"""Tasks meet files as these stream by: the same results as with all pairs, and what grows as tasks times files is not moved."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence as E
from siltstone.operators import ranges, scoring, streamed
from siltstone.operators import signals as S
from siltstone.plans import queries as plans
from siltstone.plans import search

FILES = "path string, text string, category string"


def _moved(spark) -> int:
    """Rows written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def alike(spark):
    """120 tasks and 200 files that share their words: 24,000 pairs."""
    tasks = spark.createDataFrame([(i, f"alpha beta gamma x{i}") for i in range(120)], "task_id long, text string")
    files = spark.createDataFrame([(f"src/alpha/f{i}.ts", f"alpha beta gamma {'alpha ' * (i % 4)}", "source") for i in range(200)], FILES)
    return tasks, files.repartition(4)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["Ab.c", "HTTP_404", "dE_f", "ab/c", "漢字", "'a b'", '"Ab"', "Ab", "ab", "true"]
    tasks = [(i, " ".join(rng.choices(words, k=rng.choice([3, 12, 80])))) for i in range(12)]
    files = [(f"{rng.choice(words[:60])}/{i}.ts", " ".join(rng.choices(words, k=rng.choice([0, 5, 40, 200]))), rng.choice(["source", "test", "unknown"])) for i in range(60)]
    return S.signals(spark.createDataFrame(tasks, "task_id long, text string")), spark.createDataFrame(files, FILES).repartition(3)


def _plain_hits(signals, files):
    """All hits with the 32 of each pair, by joins."""
    asked = signals.filter("not low_value").withColumnRenamed("kind", "signal_kind")
    loose = E._loose()
    counts = E.term_counts(files).withColumnRenamed("term", "normalized")
    words = asked.filter(~loose).join(counts, "normalized")
    text = files.select("path", E.T.normalize_term(F.col("text")).alias("_t"))
    spans = asked.filter(loose).crossJoin(text).withColumn("n", E.T.substring_count(F.col("_t"), F.col("normalized"))).filter("n > 0").drop("_t")
    rows = words.unionByName(spans.select(*words.columns)).withColumn("weight", E.lexical_weight(F.col("n")))
    best = E.Window.partitionBy("task_id", "path").orderBy(F.desc("weight"), "normalized", "signal_kind", "origin")
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n <= 32").drop("_n")


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_hits_scores_and_first_pairs_are_those_of_all_pairs(spark, mixed):
    signals, files = mixed
    columns = ["task_id", "path", "signal_kind", "value", "normalized", "origin", "n", "weight"]
    plain = E.materialize(_plain_hits(signals, files))
    words = E.Words(signals, files)
    assert _rows(words.hits(), *columns) == _rows(plain, *columns)
    assert max(r["count"] for r in plain.groupBy("task_id", "path").count().collect()) == 32
    every = E.materialize(E.identity(signals, files).unionByName(E.of_words(plain)))
    score = scoring.score(every)
    named = E.materialize(E.identity(signals, files))
    parts = scoring.score(named.unionByName(E.of_words(words.hits(named)))).unionByName(words.scores(E.BY_WORDS, without=named))
    assert _rows(parts, "task_id", "path", "score") == _rows(score, "task_id", "path", "score")
    counted = scoring.deduplicate(E.of_words(plain)).agg(F.count("*"), F.round(F.sum("weight"), 4)).first()
    assert tuple(words.sums().select("n", F.round("weight", 4)).first()) == tuple(counted)
    order = [F.desc("score"), E.P.category_priority(F.col("category")), F.col("path")]
    top = lambda rows: scoring.top(scoring.score(rows).join(files.select("path", "category"), "path"), 5, *order)
    direct = E.materialize(E.direct(signals, files, None, None, 5))
    assert _rows(top(direct), "task_id", "rank", "path", "score") == _rows(top(every), "task_id", "rank", "path", "score")


def test_tasks_are_taken_in_passes(spark, mixed, monkeypatch):
    signals, files = mixed
    words = E.Words(signals, files)
    whole = _rows(words.first(E.BY_WORDS, 4), "task_id", "path"), _rows(E.baseline_first(signals, files, 4), "task_id", "path", "score")
    monkeypatch.setattr(streamed, "TASKS", 5)
    assert (_rows(words.first(E.BY_WORDS, 4), "task_id", "path"), _rows(E.baseline_first(signals, files, 4), "task_id", "path", "score")) == whole


def test_the_first_files_do_not_move_all_pairs(spark, alike):
    tasks, files = alike
    for plan in (lambda: search.baseline(tasks, files, 3), lambda: E.direct(S.signals(tasks).filter("value = 'beta'"), files, None, None, 3)):
        before = _moved(spark)
        assert len(plan().collect()) == 360
        assert _moved(spark) - before < 12_000


def test_all_pairs_do_not_move(spark, alike):
    tasks, files = alike
    before = _moved(spark)
    assert E.lexical(S.signals(tasks).filter("value = 'beta'"), files).count() == 24_000
    words = E.Words(S.signals(tasks), files)
    assert words.scores(E.BY_WORDS).count() == 24_000 and words.sums().first()["n"] == 72_000
    assert _moved(spark) - before < 12_000


def test_names_are_cut_before_tasks_come_in(spark, alike):
    tasks, files = alike
    signals = E.materialize(S.signals(tasks))
    before = _moved(spark)
    assert E.identity(signals, files).filter("signal = 'alpha'").count() == 120 * 32
    assert _moved(spark) - before < 2_000


def test_substrings_are_counted_as_by_hand():
    rng = random.Random(5)
    for alphabet in ("abc", "ab ñ漢\0") * 60:
        word = lambda a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))  # noqa: B023, E731
        terms, texts = sorted({word(1, 14) for _ in range(40)}), [word(0, 60) for _ in range(rng.randint(1, 7))]
        got = streamed.Substrings(terms).counts([t.encode() for t in texts])
        assert got.tolist() == [[x.count(t) for t in terms] for x in texts]


def test_a_candidate_s_text_is_kept_once(spark, alike):
    tasks, files = alike
    ranked = search.baseline(tasks, files, 3)
    texts = plans._texts(ranked, files)
    assert texts.count() == ranked.select("path").distinct().count() == 3


def test_owners_of_lines_in_long_files(spark):
    symbols = [("a", f"s{i}", i, i + 200) for i in range(1, 400, 50)] + [("a", "one", 64, 64), ("a", "two", 63, 65)]
    lines = spark.createDataFrame([("a", i) for i in range(1, 400)], "path string, line int")
    plain = {}
    for line in range(1, 400):
        held = sorted((e - s, name) for _, name, s, e in symbols if s <= line <= e)
        if held and [x[0] for x in held].count(held[0][0]) == 1:
            plain[line] = held[0][1]
    found = E.owners(lines, spark.createDataFrame(symbols, "path string, symbol_id string, start_line int, end_line int"))
    assert {r["line"]: r["symbol_id"] for r in found.collect()} == plain


def test_sections_meet_terms_without_a_nested_loop(spark):
    rng = random.Random(8)
    words = ["ab", "cd", "abcd", "efg", "Hij", "k-l"]
    text = lambda: "\n".join(rng.choice(["# ", "## ", "", "", ""]) + " ".join(rng.choices(words, k=3)) for _ in range(rng.randint(1, 25)))
    docs = spark.createDataFrame([(f"d{i}", text()) for i in range(12)], "path string, text string")
    asked = [(t, w.lower()) for t in range(9) for w in rng.sample(words, 3)]
    got = ranges.select_sections(docs, spark.createDataFrame(asked, "task_id long, normalized string"), 3)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    lines, plain = {r["path"]: r["text"].split("\n") for r in docs.collect()}, []
    found = ranges.sections(docs).collect()
    for task in range(9):
        for path in lines:
            scored = []
            for s in (s for s in found if s["path"] == path):
                body = " ".join(lines[path][s["start_line"] - 1 : s["end_line"]]).lower()
                n = sum(4 * (w in s["heading"].lower()) + (w in body) for t, w in asked if t == task)
                scored += [(-n, s["end_line"] - s["start_line"], s["start_line"], s["end_line"])] if n else []
            upto = 0
            for a, z in sorted(x[2:] for x in sorted(scored)[:3]):
                if upto and a <= upto + 1:
                    plain[-1] = (*plain[-1][:3], max(upto, z))
                else:
                    plain.append((task, path, a, z))
                upto = plain[-1][3]
    assert _rows(got, "task_id", "path", "start_line", "end_line") == sorted(plain) and len(plain) > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_ablations_share_their_evidence(spark, monkeypatch):
    calls, verified = [], E.verified
    monkeypatch.setattr(E, "verified", lambda *a: calls.append(1) or verified(*a))
    assert plans.QUERIES["search_v2_ablations"](spark, "/root/testdata/sf0.001").columns == ["left_out", "task_id", "rank", "path", "score"]
    assert len(calls) == 2
