"""Near-duplicates, substrings, decontamination: against plain versions, and the defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination, fm_index, near_dedup, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edit(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
    return " ".join(w)


def shingles(text):
    w = WORDS.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_rows(seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for size, n in ((40, 200), (12, 60), (6, 1200)):  # groups around an original, some copies beyond the threshold
        base = prose(rng, n)
        for _ in range(size):
            rows.append((i, edit(rng, base, rng.randrange(0, max(2, n // 25)))))
            i += 1
    rows += [(i + k, prose(rng, rng.randrange(1, 300))) for k in range(60)]
    rows += [(1000, "one two"), (1001, "one two"), (1002, "one two three"), (1003, rows[0][1]), (1004, rows[0][1])]
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows).withColumn("class_id", F.lit("clash"))).collect()}
    assert got == plain_classes(rows)


def test_near_duplicates_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same words here"), (5, "same words here"), (None, "same words here"), (5, "same words here"), (7, "long " * 50_000), (8, "long " * 50_000)]
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, 4), (7, 7), (8, 7)], key=str)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = random.Random(6)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(5, a), (5, b), (9, edit(rng, a, 1)), (3, edit(rng, b, 1)), (None, edit(rng, b, 1)), (None, c), (None, edit(rng, c, 1)), (None, None)]
    for given in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs(spark, given)).collect()), key=str)
        assert got == sorted([(5, 5), (9, 5), (5, 3), (3, 3), (None, 3), (None, None), (None, None), (None, None)], key=str)


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    base = prose(rng, 300)
    texts = [base, edit(rng, base, 10), "a " * 40 + base, prose(rng, 3), prose(rng, 3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    index, cell = near_dedup.cells(data, offsets)
    k = 2048
    s = near_dedup.signatures(index, cell, len(texts), k)
    assert (s != np.uint64(2**64 - 1)).all()
    for a, b in ((0, 1), (0, 2), (1, 2), (0, 4)):
        x, y = shingles(texts[a]), shingles(texts[b])
        true = sum((x & y).values()) / sum((x | y).values())
        assert (s[a] == s[b]).mean() == pytest.approx(true, abs=5 * (true * (1 - true) / k) ** 0.5 + 0.002)


def plain_cut(rows, width=35):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[j : j + width]) for _, w in words for j in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - width + 1):
            if count[tuple(w[j : j + width])] > 1:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cut_rows():
    rng = random.Random(2)
    passage, short = prose(rng, 60), prose(rng, 34)
    rows = [(i, " ".join([prose(rng, rng.randrange(0, 80)), passage if i % 3 == 0 else short, prose(rng, rng.randrange(0, 40))])) for i in range(40)]
    rows += [(100, "la " * 200), (101, "a b c " * 40), (102, None), (103, ""), (104, "\t\n "), (105, prose(rng, 35)), (106, rows[3][1]), (107, "éß " * 20 + passage)]
    return rows


def _digests(spark, rows):
    got = substring_dedup.substring_dedup(docs(spark, rows).withColumn("kept", F.lit("clash"))).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)


def test_substring_dedup_equals_counting(spark):
    rows = cut_rows()
    assert _digests(spark, rows) == plain_cut(rows)


def test_substring_dedup_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 100)
    rows = cut_rows()
    assert _digests(spark, rows) == plain_cut(rows)


def test_two_texts_of_one_id_are_two_documents(spark):
    rng = random.Random(11)
    shared, other = prose(rng, 40), prose(rng, 70)
    for two in ([(1, "x " + shared), (1, other)], [(1, other), (1, "x " + shared)]):
        rows = [*two, (2, shared + " y"), (None, other), (None, prose(rng, 50))]
        got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
        assert got == {(1, 41): 40, (1, 70): 70, (2, 41): 40, (None, 70): 70, (None, 50): 0}


@pytest.mark.parametrize("salts", [1, 7])
def test_substring_dedup_of_heavy_anchors(spark, monkeypatch, salts):
    """Every anchor is heavy: the salted joins lose and repeat nothing."""
    monkeypatch.setattr(substring_dedup, "HEAVY", 10**9)
    monkeypatch.setattr(substring_dedup, "SALTS", salts)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    rows = cut_rows()
    assert _digests(spark, rows) == plain_cut(rows)


def test_substring_dedup_cases(spark):
    rng = random.Random(9)
    text = prose(rng, 50)
    rows = [(1, text), (1, text), (None, text + " x"), (None, prose(rng, 90)), (5, prose(rng, 30_000))]
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == {(1, 50): 50, (None, 51): 50, (None, 90): 0, (5, 30_000): 0}
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0
    out = substring_dedup.cut_texts(docs(spark, [(1, text, "a"), (2, text, "b"), (3, None, "c")], "doc_id long, text string, spans string")).collect()
    assert sorted((r["doc_id"], r["text"], r["spans"]) for r in out if r["text"] is not None) == [(1, "", "a"), (2, "", "b")] and len(out) == 3


def test_fm_index_finds_every_pattern():
    rng = np.random.default_rng(0)
    passages = [rng.integers(1, 4, rng.integers(1, 20)).astype(np.uint64) for _ in range(30)]
    flat, bounds = np.concatenate(passages), np.concatenate([[0], np.cumsum([len(p) for p in passages])])
    many = rng.integers(0, 4, 30) == 0
    index = fm_index.FmIndex(flat, bounds, many)
    places, twice = defaultdict(int), defaultdict(bool)
    for p, m in zip(passages, many, strict=True):
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                places[tuple(p[i:j])] += 1
                twice[tuple(p[i:j])] |= bool(m)
    for pattern, n in list(places.items())[:400]:
        low, high = np.array([0]), np.array([index.n])
        for c in reversed(pattern):
            low, high = index.extend(index.encode(np.array([c])), low, high)
        assert high[0] - low[0] == n and index.again(low, high)[0] == (n > 1 or twice[pattern])
    for k, start in enumerate(index.reach(index.encode(flat), bounds[:-1], bounds[1:].copy())):
        p = tuple(passages[k])
        long = max((n for n in range(len(p) + 1) if n == 0 or places[p[len(p) - n :]] > 1 or twice[p[len(p) - n :]]), default=0)
        assert bounds[k + 1] - start == long


ITEM = "A train leaves Berlin at 9 with 120 people and after 45 km it stops in Berlin where 30 people get off so how many are left on the train"


def _leaks(spark, rows, bench):
    got = decontamination.decontaminate(docs(spark, rows).withColumn("items", F.lit("clash")), docs(spark, bench, "item_id long, text string")).collect()
    return sorted(((r["doc_id"], r["contaminated"], tuple(r["items"])) for r in got), key=str)


def test_decontamination(spark):
    rng = random.Random(3)
    other = ITEM.replace("Berlin", "New Paris").replace("120", "250").replace("45", "80").replace(" 9 ", " 7 ").replace("30", "60")
    broken = ITEM.replace("in Berlin", "in Hamburg")  # one slot value, two fillings
    rows = [(1, prose(rng, 40) + ". " + ITEM + ". " + prose(rng, 40)), (2, prose(rng, 10) + " then " + other), (3, broken), (4, prose(rng, 200)), (5, None), (6, ""), (7, ITEM[: len(ITEM) // 4]), (8, prose(rng, 20_000) + ". " + ITEM)]
    rows += [(1, "copy of one id"), (None, ITEM), (None, "nothing here"), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (10, "20 19 18 17 16 15 14 13 12 11 10 9 8 7"), (1, rows[0][1])]
    bench = [(10, ITEM), (11, None), (12, ""), (13, "three word item"), (14, "just four words here"), (None, ITEM), (15, "5 6 7 8 9 10 11 12 13 14"), (10, ITEM)]
    want = [(1, True, (10,)), (1, True, (10,)), (1, False, ()), (2, True, (10,)), (3, False, ()), (4, False, ()), (5, False, ()), (6, False, ()), (7, False, ()), (8, True, (10,)), (9, True, (15,)), (10, False, ()), (None, True, (10,)), (None, False, ())]
    assert _leaks(spark, rows, bench) == sorted(want, key=str)
    assert not any(found for _, found, _ in _leaks(spark, rows, []))
    assert _leaks(spark, [], bench) == []


def test_slots_must_be_filled_alike(spark):
    """The same template with the same windows, told apart by which slots are equal."""
    item = "the price was 5 in may and the price was 5 in june so what is the price now"
    rows = [(1, item.replace("5", "7")), (2, item.replace("5", "7", 1)), (3, item)]
    assert _leaks(spark, rows, [(1, item)]) == [(1, True, (1,)), (2, False, ()), (3, True, (1,))]
    unequal = item.replace("5", "7", 1)
    assert _leaks(spark, rows, [(1, item), (2, unequal)]) == [(1, True, (1,)), (2, True, (2,)), (3, True, (1,))]


def test_names_that_open_a_sentence(spark):
    asked = [(1, "Alice has 5 apples"), (2, "The train leaves the old station at noon today and nobody waits there"), (3, "Robert Smith sold his boat. He bought 3 more. Robert Smith then left town for good")]
    rows = [(1, "Robert has 3 apples"), (2, "and so Mary has 9 apples, "), (3, "we saw that the train leaves the old station at noon today and nobody waits there"), (4, "Ann sold his boat. He bought 8 more. Ann then left town for good"), (5, "Ann sold his boat. He bought 8 more. Bob then left town for good"), (6, "Robert eats 3 apples")]
    assert _leaks(spark, rows, asked) == [(1, True, (1,)), (2, True, (1,)), (3, True, (2,)), (4, True, (3,)), (5, False, ()), (6, False, ())]


def test_windows_dense_in_slots_and_capitals(spark):
    item = "A train leaves Boston at 60 mph and travels 5 hours. How far does it go before stopping?"
    other = item.replace("Boston", "Paris").replace("60", "80").replace(" 5 ", " 2 ")
    rows = [(1, "So it goes. " + other + " And so on."), (2, item.upper()), (3, "One line.\n" + item.upper() + "\nAnother line."), (4, other.replace(" 2 ", " 80 ")), (5, "I like it. How far does it go before stopping? I do not know."), (6, item.lower()), (7, "Paris 80 mph 2 hours Rome 3 km 4 miles Berlin 5 kg 6 days Oslo 7")]
    assert _leaks(spark, rows, [(1, item)]) == [(1, True, (1,)), (2, True, (1,)), (3, True, (1,)), (4, False, ()), (5, False, ()), (6, True, (1,)), (7, False, ())]


def test_short_items(spark):
    bench = [(1, "seldom seen purple walrus"), (2, "Zanzibar 44"), (3, "xylophone"), (4, "??")]
    rows = [(1, "a seldom seen purple walrus slept"), (2, "a purple walrus slept"), (3, "in zanzibar 44 of them"), (4, "Zanzibar 45"), (5, "a xylophone, two xylophones"), (6, "what??")]
    assert _leaks(spark, rows, bench) == [(1, True, (1,)), (2, False, ()), (3, True, (2,)), (4, False, ()), (5, True, (3,)), (6, False, ())]


def test_the_join_shuffles_beyond_the_broadcast_bound(spark, monkeypatch):
    rows, bench = [(1, "x " + ITEM), (2, "nothing")], [(10, ITEM)]
    want = _leaks(spark, rows, bench)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)
    assert _leaks(spark, rows, bench) == want == [(1, True, (10,)), (2, False, ())]
