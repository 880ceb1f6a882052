"""Language ID, licences, quality, URLs: plain versions, held-out accuracy, and the defined cases."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, license_scan, quality, url_filter

EN, DE = "the cat sat on the mat and the dog ran to the house ", "der hund lief in das haus und die katze schlief auf der matte "


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plain_ppm(train: dict[str, list[bytes]], text: bytes, order: int) -> dict[str, float]:
    """Code lengths by PPM, method C with exclusion, walked byte by byte."""
    out = {}
    for lang, texts in train.items():
        counts = defaultdict(lambda: defaultdict(int))
        for t in texts:
            padded = b"\n" * order + t
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    counts[padded[i - k : i]][padded[i]] += 1
        bits, padded = 0.0, b"\n" * order + text
        for i in range(order, len(padded)):
            seen, p = set(), 1.0
            for k in range(order, -1, -1):
                c = {s: n for s, n in counts[padded[i - k : i]].items() if s not in seen} if padded[i - k : i] in counts else {}
                if not c:
                    continue
                total = sum(c.values()) + len(c)
                if padded[i] in c:
                    p *= c[padded[i]] / total
                    break
                p *= len(c) / total
                seen |= set(c)
            else:
                p *= 1 / (256 - len(seen))
            bits -= math.log2(p)
        out[lang] = bits
    return out


def test_ppm_code_lengths_equal_a_plain_walk():
    train = {"de": [DE.encode() * 2, b"Stra\xc3\x9fe"], "en": [EN.encode(), b"caf\xc3\xa9"]}
    rows = []
    for lang, texts in train.items():
        counts = defaultdict(int)
        for t in texts:
            padded = b"\n" * language_id.ORDER + t
            for i in range(language_id.ORDER, len(padded)):
                for k in range(language_id.ORDER + 1):
                    context = sum(padded[i - 1 - j] << 8 * j for j in range(k))
                    counts[k, context, padded[i]] += 1
        rows += [(lang, d, c, b, n) for (d, c, b), n in counts.items()]
    model = language_id.compile_model(["de", "en"], pd.DataFrame(rows, columns=["lang", "depth", "context", "byte", "n"]))
    for text in (b"the hund ran\xff", b"x", b"\n\nder", "Straße".encode()):
        got = language_id.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        want = plain_ppm(train, text, language_id.ORDER)
        assert got == pytest.approx([want["de"], want["en"]], rel=1e-4)


def test_language_id_cases(spark):
    train = docs(spark, [("en", EN * 3), ("de", DE * 3), (None, EN), ("en", None)], "lang string, text string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en"]
    long = EN * 20_000
    given = docs(spark, [(1, "the house and the mat"), (2, "das haus und die matte"), (3, None), (4, ""), (5, "12 !!"), (6, long), (None, "the dog"), (1, "the house and the mat")]).withColumn("score", F.lit("clash"))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in language_id.identify(spark, given, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "en", 1.0), (2, "de", 1.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (6, "en", 1.0), (None, "en", got[-2][2]), (1, "en", 1.0)], key=str)
    assert language_id.identify(spark, given.filter("false"), model).count() == 0
    empty = language_id.fit(train.filter("false"))
    assert {r["lang_pred"] for r in language_id.identify(spark, given, empty).collect()} == {"und"}


def test_quality_learns_and_covers_the_whole_text(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    net = quality.train([t.encode() for t in good[:40] + bad[:40]], [1] * 40 + [0] * 40, epochs=6)
    score = lambda t: net.score(np.frombuffer(t.encode(), np.uint8))
    assert np.mean([score(t) >= 0.5 for t in good[40:]]) >= 0.9 and np.mean([score(t) < 0.5 for t in bad[40:]]) >= 0.9
    assert score(" ".join(good[:30]) + " " + " ".join(bad[:30])) < score(" ".join(good[:60]))  # junk at the very end counts
    given = docs(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (4, good[0] * 300)])
    got = {r["doc_id"]: r["score"] for r in quality.score(spark, given, net).collect()}
    assert got[1] == got[2] and all(0 <= v <= 1 for v in got.values()) and len(got) == 4
    assert quality.score(spark, given.filter("false"), net).count() == 0
    only = quality.train([b"abc", b"def"], [1, 1])
    assert only.score(np.zeros(0, np.uint8)) > 0.99 and quality.train([], []).score(np.zeros(0, np.uint8)) == 0.5


def plain_score(net, text: bytes) -> float:
    """The network's forward pass, position by position."""
    width, block = quality.WIDTH, quality.BLOCK
    z = net.bias
    if text:
        text += bytes(max(0, width - len(text)))
        act = [[float(net.shift[f]) + sum(float(net.tables[k][text[i + k]][f]) for k in range(width)) for f in range(quality.FILTERS)] for i in range(len(text) - width + 1)]
        blocks = [act[i : i + block] for i in range(0, len(act), block)]
        chunks = [sum(blocks[i : i + 2], []) for i in range(max(1, len(blocks) - 1))]
        top = [[max(0.0, max(row[f] for row in c)) for f in range(quality.FILTERS)] for c in chunks]
        for f in range(quality.FILTERS):
            z += float(net.weights[f]) * max(t[f] for t in top) + float(net.weights[quality.FILTERS + f]) * sum(t[f] for t in top) / len(top)
    return 1 / (1 + math.exp(-z))


def some_network(seed=2):
    rng = np.random.default_rng(seed)
    n = quality.FILTERS
    return quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, n)), rng.normal(0, 0.1, n), rng.normal(0, 0.3, 2 * n), 0.2)


@pytest.mark.parametrize("text", [b"", b"a", b"abcdef", b"abcdefg", "Stra\u00dfe ".encode() * 40, bytes(range(256)) * 3])
def test_quality_score_equals_a_plain_pass(text):
    net = some_network()
    assert net.score(np.frombuffer(text, np.uint8)) == pytest.approx(plain_score(net, text), rel=1e-9)


def test_quality_reads_every_byte():
    net = some_network()
    for n in (7, 8, 9, 300, 301):
        text = bytes(97 + i % 20 for i in range(n))
        acts = net.activations(np.frombuffer(text, np.uint8))
        for i in range(n):
            other = net.activations(np.frombuffer(text[:i] + b"Z" + text[i + 1 :], np.uint8))
            assert (other != acts).any()


def test_quality_gradient_matches_differences():
    net, step = some_network(), 1e-6
    for text, label in ((b"some text that is long enough for chunks " * 12, 1), (b"xyz", 0), (b"", 1)):
        data = np.frombuffer(text, np.uint8)
        loss = lambda: -math.log(net.score(data) if label else 1 - net.score(data))  # noqa: B023, E731
        tables, shift, weights, bias = quality.gradient(net, data, label)
        places = [(net.tables, tables, (k, b, f)) for k in (0, 5) for b in b"sx t" for f in (0, 7)] + [(net.shift, shift, (f,)) for f in (0, 9)] + [(net.weights, weights, (f,)) for f in (1, 20)]
        for values, slopes, at in places:
            was = values[at]
            values[at] = was + step
            up = loss()
            values[at] = was - step
            down = loss()
            values[at] = was
            assert slopes[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)
        was = net.bias
        net.bias = was + step
        up = loss()
        net.bias = was - step
        down = loss()
        net.bias = was
        assert bias == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_licences(spark):
    rng = np.random.default_rng(5)
    line = lambda: " ".join("".join(rng.choice(list("aeourstnlm"), 5)) for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(40)]
    rows += [(100, line() + "\nLicensed under the Apache License, Version 2.0.\n" + line()), (101, "Released under the MIT License."), (102, "This work is licensed under the GNU General Public License, version 3.")]
    rows += [(103, "Licensed under the Granite Valley License 3.1."), (104, None), (105, ""), (106, (line() + "\n") * 2000 + "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (101, "Released under the MIT License.")]
    given = docs(spark, rows).withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: r for r in license_scan.scan(given).collect()}
    assert [got[i]["licence"] for i in (100, 101, 102, 103, 104, 105, 106, None)] == ["Apache-2.0", "MIT", "GPL", "unknown", None, None, "CC-BY-NC", "MIT"]
    assert all(got[i]["licence"] is None for i in range(40)) and got[101]["paragraphs"] == 1
    assert license_scan.scan(given.filter("false")).count() == 0


def test_licence_paragraphs(spark):
    """Wrapped statements, several licences, words of licences in other uses, and rows without an id."""
    mit = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated\ndocumentation files"
    rows = [(1, mit), (2, "some prose\n\nLicensed under the\nApache License,\nVersion 2.0\n\nmore prose"), (None, "Released under the MIT License."), (None, "plain words of a document")]
    rows += [(3, "he got the MIT degree and a driving license last year"), (4, "Released under the MIT License.\nLicensed under CC BY 4.0."), (5, "Released under the MIT License.\n \t\nLicensed under CC BY 4.0."), (6, "one text"), (6, "Released under the MIT License.")]
    got = sorted(((r["doc_id"], r["licence"] if len(r["families"]) < 2 else "two", tuple(r["families"]), r["paragraphs"]) for r in license_scan.scan(docs(spark, rows)).collect()), key=str)
    want = [(1, "MIT", ("MIT",), 1), (2, "Apache-2.0", ("Apache-2.0",), 1), (None, "MIT", ("MIT",), 1), (None, None, (), 0), (3, None, (), 0), (4, "two", ("CC-BY", "MIT"), 1), (5, "two", ("CC-BY", "MIT"), 2), (6, None, (), 0), (6, "MIT", ("MIT",), 1)]
    assert got == sorted(want, key=str)


def plain_licence(scanner, part: str):
    """(family, chance) of a part of a text, scored from the fitted weights; None for `none`."""
    import re

    words = re.findall(r"[^\W_]+", part.lower())
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    counts, model = scanner.model.stages
    x = np.array([g in grams for g in counts.vocabulary], float)
    z = model.coefficientMatrix.toArray() @ x + model.interceptVector.toArray()
    chance = np.exp(z / scanner.temperature) / np.exp(z / scanner.temperature).sum()
    best = scanner.classes[int(z.argmax())]
    if best == license_scan.NONE:
        return None
    pairs = {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
    own = license_scan.FAMILIES.get(best, {"names": [], "templates": []})
    line = f" {' '.join(words)} "
    shared = max([len(set(license_scan._pairs(t)) & pairs) / len(license_scan._pairs(t)) for t in own["templates"] + [n for n in own["names"] if len(license_scan._pairs(n)) > 1]], default=0)
    one = {f" {license_scan._words(n)[0]} " for n in own["names"] if len(license_scan._words(n)) == 1}
    named = any(n in line for n in license_scan._sequences(own["names"])) or line in one
    sure = best != license_scan.UNKNOWN and chance.max() >= license_scan.MIN_CHANCE and (named or shared >= license_scan.MIN_SHARED)
    return best if sure else license_scan.UNKNOWN, chance.max()


def test_licences_equal_plain_scores(spark):
    rng = np.random.default_rng(8)
    made = [t for t, _ in license_scan.sentences()]
    prose = lambda: " ".join("".join(rng.choice(list("aeourstnlm"), 4)) for _ in range(8))
    rows = [(i, " ".join([prose(), str(rng.choice(made)), prose()] if i % 3 else [str(rng.choice(made))])) for i in range(120)]
    rows += [(200 + i, str(rng.choice(made))[: int(rng.integers(5, 60))]) for i in range(60)]
    scanner = license_scan.fit(docs(spark, [(i, prose()) for i in range(80)]))
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows), scanner).collect()}
    for i, text in rows:
        want = plain_licence(scanner, text)
        assert got[i]["licence"] == (want and want[0])
        assert want is None or got[i]["chance"] == pytest.approx(want[1], rel=1e-6)


URLS = ["http://a.example.com/en/1", "https://www.example.com/en/x?utm=1#t", "http://shop.net/es/2", "http://NET/fr/", "http://x.org/fr/2", None, "nourl", "http://x.com", "http://deep.www.example.com/en/"]


def test_url_rules(spark):
    got = [tuple(r) for r in url_filter.judge(docs(spark, list(enumerate(URLS)), "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert got[0][1:] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1][1:] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][3:] == ("net/es/", "block") and got[3][1:] == ("net", "/fr/", "net/fr/", "block")
    assert got[5][1:] == ("", "", None, "allow") and got[6][1:] == ("", "", None, "allow")
    assert got[7][2:4] == ("", None) and got[8][3:] == ("www.example.com/en/", "allow")
    assert url_filter.judge(docs(spark, [], "page_id long, url string")).count() == 0
    more = [(1, "http://a.example.com/en/" + "x" * 100_000, "clash"), (1, URLS[0], "clash"), (1, URLS[0], "clash"), (None, None, None)]
    got = url_filter.judge(spark.createDataFrame(more, "page_id long, url string, verdict string").withColumn("tokens", F.lit("kept")).withColumn("stated", F.lit("kept"))).collect()
    assert sorted(str((r["page_id"], r["rule"], r["verdict"], r["tokens"], r["stated"])) for r in got) == sorted(map(str, [(1, "example.com/en/", "block", "kept", "kept")] * 3 + [(None, None, "allow", "kept", "kept")]))


def test_mined_rules_equal_counting(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'fr', 'es'])}/{i}", str(rng.choice(["block", "allow"]))) for i in range(120)]
    rows = [(u, "block" if "/fr/" in u and ".net" in u else v) for u, v in rows]
    labelled = docs(spark, rows, "url string, verdict string").select(url_filter.tokens_of("url").alias("tokens"), "verdict")
    rules = url_filter.mine(labelled, 0.02, 0.9)
    sets = [(set(r["tokens"]), r["verdict"]) for r in labelled.collect()]
    from itertools import combinations

    every = sorted(set().union(*[s for s, _ in sets]))
    least = math.ceil(0.02 * len(sets))
    want = set()
    for n in (1, 2, 3):
        for c in combinations(every, n):
            held = [v for s, v in sets if set(c) <= s]
            blocked = held.count("block")
            if blocked >= least and blocked / len(held) >= 0.9 and not any(set(w) < set(c) for w in want):
                want.add(c)
    from itertools import product

    spelt = {tuple(sorted(c)) for r in rules.collect() for c in product(*r["rule"])}
    assert spelt == want and want
    assert url_filter.mine(labelled.filter("false")).count() == 0
    for bound in (0, 2000):  # within the expression, and by a join
        monkeypatch.setattr(url_filter, "MAX_LITERAL", bound)
        got = sorted((tuple(r["tokens"]), r["matched"]) for r in url_filter.matched(labelled, rules).collect())
        assert got == sorted((tuple(sorted(s)), any(set(w) <= s for w in want)) for s, _ in sets)


def test_long_paths_are_mined_in_one_place(spark):
    path = "/".join("p" + chr(97 + j) for j in range(26))
    rows = [(f"http://a{i}.net/{path}/x{i % 2}" if i % 2 else f"http://b{i}.com/y", "block" if i % 2 else "allow") for i in range(50)]
    labelled = docs(spark, rows, "url string, verdict string").select(url_filter.tokens_of("url").alias("tokens"), "verdict")
    rules = url_filter.mine(labelled, 0.1).collect()
    assert [len(r["rule"]) for r in rules] == [1] and set(rules[0]["rule"][0]) == {"h:net"} | {"p:p" + chr(97 + j) for j in range(26)}
