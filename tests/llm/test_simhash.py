"""SimHash classes: against plain fingerprints and all pairs, the covering property, and the defined cases."""

import random
import re
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from siltstone.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=2):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(nodes, 2):
        if (x ^ y).bit_count() <= radius:
            root[find(x)] = find(y)
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_within_the_radius():
    tables = simhash.masks(2)
    assert len(tables) == 7 and {m.bit_count() for m in tables} <= {36, 37}
    for n in (1, 2):
        for bits in combinations(range(64), n):
            assert any(not m & sum(1 << b for b in bits) for m in tables)
    assert len(simhash.masks(4)) == 31
    rng = random.Random(0)
    some = [sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(500)]
    assert all(any(not m & x for m in simhash.masks(4)) for x in some)


def test_fingerprints_of_pieces_equal_whole_texts(monkeypatch):
    rng = random.Random(1)
    whole = common.pieces
    for text in ["", " \t\n", "A", "a B", "Ärger ÄRGER x", "a b c", "a\x0bb\x0cc\rd", " ".join(rng.choice(["Aa", "b", "cÉ", "日本"]) for _ in range(500))]:
        for size in (1, 7, 1 << 19):
            monkeypatch.setattr(common, "pieces", lambda data, apart, size=size: whole(data, apart, size))
            assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text), (text[:20], size)


def test_links_within_hot_and_split_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    nodes = set(base) | {0, 2**64 - 1}
    for x in base[:3]:  # chains and balls, of which the least fingerprint is not the centre
        for _ in range(60):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            nodes.add(x)
    hot = base[3]
    free = [b for b in range(64) if not simhash.masks(2)[0] >> b & 1]
    nodes |= {hot ^ sum(1 << b for b in rng.sample(free, rng.randrange(8))) for _ in range(300)}  # one bucket
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in nodes], "fp long")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    plain = plain_components(sorted(nodes))
    assert {frozenset(y for y in nodes if find(y) == find(x)) for x in nodes} == {frozenset(y for y in nodes if plain[y] == plain[x]) for x in nodes}


def test_components_of_documents(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(40):
        words = rng.choices(vocab, k=400)
        rows.append((i, " ".join(words)))
        for j in range(3):
            words[rng.randrange(400)] = "changed"
            rows.append((100 + 10 * i + j, " ".join(words).upper() if j else " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (3, "another text under the same id"), (3, rows[12][1]), (None, "no id at all"), (None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = [(i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({c for _, _, c in got}) < len(set(prints))  # some texts that differ are linked
    assert simhash.near_duplicates(df.filter("false")).count() == 0
