"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that they belong to); patterns offer
their words as capacity, once at cost 1 and each further repetition at a higher, convexly growing cost,
and a min-cost flow routes that capacity to the sources' quotas.  The flow network has a node per pattern
and source only, so the driver sees a table that does not grow with the documents; a source that shares no
document with another needs no flow.  The words routed from a pattern are then turned into documents: every
document is taken as often as all can be, and a seeded subset once more.  The subset is a walk in hash order
that takes every document that still fits: a round takes whole buckets below the cut, then documents of the
bucket at the cut; the next deals the untaken documents no longer than the gap that is left, until none is.
Then the one document whose size best fills the gap.  Rows with equal ids and sizes walk as one, with a count.

Defined cases: a null text has size 0; sources sort by code point, null last and a source of its own; no list
of sources, or an empty one, is the null source; a source without words has target 0; repeated rows are
documents of their own, taken one by one; equal hashes go by id and size; rows with a null id go by their
text's hash; an empty table gives an empty result; other columns are kept out.  Reruns agree.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
SEED = ""
#: Hash buckets of a pattern, as hexadecimal digits of an md5.
DIGITS = 3
#: Rows that one task writes out of equal rows.
CHUNK_ROWS = 1 << 20
#: Patterns up to which tables of a row per pattern are broadcast; beyond, they are joined by shuffles.
MAX_BROADCAST = 100_000
_RANK = ["h", "doc_id", "size"]


def targets(sizes: dict, weights: dict, total: float, most: float = MOST) -> dict:
    """Shares of `total` by weight; none exceeds `most` times its source's size, the excess is shared again."""
    out = dict.fromkeys(sizes, 0.0)
    open_, left = list(sizes), total
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        full = {s: None for s in open_ if share[s] > most * sizes[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def min_cost_flow(arcs: list[tuple[int, int, float, float]], nodes: int, source: int, sink: int) -> list[float]:
    """The flow on each arc (from, to, capacity, cost) of a maximal flow of least cost: cheapest augmenting
    paths, found by Dijkstra with potentials (no cost is negative)."""
    to, capacity, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), capacity.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), capacity.append(0.0), cost.append(-w)
    potential, tiny = [0.0] * nodes, 1e-9 * max([1.0, *(c for _, _, c, _ in arcs)])
    while True:
        far, via, heap = [float("inf")] * nodes, [-1] * nodes, [(0.0, source)]
        far[source] = 0.0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if capacity[e] > tiny and (x := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]] - 1e-12:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[sink] < 0:
            return [capacity[2 * i + 1] for i in range(len(arcs))]
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        amount = min(capacity[e] for e in path)
        for e in path:
            capacity[e] -= amount
            capacity[e ^ 1] += amount


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, dict]:
    """Words to take from each pattern (a tuple of sources; its words) for each of its sources, so that the sources get their quotas."""
    serving = Counter(s for p in patterns for s in p)
    alone = [p for p in patterns if len(p) == 1 and serving[p[0]] == 1]
    out = {p: {p[0]: float(min(quotas.get(p[0], 0.0), most * patterns[p]))} for p in alone}
    names = sorted(patterns.keys() - out.keys(), key=repr)
    sources = sorted({s for p in names for s in p if s in quotas}, key=repr)
    first = 1
    at = {s: first + len(names) + i for i, s in enumerate(sources)}
    sink = first + len(names) + len(sources)
    arcs = []
    for i, p in enumerate(names):
        for again in range(most):  # each repetition of the same words costs more than the last
            arcs.append((0, first + i, float(patterns[p]), float((again + 1) ** 2)))
        arcs += [(first + i, at[s], float(most * patterns[p]), 0.0) for s in p if s in at]
    arcs += [(at[s], sink, float(quotas[s]), 0.0) for s in sources]
    out |= {p: dict.fromkeys(p, 0.0) for p in names}
    for (a, b, _, _), x in zip(arcs, min_cost_flow(arcs, sink + 1, 0, sink), strict=True):
        if a and b != sink:
            out[names[a - first]][sources[b - first - len(names)]] += x
    return out


def _deal(groups: DataFrame, room: DataFrame) -> DataFrame:
    """groups (pattern, h, doc_id, size, n, bucket) with k, how many of the n rows are taken, and left, the pattern's room after
    that: the first of each pattern in hash order, up to the row that would exceed its room (pattern, room); whole
    buckets below the cut, single rows in the bucket at the cut."""
    buckets = groups.groupBy("pattern", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    below = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = common.materialize(buckets.withColumn("below", below).join(room, "pattern"))
    cut = groups.join(buckets, ["pattern", "bucket"])
    inside = (F.col("below") < F.col("room")) & (F.col("below") + F.col("words") > F.col("room"))
    taken = F.when((F.col("below") + F.col("words") <= F.col("room")) & (F.col("size") > 0), F.col("n")).otherwise(0)
    whole = cut.filter(~inside).withColumn("k", taken)
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("pattern").orderBy(*_RANK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.floor((F.col("room") - F.col("below") - before) / F.greatest("size", F.lit(1))).cast("long")
    edge = cut.filter(inside).withColumn("k", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), fit))).otherwise(0))
    return whole.unionByName(edge).select(*groups.columns, "k")


def select(sized: DataFrame, want: DataFrame, most: int = MOST) -> DataFrame:
    """(pattern, doc_id, size, taken) of sized (pattern, doc_id, h, size), a row per row: the words of each document that
    bring each pattern to its words of want (pattern, words, size)."""
    few = want.count() <= MAX_BROADCAST
    per = lambda table: F.broadcast(table) if few else table
    base = F.when(F.col("size") > 0, F.least(F.lit(most), F.floor(F.col("words") / F.col("size")))).otherwise(0).cast("int")
    want = want.withColumn("base", base)
    room = common.materialize(want.select("pattern", F.when(F.col("base") < most, F.col("words") - F.col("base") * F.col("size")).otherwise(0.0).alias("room")))
    rest = sized.groupBy("pattern", *_RANK).agg(F.count("*").alias("n")).withColumn("bucket", F.substring("h", 1, DIGITS))
    settled = []
    while True:  # the first row of a round fits, so each round takes some
        dealt = common.materialize(_deal(rest, room))
        spent = dealt.groupBy("pattern").agg(F.sum(F.col("size") * F.col("k")).alias("spent"))
        room = common.materialize(room.join(spent, "pattern", "left").select("pattern", (F.col("room") - F.coalesce("spent", F.lit(0))).alias("room")))
        fits = (F.col("k") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("room"))
        dealt = common.materialize(dealt.join(per(room), "pattern").withColumn("fits", fits))  # one broadcast, not one per use
        settled.append(dealt.filter("not fits").drop("bucket", "room", "fits"))
        rest = dealt.filter("fits").drop("k", "room", "fits")
        if rest.isEmpty():
            break
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    chosen = common.materialize(chosen.join(per(room.withColumnRenamed("room", "gap").join(want.select("pattern", "base"), "pattern")), "pattern"))
    # the one document that best fills the gap, if it brings the pattern closer
    off = F.abs(F.col("gap") - F.col("size"))
    best = F.min(F.when((F.col("k") < F.col("n")) & (off < F.col("gap")), F.struct(off.alias("off"), *_RANK)))
    filler = chosen.groupBy("pattern").agg(best.alias("f")).filter("f is not null").select("pattern", *[F.col(f"f.{c}").alias(f"f_{c}") for c in _RANK])
    same = F.col("h").eqNullSafe(F.col("f_h")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("size") == F.col("f_size"))
    chosen = chosen.join(per(filler), "pattern", "left").withColumn("k", F.col("k") + F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0))
    # equal rows can't be told apart in the result, so they are written out by number
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS)))
    few = chosen.filter(F.col("n") <= CHUNK_ROWS).withColumn("from", F.lit(0).cast("long"))
    many = chosen.filter(F.col("n") > CHUNK_ROWS).withColumn("from", chunk).withColumn("from", F.col("from") * CHUNK_ROWS).repartition("pattern", "h", "from")
    rows = few.unionByName(many).withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + CHUNK_ROWS) - 1)))
    return rows.select("pattern", "doc_id", "size", (F.col("size") * (F.col("base") + F.when(F.col("i") < F.col("k"), 1).otherwise(0))).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(doc_id, size, sources, taken) for docs (doc_id, text, sources), sources being an array of names.

    sources in the result: (source, source_size, target, share) of each, share being the part of what is taken
    from documents with these sources that the flow counts for this one."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)).cast("long"), F.lit(0))
    named = F.when(F.size("sources") > 0, F.array_sort(F.array_distinct("sources"))).otherwise(F.array(F.lit(None).cast("string")))
    h = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    sized = common.materialize(docs.select("doc_id", F.to_json(named).alias("pattern"), size.alias("size"), h.alias("h")))
    grouped = sized.groupBy("pattern").agg(F.sum("size").alias("size")).withColumn("names", F.from_json("pattern", "array<string>")).collect()
    key = {tuple(r["names"]): r["pattern"] for r in grouped}  # as Spark writes it: nothing else is joined with it
    patterns = {tuple(r["names"]): r["size"] for r in grouped}
    sizes: Counter = Counter()
    for p, n in patterns.items():
        sizes.update(dict.fromkeys(p, n))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = targets({s: sizes[s] for s in names}, weight, total * sum(patterns.values()), most)
    flows = route(patterns, target, most)
    facts = []
    for p, n in patterns.items():
        words = sum(flows[p].values())
        facts.append((key[p], words, n, [(s, sizes[s], round(target[s], 6), flows[p][s] / words if words else 0.0) for s in p]))
    facts = spark.createDataFrame(facts, "pattern string, words double, size long, sources array<struct<source:string,source_size:long,target:double,share:double>>")
    chosen = select(sized, facts.select("pattern", "words", "size"), most)
    facts = F.broadcast(facts) if len(patterns) <= MAX_BROADCAST else facts
    return chosen.join(facts.select("pattern", "sources"), "pattern").select("doc_id", "size", "sources", "taken")


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for docs (doc_id, text, source), one source per document."""
    mixed = mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
    only = F.get("sources", F.lit(0))
    return mixed.select("doc_id", "size", only["source_size"].alias("source_size"), only["target"].alias("target"), "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(':' || CAST(doc_id AS VARCHAR)) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
a AS (SELECT CAST(0 AS BIGINT) AS turn, source, source_size, weight, 1.5 * sum(source_size) OVER () AS pool, false AS closed, CAST(0 AS DOUBLE) AS target FROM s
  UNION ALL
  SELECT turn + 1, source, source_size, weight,
         pool - sum(CASE WHEN NOT closed AND share > 2 * source_size THEN 2 * source_size ELSE 0 END) OVER (),
         closed OR share > 2 * source_size,
         CASE WHEN closed THEN target WHEN share > 2 * source_size THEN 2 * source_size ELSE share END
  FROM (SELECT *, pool * weight / sum(CASE WHEN closed THEN 0 ELSE weight END) OVER () AS share FROM a)
  WHERE turn < 64),
t AS (SELECT source, source_size, target FROM a WHERE turn = 64),
p AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target / source_size) AS BIGINT)) END AS base
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN base < 2 THEN target - base * source_size ELSE 0 END AS more,
             row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) AS turn FROM p),
l AS (SELECT source, any_value(more) AS more, list(size ORDER BY turn) AS sizes FROM m GROUP BY source),
-- a walk in hash order: the room that is left before each document, which is taken if it fits
w AS (SELECT source, CAST(0 AS BIGINT) AS turn, more AS room, CAST(NULL AS BOOLEAN) AS extra, sizes FROM l
  UNION ALL
  SELECT source, turn + 1, CASE WHEN sizes[turn + 1] BETWEEN 1 AND room THEN room - sizes[turn + 1] ELSE room END, sizes[turn + 1] BETWEEN 1 AND room, sizes
  FROM w WHERE turn < len(sizes)),
c AS (SELECT m.*, w.extra FROM m JOIN w ON m.source IS NOT DISTINCT FROM w.source AND m.turn = w.turn),
g AS (SELECT *, more - coalesce(sum(size) FILTER (WHERE extra) OVER (PARTITION BY source), 0) AS gap FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT extra AND abs(gap - size) < gap THEN abs(gap - size) END NULLS LAST, h, doc_id, size) AS pick FROM g)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (base + CASE WHEN extra OR (pick = 1 AND abs(gap - size) < gap) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
"""
