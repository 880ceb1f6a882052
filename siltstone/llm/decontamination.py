"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

One pass of a pattern cuts a text into tokens: runs of capitalised words become name placeholders, numbers,
units after a number and unit signs become theirs, other words are lower-cased.  Windows of eight tokens of
every benchmark item are hash-joined with all windows of all documents, so a question with other numbers or
names still matches.  A window with fewer than MIN_LITERAL plain words would match by placeholders alone, so
its hash is made of the tokens themselves: it matches what is filled alike.  Windows that follow one another
make a run.  A run counts if it has MIN_WORDS different plain words, however they are spread over its windows, or
a window that matched as it stands, and if the fillings of its slots are consistent: equal slot values of the item have equal
values in the document and different ones different.  A document is contaminated by an item if such
runs match LEAK windows of it (thirteen tokens in a row), or half of a shorter item's windows.

A single capitalised word that opens a sentence may be a name or not.  Documents read it as a name; items are tried
in four READINGS: as names, as plain words, the item's first word alone as a plain word (an item that is
quoted in the middle of a sentence), and folded to lower case, where names are plain words.  Folded items meet only
the lines of a document that have capitals only, which are read a second time in lower case.  Items of four to seven tokens are matched by windows of four, shorter
ones as they stand.  Items with equal windows and equal slots are judged once, as a group, and listed last.
The benchmark's hashes are broadcast up to MAX_BROADCAST (8 bytes each); beyond that the join shuffles.

Defined cases: null and empty texts and items match nothing; items with the same id are judged one by one and
listed once; items with a null id are left out; rows are told apart by id and text, so repeated rows agree and
texts under one id (or a null id) have findings of their own; empty tables give no findings; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that count as units after a number (fixed values).
UNITS = [
    "km", "m", "cm", "mm", "mile", "miles", "ft", "feet", "inch", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "ounces", "tons",
    "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "euro", "euros", "cents", "liters", "litres", "degrees", "mph", "kmh",
]
NAME, NUMBER, UNIT, SIGN = 1, 2, 3, 4
_SIGNS = "%$€£°"
_LETTERS = r"[\p{L}\p{M}]"
#: Runs of capitalised words, other words, numbers, signs; in items also what ends a sentence.
TOKEN = rf"\p{{Lu}}{_LETTERS}*(?:[ \t\n\r]\p{{Lu}}{_LETTERS}*)*|{_LETTERS}+|[0-9]+(?:[.,][0-9]+)*|[{_SIGNS}]+"
END = "[.!?]+"
#: The same tokens for Java: its matcher goes a level deeper for every word or digit group of a run that it could give back, and
#: fails on some thousands; none of them is ever given back, as nothing follows.
_TOKEN = rf"\p{{Lu}}{_LETTERS}*+(?:[ \t\n\r]\p{{Lu}}{_LETTERS}*+)*+|{_LETTERS}++|[0-9]++(?:[.,][0-9]++)*+|[{_SIGNS}]++"
WINDOW, SHORT = 8, 4
#: Plain words that a window needs to match by its template; smaller windows match as they stand.
MIN_LITERAL = {WINDOW: 3, SHORT: 2}
#: Different plain words that a run needs.
MIN_WORDS = {WINDOW: 5, SHORT: 2}
LEAK = 6
READINGS = ("names", "words", "first", "folded")
MAX_BROADCAST = 1_000_000


def _starts(x: Column, first: str, past: str) -> Column:
    return (x >= first) & (x < past)


def _kind(x: Column, own: Column, before: Column) -> Column:
    """Which placeholder stands for token x (own: in lower case) after the token `before`; 0 for a plain word.

    Comparisons of bytes, the commonest case first: this runs for every token."""
    initial = F.substring(x, 1, 1)
    sign = _starts(x, "$", "&") | _starts(x, "£", "¤") | _starts(x, "°", "±") | _starts(x, "€", "₭")
    unit = own.isin(UNITS)
    capital = F.when(x < "{", x >= "A").otherwise(F.lower(initial) != initial)  # below "a" by the first case
    return (
        F.when(_starts(x, "a", "{") & ~unit, 0).when(_starts(x, "0", ":"), NUMBER).when(unit & F.coalesce(_starts(before, "0", ":"), F.lit(False)), UNIT)
        .when(_starts(x, "a", "{"), 0).when(capital, NAME).when(sign, SIGN).otherwise(0)
    )


def _tokens(df: DataFrame, raw: Column, *keep: str, plain: str | None = None) -> DataFrame:
    """The columns keep with own, the tokens in lower case, and code, with placeholders' numbers in their places.
    plain: a column of flags, of tokens that are plain words whatever they look like."""
    df = df.select(*keep, *([plain] if plain else []), raw.alias("raw"))
    df = df.withColumn("own", F.split(F.lower(F.array_join("raw", "\x01")), "\x01"))
    kind = lambda x, o, i: F.when(F.get(plain, i), 0).otherwise(_kind(x, o, F.get("raw", i - 1))) if plain else _kind(x, o, F.get("raw", i - 1))

    def code(x: Column, i: Column) -> Column:
        own = F.get("own", i)
        k = kind(x, own, i)
        return F.when(k == 0, own).otherwise(k.cast("string"))

    return df.withColumn("code", F.transform("raw", code)).drop("raw")


def _windows(tokens: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep, at, h, values) of each window of `width` tokens (own, code, low): its hash, and its tokens. Tokens that
    were folded to lower case (low) have hashes of their own.

    Plain columns only, and few, so that exploding, hashing and joining compile to one short loop."""
    n = F.size("code")
    # outer: for an inner explode, the optimiser would cut the text once more, in a filter
    rows = tokens.select(*keep, "own", "code", "low", F.explode_outer(F.when(n >= width, F.sequence(F.lit(0), n - width))).alias("at"))
    of = lambda name: [F.get(name, F.col("at") + k) for k in range(width)]
    h = F.xxhash64(F.lit(-width), "low", *of("own"))
    if width in MIN_LITERAL:
        rows = rows.select("*", *[c.alias(f"c{k}") for k, c in enumerate(of("code"))])
        literal = sum((F.when(F.col(f"c{k}") > "9", 1).otherwise(0) for k in range(width)), F.lit(0))
        h = F.when(literal >= MIN_LITERAL[width], F.xxhash64(F.lit(width), "low", *[F.col(f"c{k}") for k in range(width)])).otherwise(h)
    return rows.select(*keep, "at", F.when(F.col("at").isNotNull(), h).alias("h"), F.slice("own", F.col("at") + 1, width).alias("values"))


def _readings(items: DataFrame) -> DataFrame:
    """The tokens (own, code) of items (item, text), a row per distinct reading."""
    raw = F.col("raw")
    cut_up = lambda text: F.regexp_extract_all(text, F.lit(f"{_TOKEN}|{END}"), 0)
    items = items.select("item", cut_up(F.col("text")).alias("raw"), cut_up(F.lower("text")).alias("folded"))
    ends = lambda x: F.coalesce(x.rlike(f"^{END}"), F.lit(True))

    def cut(reading: str, x: Column, i: Column) -> Column:
        opens = x.rlike(rf"^\p{{Lu}}{_LETTERS}*$") & ends(F.get(raw, i - 1))  # a single capitalised word
        plain = {"names": F.lit(False), "words": opens, "first": opens & (i == 0), "folded": F.lit(False)}[reading]
        return F.when(~ends(x), F.struct(x.alias("x"), plain.alias("plain")))

    one = lambda reading: F.array_compact(F.transform("folded" if reading == "folded" else "raw", lambda x, i: cut(reading, x, i)))
    each = F.array_distinct(F.array(*[F.struct(F.lit(r == "folded").alias("low"), one(r).alias("t")) for r in READINGS]))
    read = items.select("item", F.explode(each).alias("r")).select("item", "r.low", "r.t").filter(F.size("t") > 0)
    read = read.select("item", "low", F.transform("t", lambda t: t["plain"]).alias("plain"), F.transform("t", lambda t: t["x"]).alias("raw"))
    return _tokens(read, raw, "item", "low", plain="plain")


def _groups(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, g): the groups of the items (item, text); (g, width, windows, slots) of each; (g, h, at) of their windows.

    slots: (at, kind, same) of each placeholder, `same` being the first place with the same filling."""
    rows = _readings(benchmark.filter("item is not null and text is not null"))
    n = F.size("code")
    rows = rows.withColumn("width", F.when(n >= WINDOW, WINDOW).when(n >= SHORT, SHORT).otherwise(n))
    filling = F.zip_with("code", "own", lambda c, o: F.struct(c, o))
    rows = rows.withColumn("filling", filling).withColumn("same", F.transform("filling", lambda f: F.array_position(F.col("filling"), f).cast("int")))
    slots = F.transform("code", lambda c, i: F.struct(i.alias("at"), c.alias("kind"), F.get("same", i).alias("same")))
    rows = rows.select("item", "low", "width", "own", "code", F.filter(slots, lambda s: s["kind"] <= "9").alias("slots"))
    rows = common.materialize(rows)
    parts = None
    for width in _widths(rows):
        part = _windows(rows.filter(F.col("width") == width), width, "item", "width", "slots", "own", "code", "low").drop("values")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.select("item", "width", "slots", "own", "code", "low", F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"))
    parts = parts.groupBy("item", "width", "slots", "own", "code", "low").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "h"))), lambda x: x["h"]).alias("hashes"))
    parts = common.materialize(parts.select("item", F.xxhash64("width", "hashes", "slots").alias("g"), "width", "hashes", "slots"))
    one = parts.drop("item").dropDuplicates(["g"])
    return parts.select("item", "g").distinct(), one.select("g", "width", F.size("hashes").alias("windows"), "slots"), common.materialize(one.select("g", F.posexplode("hashes").alias("at", "h")))


def _widths(rows: DataFrame) -> list[int]:
    return sorted(r["width"] for r in rows.select("width").distinct().collect())  # five at most


def _consistent() -> Column:
    """Whether slots filled alike in the item are filled alike in the document, and different ones differently, and
    the run has enough plain words."""
    places = F.flatten(F.transform("found", lambda x: F.transform(x["values"], lambda v, k: F.struct((x["at"] + k).alias("at"), v.alias("value")))))
    value = F.map_from_entries(F.array_distinct(places))  # overlapping windows agree
    pairs = F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["same"].alias("same"), F.try_element_at(value, s["at"]).alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    n = lambda *names: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(*[p[x] for x in names]))))
    words = F.size(F.array_distinct(F.map_values(F.map_filter(value, lambda at, _: ~F.exists("slots", lambda s: s["at"] == at)))))
    literal = lambda x: F.col("width") - F.size(F.filter("slots", lambda s: (s["at"] >= x["at"]) & (s["at"] < x["at"] + F.col("width"))))
    enough = F.lit(True)  # a window that matched as it stands needs no more words
    for width in MIN_WORDS:
        few = MIN_LITERAL[width]
        exact = F.exists("found", lambda x: literal(x) < few)  # noqa: B023
        enough = F.when(F.col("width") == width, (words >= MIN_WORDS[width]) | exact).otherwise(enough)
    return (n("kind", "same", "value") == n("kind", "same")) & (n("kind", "same", "value") == n("kind", "value")) & enough


def _capitals(docs: DataFrame) -> DataFrame:
    """docs (id, mark, text) with their lines that have capitals only, in lower case, and no others."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"))
    some = docs.filter(F.col("text").rlike(r"(?m)^[^\p{Ll}\n]*\p{Lu}[^\p{Ll}\n]*$"))
    return some.select("id", "mark", F.lower(F.array_join(lines, "\n")).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, mark, item, matched): documents (id, mark, text) that hold benchmark items (item, text)."""
    members, groups, asked = _groups(benchmark)
    keys = asked.select("h").distinct()
    if keys.count() <= MAX_BROADCAST:
        keys = F.broadcast(keys)
    docs = docs.select("id", "mark", "text", F.lit(False).alias("low")).unionByName(_capitals(docs).withColumn("low", F.lit(True)))
    tokens = _tokens(docs, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKEN), 0), "id", "mark", "low")
    hits = None
    for width in _widths(groups) or [WINDOW]:
        one = _windows(tokens, width, "id", "mark").join(keys, "h")
        hits = one if hits is None else hits.unionByName(one)
    hits = common.materialize(hits.groupBy("id", "mark", F.col("at").alias("place"), "h").agg(F.first("values").alias("values")))
    hits = hits.join(asked, "h").select("id", "mark", "g", "at", (F.col("place") - F.col("at")).alias("shift"), "values")
    found = F.collect_list(F.struct("at", "values")).alias("found")  # no more than the item has
    judged = hits.groupBy("id", "mark", "g", "shift").agg(F.count("*").alias("matched"), found).join(groups, "g").filter(_consistent())
    kept = judged.groupBy("id", "mark", "g").agg(F.sum("matched").alias("matched"), F.first("windows").alias("windows"))
    kept = kept.filter(F.col("matched") >= F.least(F.lit(LEAK), F.ceil(F.col("windows") / 2)))
    return kept.join(members, "g").groupBy("id", "mark", "item").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items, matched), a row per row of docs (doc_id, text); benchmark: (item_id, text)."""
    named = docs.select("doc_id", *common.row_id("doc_id", "text"), "text")
    found = leaks(named.drop("doc_id"), benchmark.select(F.col("item_id").alias("item"), "text"))
    found = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"), F.sum("matched").alias("matched"))  # no more than the benchmark has
    empty = F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")
    out = named.select("doc_id", "id", "mark").join(found, ["id", "mark"], "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", empty).alias("items"), F.coalesce("matched", F.lit(0)).alias("matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) that hold no item of benchmark (item_id, text)."""
    rows = docs.select(*common.row_id("doc_id", "text"), F.struct("*").alias("row"))
    found = leaks(rows.select("id", "mark", "row.text"), benchmark.select(F.col("item_id").alias("item"), "text"))
    return rows.join(found.select("id", "mark").distinct(), ["id", "mark"], "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "matched")


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)


def _kind_sql(x: str, before: str) -> str:
    unit = f"coalesce({before}[1] BETWEEN '0' AND '9', false) AND lower({x}) IN ({_UNITS_SQL})"
    return f"CASE WHEN {x}[1] BETWEEN '0' AND '9' THEN {NUMBER} WHEN {unit} THEN {UNIT} WHEN lower({x}[1]) <> {x}[1] THEN {NAME} WHEN contains('{_SIGNS}', {x}[1]) THEN {SIGN} ELSE 0 END"


ORACLE_SQL = f"""
WITH d0 AS (SELECT doc_id AS id, false AS low, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS raw FROM documents
    UNION ALL SELECT doc_id, true, regexp_extract_all(lower(array_to_string(list_filter(string_split(text, chr(10)),
        lambda l: regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}')), chr(10))), '{TOKEN}') FROM documents WHERE text IS NOT NULL),
d AS (SELECT id, low, list_transform(raw, lambda x: lower(x)) AS own, list_transform(range(1, len(raw) + 1), lambda i: {_kind_sql("raw[i]", "raw[i - 1]")}) AS kind FROM d0),
b0 AS (SELECT item_id AS item, reading, regexp_extract_all(CASE WHEN reading = 'folded' THEN lower(text) ELSE text END, '{TOKEN}|{END}') AS raw
    FROM benchmark, (SELECT unnest(['names', 'words', 'first', 'folded']) AS reading) WHERE item_id IS NOT NULL AND text IS NOT NULL),
b1 AS (SELECT item, reading, list_filter(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN NOT regexp_matches(raw[i], '^{END}') THEN {{'x': raw[i],
    'plain': (reading = 'words' OR reading = 'first' AND i = 1) AND regexp_full_match(raw[i], '\\p{{Lu}}{_LETTERS}*') AND (i = 1 OR regexp_matches(raw[i - 1], '^{END}'))}} END), lambda t: t IS NOT NULL) AS t
    FROM b0),
b AS (SELECT item, reading, list_transform(t, lambda e: lower(e.x)) AS own, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].plain THEN 0 ELSE {_kind_sql("t[i].x", "t[i - 1].x")} END) AS kind,
    CASE WHEN len(t) >= 8 THEN 8 WHEN len(t) >= 4 THEN 4 ELSE len(t) END AS width FROM b1 WHERE len(t) > 0),
both_ AS (SELECT 'd' AS side, id, NULL AS reading, low, own, kind, v.width FROM d, (SELECT DISTINCT width FROM b) v UNION ALL SELECT 'b', item, reading, reading = 'folded', own, kind, width FROM b),
win AS (SELECT side, id, reading, low, width, pos, own[pos + 1:pos + width] AS o, kind[pos + 1:pos + width] AS k FROM (SELECT *, unnest(range(0, len(own) - width + 1)) AS pos FROM both_)),
h AS (SELECT side, id, reading, low, width, pos, CASE WHEN width >= 4 AND len(list_filter(k, lambda x: x = 0)) >= CASE width WHEN 8 THEN 3 ELSE 2 END
    THEN 't ' || array_to_string(list_transform(range(1, width + 1), lambda i: CASE WHEN k[i] > 0 THEN CAST(k[i] AS VARCHAR) ELSE o[i] END), ' ') ELSE 'e ' || array_to_string(o, ' ') END AS h FROM win),
n AS (SELECT id AS item, reading, count(*) AS windows FROM h WHERE side = 'b' GROUP BY ALL),
m AS (SELECT DISTINCT x.id, y.id AS item, y.reading, y.width, y.pos, x.pos - y.pos AS shift, starts_with(x.h, 'e ') AS exact FROM h x JOIN h y ON x.h = y.h AND x.width = y.width AND x.low = y.low AND x.side = 'd' AND y.side = 'b'),
a AS (SELECT DISTINCT id, item, reading, width, shift, pos + unnest(range(0, width)) AS p FROM m),
z AS (SELECT a.*, b.kind[p + 1] AS k, b.own[p + 1] AS i, d.own[p + shift + 1] AS v FROM a JOIN b ON a.item = b.item AND a.reading = b.reading JOIN d ON a.id = d.id AND d.low = (a.reading = 'folded')),
y AS (SELECT id, item, reading, shift, count(DISTINCT CASE WHEN k = 0 THEN v END) >= CASE width WHEN 8 THEN 5 WHEN 4 THEN 2 ELSE 0 END AS enough FROM z GROUP BY id, item, reading, shift, width
    HAVING count(DISTINCT CASE WHEN k > 0 THEN (k, i, v) END) = count(DISTINCT CASE WHEN k > 0 THEN (k, i) END) AND count(DISTINCT CASE WHEN k > 0 THEN (k, i, v) END) = count(DISTINCT CASE WHEN k > 0 THEN (k, v) END)),
c AS (SELECT id, item, reading, shift, count(*) AS matched FROM m JOIN y USING (id, item, reading, shift) GROUP BY id, item, reading, shift, enough HAVING enough OR bool_or(exact)),
f AS (SELECT id, item, sum(matched) AS matched FROM c JOIN n USING (item, reading) GROUP BY id, item, reading, windows HAVING sum(matched) >= least(6, ceil(windows / 2))),
g AS (SELECT id, item, max(matched) AS matched FROM f GROUP BY ALL),
r AS (SELECT id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, sum(matched) AS matched FROM g GROUP BY id)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, '') AS items, CAST(coalesce(matched, 0) AS BIGINT) AS matched
FROM documents LEFT JOIN r ON doc_id = id
"""
