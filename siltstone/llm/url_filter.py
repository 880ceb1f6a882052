"""URL filtering: stated rules first, association rules mined by FP-growth for the rest.

A URL becomes a set of tokens: the labels of its host, the parts of its path without digits, and the
names in its query string.  Spark's FP-growth mines frequent token sets from labelled URLs, with the label
as one more item; sets that imply "block" with enough confidence and support become rules, and rules that
contain another rule are pruned, as they can match nothing more.  Tokens below the support take no part, and tokens
that occur in exactly the same labelled URLs are mined as one, so that a long path does not become all its subsets; a
rule then holds a list of such tokens in each place, of which any will do, as each makes a rule of the same figures.
Rules match by an inverted index from each rule's rarest place: rules of up to MAX_LITERAL tokens go into the expression, so
matching is a narrow step without a shuffle; more are joined with the tokens of the distinct token sets.

In op9 the labels come from the stated rules, as no table labels URLs: URLs that a rule decides are the labelled
ones, so what is mined mostly says what those rules say, for other hosts; it judges the URLs that no rule decides.

Defined cases: a null url, or one without `://`, has an empty host and path and no token; it matches no
rule and is allowed; repeated rows are judged alike; of rules that fit, the longest wins (they can't tie);
without labelled URLs nothing is mined; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict), as the contract of op9 states them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Places of a rule, and tokens of rules that are looked up within an expression.
MAX_ANTECEDENT, MAX_LITERAL = 3, 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: str) -> Column:
    """Sorted distinct tokens: h:label, p:part, q:name."""
    hosts = F.transform(F.filter(F.split(host_of(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(hosts, parts, F.transform(names, lambda x: F.concat(F.lit("q:"), x)))))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the path's start."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule): token sets that imply a block, from labelled (tokens, verdict); none contains another. A rule is an array
    of places, each an array of tokens of which one must be there."""
    rows = common.materialize(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("row")))
    least = F.ceil(F.lit(min_support * rows.count()))
    tokens = rows.select("row", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"x{i}") for i in range(2)]  # tells sets of rows apart
    often = tokens.groupBy("token").agg(F.count("*").alias("n"), *where).filter(F.col("n") >= least)
    places = common.materialize(often.groupBy("n", "x0", "x1").agg(F.array_sort(F.collect_list("token")).alias("place")).select("place", F.col("place")[0].alias("first")))
    # a row keeps the first token of each place: the others are there too
    items = tokens.join(places.select(F.col("first").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    items = rows.join(items, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    items = common.materialize(items)
    if items.isEmpty():
        return places.select(F.array("place").alias("rule")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    block = F.col("consequent")[0] == "=block"
    found = model.associationRules.filter(block & (F.size("antecedent") <= MAX_ANTECEDENT) & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = common.materialize(found.select(F.array_sort("antecedent").alias("rule")).distinct())
    # sub-sets of a rule: all but one token, and one alone (three tokens at most)
    all_but_one = F.transform("rule", lambda _, i: F.filter("rule", lambda _, j: j != i))
    fewer = F.concat(all_but_one, F.transform("rule", lambda x: F.array(x)))
    wider = found.select("rule", F.explode(F.array_distinct(fewer)).alias("part")).filter(F.size("part").between(1, F.size("rule") - 1))
    wider = wider.join(found.withColumnRenamed("rule", "part"), "part", "left_semi").select("rule").distinct()
    least = found.join(wider, "rule", "left_anti").select("rule", F.explode("rule").alias("first"))
    whole = least.join(places, "first").groupBy("rule").agg(F.array_sort(F.collect_list("place")).alias("places"))  # three at most
    return common.materialize(whole.select(F.col("places").alias("rule")))


def _indexed(rules: DataFrame) -> DataFrame:
    """(token, rule): each rule under the tokens of its rarest place (in the rules), ties to the first."""
    places = rules.select("rule", F.explode("rule").alias("place"))
    often = places.groupBy("place").agg(F.count("*").alias("n"))
    best = places.join(often, "place").groupBy("rule").agg(F.min(F.struct("n", "place")).alias("x"))
    return best.select(F.explode("x.place").alias("token"), "rule")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with a column tokens) with matched: whether all tokens of any rule (rule) are there."""
    index, n = _indexed(rules), rules.select(F.explode(F.flatten("rule"))).count()
    if not n:
        return urls.withColumn("matched", F.lit(False))
    within = lambda rule, tokens: F.forall(rule, lambda place: F.arrays_overlap(place, tokens))
    if n <= MAX_LITERAL:
        held: dict[str, list[list[list[str]]]] = {}
        for r in index.collect():
            held.setdefault(r["token"], []).append([list(place) for place in r["rule"]])
        under = F.from_json(F.lit(json.dumps(held)), "map<string,array<array<array<string>>>>")
        found = F.flatten(F.transform("tokens", lambda t: F.coalesce(under[t], F.array().cast("array<array<array<string>>>"))))
        return urls.withColumn("matched", F.exists(found, lambda r: within(r, F.col("tokens"))))
    sets = urls.select("tokens").distinct()
    hits = sets.withColumn("token", F.explode("tokens")).join(index, "token").filter(within(F.col("rule"), F.col("tokens")))
    hits = hits.select("tokens").distinct().withColumn("_hit", F.lit(True))
    return urls.join(hits, "tokens", "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """urls (with a column url) with host, path, rule and verdict; labelled (url, verdict) is what to mine,
    by default the URLs that the stated rules decide."""
    row = F.struct(*[c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]).alias("row")  # beside it no name can clash
    seen = urls.select(row, host_of("url").alias("host"), path_of("url").alias("path"), tokens_of("url").alias("tokens"))
    seen = seen.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
    known = seen.filter("stated is not null").select("tokens", "stated.verdict") if labelled is None else labelled.select(tokens_of("url").alias("tokens"), "verdict")
    seen = matched(seen, mine(known))
    mined = F.when(F.col("matched"), "block").otherwise("allow")
    return seen.select("row.*", "host", "path", F.col("stated.rule").alias("rule"), F.coalesce(F.col("stated.verdict"), mined).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS stated FROM r),
t AS (SELECT DISTINCT k, stated, t FROM (
    SELECT k, stated, 'h:' || unnest(list_filter(string_split(host, '.'), lambda x: x <> '')) AS t FROM v
    UNION ALL SELECT k, stated, 'p:' || unnest(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]'))) FROM v
    UNION ALL SELECT k, stated, 'q:' || unnest(list_filter(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> '')) FROM v)),
n AS (SELECT count(*) AS n, ceil(count(*) * 0.01) AS least FROM v WHERE stated IS NOT NULL),
f AS (SELECT t FROM t WHERE stated IS NOT NULL GROUP BY t HAVING count(*) >= (SELECT least FROM n)),
g AS (SELECT t.* FROM t JOIN f USING (t)),
s AS (SELECT k, stated, [t] AS items FROM g
    UNION ALL SELECT a.k, a.stated, [a.t, b.t] FROM g a JOIN g b ON a.k = b.k AND a.t < b.t
    UNION ALL SELECT a.k, a.stated, [a.t, b.t, c.t] FROM g a JOIN g b ON a.k = b.k AND a.t < b.t JOIN g c ON a.k = c.k AND b.t < c.t),
m AS (SELECT items FROM s WHERE stated IS NOT NULL GROUP BY items
    HAVING count(*) FILTER (WHERE stated = 'block') >= (SELECT least FROM n)
       AND count(*) FILTER (WHERE stated = 'block') >= 0.9 * count(*)),
b AS (SELECT DISTINCT k FROM s JOIN m USING (items))
SELECT page_id, host, path, rule, coalesce(stated, CASE WHEN k IN (SELECT k FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""
