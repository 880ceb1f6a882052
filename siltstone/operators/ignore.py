"""Ignore files: rule tables of nested folders and families, and the paths that they leave out.

A rule belongs to the folder of its file and speaks of paths below it. Within one file the last rule that matches
a path decides; a path under a folder that the file ignores is ignored, whatever the file says of the path itself.
The files of one family are layers from the root down, of which the deepest that has a say decides. Families add
up: what any of them ignores is left out, so a negation undoes rules of its own family only. A path is left out
if it or any folder above it is ignored.

Every distinct folder is judged once, however many files it holds. Rules meet paths by the folder that they belong
to, and patterns are compiled to regular expressions by column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policies as P

#: Names of ignore files, a family each, in the order in which their reasons are given.
FAMILIES = (".ignore", ".gitignore")
#: Larger ignore files count as absent (a fixed value).
MAX_RULE_BYTES = 256 << 10
#: Pieces of a pattern: folders in any number, runs of stars, one character, classes, escapes, plain characters.
_PIECES = r"^\*\*/|/\*\*$|(?:/\*\*)+/|\*+|\?|\[[!^]?\]?(?:\\.|[^\]\\])*\]|\\.|."


def _literal(x: Column) -> Column:
    return F.regexp_replace(x, r"([^\p{L}\p{N}_])", r"\\$1")


def _piece(x: Column) -> Column:
    """One piece of a pattern as a regular expression."""
    body = F.regexp_replace(F.regexp_extract(x, r"(?s)^\[(.*)\]$", 1), "^!", "^")
    backwards = F.exists(F.regexp_extract_all(body, F.lit(r"[^\\]-[^\]]"), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
    some = F.concat(F.lit("(?!/)["), F.regexp_replace(F.regexp_replace(body, r"^(\^?)\]", r"$1\\]"), r"([\[&])", r"\\$1"), F.lit("]"))
    return (
        F.when(x == "**/", "(?:.*/)?").when(x == "/**", "/.+").when(x.rlike(r"^(?:/\*\*)+/$"), "(?:/.*)?/").when(x.rlike(r"^\*+$"), "[^/]*").when(x == "?", "[^/]")
        .when((F.length(x) > 2) & x.startswith("["), F.when(backwards, "(?!)").otherwise(some))
        .when((F.length(x) == 2) & x.startswith("\\"), _literal(F.substring(x, 2, 1))).otherwise(_literal(x))
    )


def compiled(pattern: Column) -> Column:
    """The regular expression that whole paths (relative, without a slash at the end) match, of a pattern without `!` and last slash."""
    anchored = F.contains(pattern, F.lit("/"))
    pieces = F.transform(F.regexp_extract_all(F.regexp_replace(pattern, "^/", ""), F.lit(f"(?s){_PIECES}"), F.lit(0)), _piece)
    return F.concat(F.when(anchored, "(?is)^").otherwise("(?is)^(?:.*/)?"), F.array_join(pieces, ""), F.lit("$"))


def rules(files: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(family, base, depth, line, negated, folders, regex): the rules of ignore files (path, content as bytes); family is a
    number in the order of families, base the file's folder.

    Files that are too large, binary, not UTF-8, or sensitive by their path give no rules; so do blank lines, comments,
    and patterns that end in a lone backslash."""
    name = F.element_at(F.split("path", "/"), -1)
    base = F.regexp_replace("path", "/?[^/]*$", "")
    family = F.array_position(F.array(*[F.lit(x) for x in families]), name) - 1
    rows = files.filter(name.isin(*families) & (F.length("content") <= MAX_RULE_BYTES) & ~P.is_sensitive(F.col("path")))
    rows = rows.filter(~P.looks_binary(F.col("content")) & F.is_valid_utf8("content")).select(family.cast("int").alias("family"), base.alias("base"), F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text"))
    rows = rows.select("family", "base", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    # an escaped space at the end stays, others go
    kept = F.when(F.col("raw").rlike(r"(?:^|[^\\])(?:\\\\)*\\\s+$"), F.regexp_replace("raw", r"\\\s+$", r"\\ ")).otherwise(F.regexp_replace("raw", r"\s+$", ""))
    rows = rows.withColumn("p", kept).filter((F.col("p") != "") & ~F.col("p").startswith("#") & ~F.col("p").rlike(r"(?:^|[^\\])(?:\\\\)*\\$"))
    rows = rows.withColumn("negated", F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", "^!", ""))
    rows = rows.withColumn("folders", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/$", "")).filter("p != ''")
    return rows.select("family", "base", _depth("base").alias("depth"), "line", "negated", "folders", compiled(F.col("p")).alias("regex"))


def _depth(path: str) -> Column:
    return F.when(F.col(path) == "", 0).otherwise(F.size(F.split(path, "/")))


def _above(path: str) -> Column:
    """All folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def ignored(paths: DataFrame, table: DataFrame) -> DataFrame:
    """(path, at, family) of paths (path) that rules (see `rules`) leave out: the highest folder, or the path itself, that is
    ignored, and the first family that ignores it."""
    leaves = paths.select("path").distinct()
    nodes = leaves.select("path", F.explode(F.concat(F.filter(_above("path"), lambda x: x != ""), F.array("path"))).alias("node"))
    distinct = nodes.select("node", (F.col("node") != F.col("path")).alias("folder")).distinct()
    # what each file says of each path below it, by itself
    below = distinct.select("node", "folder", F.explode(_above("node")).alias("base"))
    below = below.withColumn("local", F.when(F.col("base") == "", F.col("node")).otherwise(F.expr("substring(node, length(base) + 2)")))
    met = below.join(table, "base").filter((~F.col("folders") | F.col("folder")) & F.expr("local rlike regex"))
    said = met.groupBy("node", "folder", "base", "depth", "family").agg(F.max_by("negated", "line").alias("negated"))
    # and with the folders above it that the file ignores
    closed = said.filter("folder and not negated").select(F.col("node").alias("up"), "base", "depth", "family")
    inherited = distinct.select("node", "folder", F.explode(F.filter(_above("node"), lambda x: x != "")).alias("up")).join(closed, "up")
    inherited = inherited.select("node", "folder", "base", "depth", "family", F.lit(False).alias("negated"))
    layers = said.select(*inherited.columns).unionByName(inherited).groupBy("node", "folder", "base", "depth", "family").agg(F.bool_and("negated").alias("negated"))
    decided = layers.groupBy("node", "folder", "family").agg(F.max_by("negated", "depth").alias("negated")).filter("not negated")
    first = decided.groupBy("node", "folder").agg(F.min("family").alias("family"))
    hits = nodes.withColumn("folder", F.col("node") != F.col("path")).join(first, ["node", "folder"])
    return hits.groupBy("path").agg(F.min(F.struct(F.length("node"), F.col("node").alias("at"), "family")).alias("x")).select("path", "x.at", "x.family")
