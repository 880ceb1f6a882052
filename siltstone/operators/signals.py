"""Task texts to typed query signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
LOW_VALUE = ["a", "an", "bug", "change", "could", "fix", "make", "please", "should", "the", "this", "update"]
FILE_EXTENSIONS = [
    "cjs", "css", "cts", "html", "ini", "java", "js", "json", "jsx", "md", "mjs", "mts", "py", "rb", "rs", "scss", "sh", "sql",
    "toml", "ts", "tsx", "txt", "xml", "yaml", "yml",
]
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
PHRASE = r"(?i)\b(?:BEGIN\s+IMMEDIATE|SELECT\s+FOR\s+UPDATE)\b"
PATH = r"(?:[\p{L}\p{N}_$@.-]+[\\/])+(?:[\p{L}\p{N}_$@.-]+)"
QUOTED = "([\"'`])([^\"'`\\r\\n]{1,256})\\1"
MAX_BYTES, MAX_SIGNALS, MAX_LENGTH = 16_384, 256, 256
DERIVED = 0.72


def kind_of(token: Column) -> Column:
    last = F.lower(F.element_at(F.split(token, r"\."), -1))
    return (
        F.when(T.normalize_term(token) == "", None)
        .when(token.rlike(CJK), "CJK_TERM")
        .when(token.rlike("^[0-9]{3,}$"), "NUMBER_LITERAL")
        .when(token.rlike("^(?:HTTP_[0-9]{3}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)$"), "ERROR_LITERAL")
        .when(token.rlike("(?i)^(?:true|false|null|undefined)$"), "CODE_LITERAL")
        .when(token.contains("/") | token.contains("\\"), "PATH")
        .when(token.contains(".") & last.isin(FILE_EXTENSIONS), "FILE_NAME")
        .when(token.contains(".") & token.rlike(r"[\p{Lu}_-]"), "QUALIFIED_IDENTIFIER")
        .when(token.contains("."), "DOTTED_IDENTIFIER")
        .when(token.rlike(r"[_-]|[\p{Ll}\p{N}]\p{Lu}|^\p{Lu}[\p{L}\p{N}]*\p{Ll}"), "IDENTIFIER")
        .otherwise("NATURAL_TERM")
    )


def signals(tasks: DataFrame) -> DataFrame:
    """(task_id, kind, value, normalized, origin, derived_from, low_value) of tasks (task_id, text).

    A signal is unique by kind, normalised form and origin. Of explicit tokens alike but for case the last in
    reading order names the signal; of several tokens that one is derived from, the least. Blank tasks and
    those over MAX_BYTES give none."""
    text = F.regexp_replace("text", CONTROL, " ")
    tasks = tasks.filter((F.octet_length("text") <= MAX_BYTES) & (F.trim(text) != "")).select("task_id", text.alias("text"))
    found = []
    for order, (pattern, group, kind) in enumerate([(PHRASE.replace(r"\b", T.WORD_END), 0, "CODE_LITERAL"), (PATH, 0, "PATH"), (QUOTED, 2, None), (T.SOURCE_TOKEN, 0, None)]):
        tokens = tasks.select("task_id", F.lit(order).alias("pass"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), group)).alias("at", "value"))
        named = F.lit(kind) if kind else F.coalesce(kind_of(F.col("value")), F.lit("CODE_LITERAL") if order == 2 else F.lit(None))
        found.append(tokens.withColumn("kind", named))
    tokens = found[0]
    for more in found[1:]:
        tokens = tokens.unionByName(more)
    tokens = tokens.filter("kind is not null").withColumn("normalized", T.normalize_term(F.col("value")))
    explicit = tokens.groupBy("task_id", "kind", "normalized").agg(F.max_by("value", F.struct("pass", "at")).alias("value"))
    parts = explicit.select("task_id", F.col("value").alias("derived_from"), "normalized", F.explode(T.split_identifier(F.col("value"))).alias("part"))
    parts = parts.filter((F.col("part") != F.col("normalized")) & ((F.length("part") >= 2) | F.col("part").rlike(CJK)))
    parts = parts.select("task_id", F.when(F.col("part").rlike(CJK), "CJK_TERM").otherwise("IDENTIFIER").alias("kind"), F.col("part").alias("normalized"), "derived_from")
    variants = explicit.filter("kind = 'NATURAL_TERM'").select("task_id", "kind", F.explode(T.word_variants(F.col("normalized"))).alias("v"), F.col("value").alias("derived_from"))
    derived = parts.unionByName(variants.withColumnRenamed("v", "normalized"))
    derived = derived.groupBy("task_id", "kind", "normalized").agg(F.min("derived_from").alias("derived_from")).withColumn("value", F.col("normalized")).withColumn("origin", F.lit("DERIVED"))
    explicit = explicit.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).withColumn("derived_from", F.lit(None).cast("string")).withColumn("origin", F.lit("EXPLICIT"))
    out = explicit.unionByName(derived).filter(F.length("normalized").between(1, MAX_LENGTH))
    return out.withColumn("low_value", F.col("normalized").isin(LOW_VALUE)).select("task_id", "kind", "value", "normalized", "origin", "derived_from", "low_value")


def factor() -> Column:
    """0 for low-value signals, less for derived ones."""
    return F.when(F.col("low_value"), 0.0).when(F.col("origin") == "DERIVED", DERIVED).otherwise(1.0)


def diagnostics(tasks: DataFrame) -> DataFrame:
    """(task_id, n_signals, low_information, too_large, too_many, control_characters) of every task."""
    counted = signals(tasks).groupBy("task_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("low_value") & (F.length("normalized") >= 2)).alias("informs"))
    size = F.length("text") - F.length(F.regexp_replace("text", CONTROL, ""))
    out = tasks.select("task_id", (F.octet_length("text") > MAX_BYTES).alias("too_large"), size.alias("control_characters")).join(counted, "task_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("task_id", n.alias("n_signals"), (~F.coalesce("informs", F.lit(False))).alias("low_information"), "too_large", (n > MAX_SIGNALS).alias("too_many"), "control_characters")
