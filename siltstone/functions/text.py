"""Column functions on text: normalising, splitting identifiers, counting terms, estimating tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates the parts of an identifier (fixed value).
SEPARATORS = r"[\s_./\\:@$-]+"
#: A word of source text (fixed value).
SOURCE_TOKEN = r"[\p{L}\p{N}_$@.-]+"
#: Where an ASCII word begins or ends: Java's own \b also takes letters beyond ASCII for parts of words.
WORD_END = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def speaks_of(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in the text, whatever the case, with \\b between ASCII words and all else."""
    return text.rlike("(?iu)" + pattern.replace(r"\b", WORD_END))


def round6(x: Column) -> Column:
    """Six decimals, halves towards plus infinity."""
    return F.floor(x * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)


def normalize_term(x: Column) -> Column:
    """Backslashes to slashes, white space collapsed and trimmed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\", "/"), r"[\s 　]+", " "), "^ | $", ""))


def split_identifier(x: Column) -> Column:
    """Distinct lower-cased parts, first by separators, then by changes of case; in order of appearance."""
    camel = F.regexp_replace(F.regexp_replace(x, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.concat(F.split(x, SEPARATORS), F.split(camel, SEPARATORS))
    return F.array_distinct(F.filter(F.transform(parts, normalize_term), lambda p: p != ""))


def word_variants(x: Column) -> Column:
    """Plain stems of an English word of five letters or more (-ing, -ied, -ed, -ies, -es, -s)."""
    n = F.length(x)
    cut = lambda k: F.substring(x, F.lit(1), n - k)
    none = F.array().cast("array<string>")
    past = F.when(x.endswith("ied") & (n > 5), F.array(F.concat(cut(3), F.lit("y")))).when(x.endswith("ed") & (n > 5), F.array(cut(2), cut(1))).otherwise(none)
    plural = F.when(x.endswith("ies") & (n > 5), F.array(F.concat(cut(3), F.lit("y")))).when(x.endswith("es") & (n > 5), F.array(cut(2), cut(1))).when(x.endswith("s") & (n > 4), F.array(cut(1))).otherwise(none)
    ing = F.when(x.endswith("ing") & (n > 6), F.array(cut(3), F.concat(cut(3), F.lit("e")))).otherwise(none)
    found = F.filter(F.array_distinct(F.concat(ing, past, plural)), lambda v: F.length(v) >= 3)
    return F.when(x.rlike("^[a-z]{5,}$"), found).otherwise(none)


def measure(x: Column) -> tuple[Column, Column, Column]:
    """ASCII characters (without line breaks), bytes of other characters, and line breaks: they add up over parts of a text."""
    text = F.regexp_replace(x, "\r\n?", "\n")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) - breaks
    return ascii_, F.octet_length(text) - ascii_ - breaks, breaks


def estimate_tokens(x: Column) -> Column:
    """A third of the ASCII characters, half of the other bytes (both rounded up), the line breaks, and one; 0 if empty."""
    ascii_, other, breaks = measure(x)
    return F.when(F.length(x) == 0, 0).otherwise(F.ceil(ascii_ / 3) + F.ceil(other / 2) + breaks + 1).cast("long")


def logical_lines(x: Column) -> Column:
    """The lines of a text: any line break counts, one at the end adds no line, an empty text has one line."""
    lines = F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n", -1)
    n = F.size(lines)
    return F.when((n > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), n - 1)).otherwise(lines)


def substring_count(text: Column, term: Column, most: int = 3) -> Column:
    """Occurrences of a term that don't overlap, `most` at most."""
    cut = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) == 0, 0).otherwise(F.least(F.lit(most), (cut / F.length(term)).cast("int")))


def hub_damping(degree: Column) -> Column:
    return F.when(degree <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.log2(F.lit(3.0)) / F.log2(F.lit(2.0) + degree)))


def longest_backticks(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit("`+"), 0), F.length)), F.lit(0))


def fenced(x: Column) -> Column:
    """The text in a code fence that is longer than any run of backticks inside."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backticks(x) + 1))
    return F.concat(fence, F.lit("\n"), x, F.lit("\n"), fence)


def redact_paths(x: Column) -> Column:
    """Absolute paths (POSIX, drive, UNC, file:) to a placeholder; web addresses stay."""
    path = r"(?<![\w/:.])(?:file:/+|[A-Za-z]:[\\/]|\\\\|/(?=[\w.-]+/))[^\s\"'`<>|]+"
    return F.regexp_replace(x, path, "<path>")


def bounded_text(x: Column, most: int) -> Column:
    """Control characters to U+FFFD, cut with an ellipsis to `most` characters."""
    clean = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "�")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 1), F.lit("…"))).otherwise(clean)


def hashed_id(prefix: str, digits: int, *fields: Column) -> Column:
    """prefix_ and the first digits of the SHA-256 of the fields, joined by NUL; null counts as empty."""
    joined = F.concat_ws("\x00", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, digits))
