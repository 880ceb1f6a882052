"""Shared helpers: tables, the shared folder, and numpy kernels that turn Arrow text into word hashes.

The kernels work on the UTF-8 bytes of an Arrow batch, a bounded number of bytes at a time, so that
memory does not depend on the batch; one text is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bound_batches, materialize, shared_dir

__all__ = ["CHUNK_BYTES", "HELD", "WORD", "bound_batches", "few", "grams", "held", "held_out", "SPACE", "materialize", "mix", "pieces", "row_id", "shared_dir", "table", "text_slices", "words"]

#: Bytes of text that the kernels take at once (one text at least).
CHUNK_BYTES = 1 << 19
#: A word, as in all operators here: a run of anything but space, tab, and line breaks 0x0A to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Rows (of two or three numbers) of a table that is broadcast, so that the other side of a join stays where it is.
HELD = 500_000


def few(df: DataFrame, most: int = HELD) -> bool:
    """Whether a written table is small enough to be held by every executor."""
    return df.count() <= most


def held(df: DataFrame, few: bool) -> DataFrame:
    """The table, to be broadcast if it has few rows; else joins deal both sides out."""
    return F.broadcast(df) if few else df


def row_id(doc_id: str, text: str) -> list[Column]:
    """id and mark, which tell rows with different ids or texts apart: the id and the text's hash; a second hash
    of the text stands for a null id."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("id"), F.col(text)))
    return [own.alias("id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("mark")]


#: What parts words, in bytes.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data, apart: re.Pattern, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of one text in pieces of about `size`, cut only at bytes that match `apart`."""
    at, n = 0, len(data)
    view = memoryview(data)
    while at < n:
        found = apart.search(view, min(n, at + size))
        to = found.end() if found else n
        yield view[at:to].tobytes()
        at = to


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets into the bytes), of about CHUNK_BYTES each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        past = min(past, n)
        yield first, past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


_rng = np.random.default_rng(0x5117)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MUL), -1, 2**64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, x in (("up", _MUL), ("down", _INV)):
            powers = np.full(size, x, np.uint64)
            powers[0] = 1
            _powers[key] = np.multiply.accumulate(powers)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, past byte, 64-bit hash) of each word, and the first word of each text (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edge = inside[1:] != inside[:-1]
    first, past = inside[1:] & edge, inside[:-1] & edge
    for o in offsets[1:-1]:  # a text's end is a word's end
        if 0 < o < n and inside[o] and inside[o + 1]:
            first[o] = past[o] = True
    first, past = np.flatnonzero(first), np.flatnonzero(past)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[past] - total[first]) * down[first])
    return first, past, hashes, np.searchsorted(first, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (runs that cross from one text to the next are the caller's to leave out)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])
