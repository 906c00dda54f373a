"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: fixed value: the characters that end a word (blank and code points 9 to 13), as a regex class body
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8. ``bytes.split`` cuts at exactly ``BLANKS``."""
    return text.encode().translate(LOWER).split() if text else []


_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.frombuffer(LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def text_chunks(texts: pa.Array, size: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and offsets of stretches of an Arrow string column, about ``size`` bytes or one text each."""
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z lower-cased, and the number of words of each text.

    A word's hash is a sum over its bytes of a random number of the byte times one of the place, which numpy makes for all
    words at once.
    """
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    inside = ~_BLANK[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[1:-1] = inside[1:] & ~inside[:-1]
    first[offsets[:-1]] = True  # a text begins a word if its first byte is not blank
    first = first[:-1] & inside
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    size = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], size)
    value = _BYTE[_FOLD[raw[starts[0]:]]] * _PLACE[place & 4095]
    if size.max() > 4096:
        value *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[~inside[starts[0]:]] = 0
    length = np.add.reduceat(inside[starts[0]:].astype(np.int64), starts - starts[0])
    found = mixed(np.add.reduceat(value, starts - starts[0]) + length.astype(np.uint64))
    return found, np.diff(np.searchsorted(starts, offsets))


def hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of the given words (none of them empty or with blanks)."""
    return word_hashes(raw := np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(raw)]))[0]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of ``size`` words, in order. Fewer words make one shingle, none make none."""
    size = min(size, len(words))
    if not size:
        return words
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group (0 for the first).

    ``chunk`` must sort like ``order``. Windows hold one chunk of a group; between chunks travels one row each.
    """
    inner = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    heads = (df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
             .select(*keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_head")))
    return (df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(heads, keys + [chunk])
            .withColumn(name, F.col("_in") + F.col("_head")).drop("_in", "_head"))
