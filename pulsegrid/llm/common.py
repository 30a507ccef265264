"""Helpers shared by the text operators: word hashing, shingles and fixed-size id filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Maps every byte that is no letter, digit or part of a non-ASCII character to a space, and A-Z to a-z.
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Slots of the id filter: the largest prime below 2**23, so 1 MB whatever the input size.
FILTER_SLOTS = 8388593


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MUL
    return x ^ (x >> np.uint64(29))


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of lower-cased (A-Z) words.

    Fewer words: the whole sequence is one shingle.  No words: empty.
    """
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    n = len(words)
    if n < size:
        x = np.array([n], np.uint64)
        for w in h:
            x = mix(x * _MUL2 + w)
        return x
    with np.errstate(over="ignore"):
        x = h[: n - size + 1]
        for j in range(1, size):
            x = mix(x * _MUL2 + h[j : n - size + 1 + j])
    return np.unique(x)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A one-hash filter of FILTER_SLOTS bits over the longs in ``column``.

    The driver receives at most FILTER_SLOTS / 64 words, whatever the input; a
    full filter passes everything and stays right, as exact joins follow.
    """
    slot = F.pmod(F.col(column), F.lit(FILTER_SLOTS))
    words = (
        ids.where(F.col(column).isNotNull())
        .select((slot.cast("long")).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_SLOTS // 64 + 1, np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def passes(filter_words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the int64 ``ids`` may be in the filter (the same slots as :func:`id_filter`)."""
    slot = (ids % np.int64(FILTER_SLOTS)).astype(np.uint64)
    return (filter_words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
