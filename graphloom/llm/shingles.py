"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix64

#: Odd multipliers that place a word's hash in a shingle (successive powers of one odd number).
PLACE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of anything but space and \\t-\\r, A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, sorted: of every run of `width` words, or of the whole when it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            h += words[j : n - k + 1 + j] * PLACE[j]
    return np.unique(mix64(h))


def word_hashes(text: bytes | None) -> np.ndarray:
    w = words_of(text) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def batch_shingles(column: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text of an Arrow string column."""
    for text in column.cast(pa.binary()).to_pylist():
        yield shingle_hashes(word_hashes(text), width)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set: equal sets are equal, others differ but for hash collisions."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
