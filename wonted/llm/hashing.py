"""64-bit hashes of words, word shingles and byte grams, computed with numpy inside tasks.

A word's hash is a polynomial in its bytes modulo 2^64 with a random value per byte, read off running sums, then
mixed.  Upper-case ASCII letters share the values of the lower-case ones.  Such polynomials take certain pairs of
strings of about 1,000 bytes for equal whatever the values are, so words of more than ``LONG`` bytes are digested instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longest word whose hash is the polynomial.
LONG = 64
#: Bytes handled at a time, so that all arrays stay in cache; a longer document is a chunk of its own.
CHUNK = 1 << 19
BASE = 0xC2B2AE3D27D4EB4D | 5
WHOLE = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] = np.arange(97, 123)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 .. BASE^(n-1) and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def running(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[b] - c[a] = sum of values[data[i]] * BASE^i for a <= i < b."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=c[1:])
    return c


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; nulls must have been replaced."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the chunk, and the first word of each document (n + 1 entries).

    offsets: of the documents in data, from 0 to len(data).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    ink = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    c = running(data, FOLDED_VALUES)
    h = mix((c[b] - c[a]) * powers(len(data))[1][a])
    for i in np.flatnonzero(b - a > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(FOLDED[data[a[i] : b[i]]].tobytes(), digest_size=8).digest(), "little")
    return h, a, b, np.searchsorted(a, offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; shorter texts are one shingle as a whole."""
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += h[i : i + n] * PLACE[i]
    s = mix(s)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            length = PLACE[k + b - a : k + b - a + 1]
            yield mix(np.sum(h[a:b] * PLACE[: b - a], dtype=np.uint64, keepdims=True) + length)
        else:
            yield np.zeros(0, np.uint64)
