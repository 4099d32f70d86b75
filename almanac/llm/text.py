"""Word hashing over Arrow batches, shared by the text operators.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  UTF-8 never
uses those bytes inside a longer character, so working on bytes gives the same
words as working on characters.  All functions are vectorised over a slice of a
batch, and slices are bounded by ``SLICE_BYTES`` (a single longer text makes a
slice of its own), so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # arrays of a slice fit a processor's cache

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row ranges of a binary column.

    Nulls count as empty texts.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word."""
    size = len(data)
    if size == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(size + 1, bool)
    first[off] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:size]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:size]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and, for each text, the index of its first word."""
    s, e, words = word_spans(data, off)
    if len(s) == 0:
        return np.empty(0, np.uint64), words
    if lower:
        data = _LOWER[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power("up", _BASE, len(data)), out=total[1:])
    h = (total[e] - total[s]) * _power("down", _BASE_INV, len(data))[s]
    return mix(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), words


def grams(h: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words that lies in one text, and the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g *= _U(0xA24BAED4963EE407)
        g += h[k:k + m]
    inside = np.ones(m, bool)
    for k in range(1, n):  # a run that starts k words before a text's end leaves it
        last = words[1:] - k
        inside[last[(last >= words[:-1]) & (last < m)]] = False
    at = np.flatnonzero(inside)
    return mix(g[at]), at


_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)


def plain_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for runs of letters and digits without regard to ASCII case.

    All ASCII punctuation separates; bytes of other characters count as letters.
    """
    return word_hashes(_PLAIN[data], off, lower=True)
