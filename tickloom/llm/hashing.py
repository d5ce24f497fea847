"""Vectorised hashing of words and word shingles, shared by the operators that work on whole texts.

A word is a maximal run of bytes other than ASCII white space (space, tab, line feed, vertical tab,
form feed, carriage return) of the UTF-8 text.  Hashes are fixed: they depend on nothing but the bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes, end exclusive) of the words of one byte array."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, or of the ``spans`` that are given, with their byte spans."""
    a = np.frombuffer(data, np.uint8)
    start, end = word_spans(a) if spans is None else spans
    if not len(start):
        return np.empty(0, np.uint64), start, end
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _powers(_P, len(a)), out=run[1:])
    return mix((run[end] - run[start]) * _powers(_P_INV, len(a))[start]), start, end


def batches(texts, limit: int = 1 << 18):
    """Groups of consecutive texts of about ``limit`` bytes: (first index, list of UTF-8 byte strings)."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        group.append(b)
        size += len(b)
        if size >= limit:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def hashed_words(texts, lower: bool = True):
    """Yields for each text (in order) the hashes of its words; nulls count as empty."""
    for _, group in batches(texts):
        joined = b" ".join(group)
        h, start, _ = word_hashes(joined.lower() if lower else joined)
        at = np.cumsum([0, *(len(b) + 1 for b in group)])
        cut = np.searchsorted(start, at)
        for i in range(len(group)):
            yield h[cut[i] : cut[i + 1]]


_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return mix(np.sum(words * _STEP[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mix(total + np.uint64(k)))
