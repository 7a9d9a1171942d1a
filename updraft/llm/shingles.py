"""Word-shingle sets and their min-hash signatures, per document in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5          # words of a shingle
HASHES = 128
WORDS = 100_000    # word hashes kept per worker process
_STEP = np.random.default_rng(20240621)
_PLACES = _STEP.integers(1, 1 << 62, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = (_STEP.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _STEP.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_BLOCK = 2048


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: ASCII lower case, ASCII white space.

    Fewer words than a shingle make one shingle of them all; no words make none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        return ((h * _PLACES[:n]).sum(keepdims=True) + np.uint64(n)) * _PLACES[0]
    s = h[:n - WIDTH + 1] * _PLACES[0]
    for i in range(1, WIDTH):
        s += h[i:n - WIDTH + 1 + i] * _PLACES[i]
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 mixed bits of each of the ``HASHES`` minima over a non-empty set."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _BLOCK):
        np.minimum(low, (x[at:at + _BLOCK] * _FACTORS + _SHIFTS).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0
