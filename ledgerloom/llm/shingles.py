"""Hashed word shingles and minwise signatures of whole texts, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_RNG = np.random.default_rng(20240607)
_WORD_C = _RNG.integers(1, 2**63, size=WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CACHE_WORDS = 300_000


class _WordHashes(dict):
    """64-bit hashes of words; cleared when it holds _CACHE_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles (ASCII-lower-cased words); with
    fewer words, of the whole sequence; empty without words."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    if n < WIDTH:
        h = (ids * _WORD_C[:n]).sum(dtype=np.uint64, keepdims=True) + _WORD_C[WIDTH] * np.uint64(n)
    else:
        h = sum((ids[k:n - WIDTH + 1 + k] * _WORD_C[k] for k in range(WIDTH)), np.zeros(n - WIDTH + 1, dtype=np.uint64))
    return np.unique(mix(h))


class Signer:
    """``size`` minwise values of a set of 64-bit hashes, as unsigned 32-bit integers."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, size=(size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size=(size, 1), dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**32 - 1, dtype=np.uint64)
        for at in range(0, len(hashes), 4096):
            x = self.a * hashes[at:at + 4096] + self.b
            low = np.minimum(low, (x >> np.uint64(32)).min(axis=1))
        return low.astype(np.uint32)


def binned(hashes: np.ndarray, bins: int = 512) -> np.ndarray:
    """One-permutation sketch of a set: per bin a byte (1 to 255) of the least hash that falls into it, 0 for an empty bin."""
    out = np.zeros(bins, dtype=np.uint8)
    if len(hashes):
        h = np.sort(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        at, first = np.unique(h % np.uint64(bins), return_index=True)  # the first of a sorted run is its least
        out[at.astype(np.int64)] = (mix(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two sets of ``shingles``."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
