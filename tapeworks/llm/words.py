"""Words, their hashes and k-gram hashes, over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import claim, keeps

#: Lower-cases A-Z; 0-9, a-z and all bytes of non-ASCII characters stay; the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Entries that a Python worker keeps of a lookup table before it starts again.
MEMO_ENTRIES = 400_000


class Memo(dict):
    """A bounded lookup table that fills itself."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[key] = self.fn(key)
        return value


_hash = Memo(xxhash.xxh64_intdigest)
keeps("words", _hash.clear)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (in lower case) and non-ASCII characters."""
    return encode(text).translate(WORD_BYTES).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    claim("words")
    return np.fromiter(map(_hash.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> _S)) * _M1 + h[j : j + n]
    return mix(acc)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of w values (ties: all of them).

    Every window keeps at least one position, so two texts that share k + w - 1 words in a row
    share a kept k-gram.
    """
    if len(g) == 0 or w <= 1:
        return np.arange(len(g))
    n = len(g) - w + 1
    if n <= 0:
        return np.flatnonzero(g == g.min())
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    high = np.zeros(len(g), np.uint64)
    for j in range(w):
        np.maximum(high[j : j + n], low, out=high[j : j + n])
    return np.flatnonzero(g == high)
