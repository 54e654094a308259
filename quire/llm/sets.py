"""Sets of word shingles as sorted arrays of hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Words of which a worker keeps the hashes.
WORDS_KEPT = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str | bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of so many words (5 at most) of a text; fewer words are one shingle."""
    raw = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
    found = raw.lower().split()
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = min(len(h), size)
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        acc += h[j : len(h) - n + 1 + j] * MULTIPLIERS[j]
    return np.unique(mix(acc))


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())
