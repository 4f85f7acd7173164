"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import os

import numpy as np

WORDS = 5
#: Odd 64-bit multipliers, one for each place in a shingle.
_MUL = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(1, WORDS + 1)], dtype=np.uint64)


def words(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words of UTF-8 text, cut at ASCII white space."""
    return text.lower().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each token, the same in every worker.

    Python's hash of bytes is keyed by PYTHONHASHSEED, which Spark sets alike
    for all its workers.
    """
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        raise RuntimeError("PYTHONHASHSEED has to be fixed for all Python workers")
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words none."""
    h = hashes(words(text))
    n = len(h)
    if n == 0:
        return h
    if n < WORDS:
        x = np.uint64(n) * np.ones(1, np.uint64)
        for i in range(n):
            x = mix(x ^ (h[i : i + 1] * _MUL[i]))
        return x
    x = mix(h[: n - WORDS + 1] * _MUL[0])
    for i in range(1, WORDS):
        x = mix(x + h[i : n - WORDS + 1 + i] * _MUL[i])
    return np.unique(x)
