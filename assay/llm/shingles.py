"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from assay.llm.words import hashed_texts

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of fewer words, one hash of the whole sequence; of none, none."""
    n = len(h) - k + 1
    if n < 1:
        if not len(h):
            return h
        n, k = 1, len(h)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * MULTIPLIER + h[j : j + n]
    return scrambled(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    (words,) = hashed_texts(pa.array([text], pa.string()))
    return distinct(rolling(words, k))
