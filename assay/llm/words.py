"""Words of whole Arrow columns at once: places and 64-bit hashes, straight from the columns' UTF-8 bytes.

A word's hash is the sum of a random number for each of its bytes at its place (tabulation), so two given words are equal in
hash with a probability of 2 ** -64; words of more than PLACES bytes are hashed by xxhash. Texts are taken in groups of some
GROUP bytes, whole; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PLACES, GROUP = 64, 1 << 15
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
_LOWER = bytes(range(256)).lower()


def is_space(data: np.ndarray) -> np.ndarray:
    """White space of ASCII."""
    return (data == 32) | (data - np.uint8(9) < 5)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings or binaries; offsets start at 0 and have one more entry than the column. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """raw() of some texts at a time, in order."""
    data, offsets = raw(column)
    n, first = len(column), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP, "right")) - 1)
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def slice_hashes(data: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the slices that begin at each start and end at the next; blank bytes count for nothing."""
    if not len(starts):
        return np.empty(0, np.uint64)
    base = int(starts[0])
    at = np.append(starts - base, len(data) - base)
    gap = np.diff(at)
    place = np.arange(at[-1], dtype=np.int32)
    place -= np.repeat(at[:-1].astype(np.int32), gap)
    np.minimum(place, PLACES - 1, out=place)
    place <<= 8
    place |= data[base:]
    value = _TABLE.take(place, mode="wrap")
    if blank is not None:
        value *= ~blank[base:]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    out = np.diff(total[at])
    long = np.flatnonzero(gap > PLACES)
    for k in long.tolist():
        low, high = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else len(data)
        own = data[low:high] if blank is None else data[low:high][~blank[low:high]]
        if len(own) > PLACES:
            out[k] = xxhash.xxh64_intdigest(own.tobytes())
    return out


def hash_of(word: bytes) -> int:
    """What slice_hashes gives for one word."""
    if len(word) > PLACES:
        return xxhash.xxh64_intdigest(word)
    at = np.arange(len(word)) << 8 | np.frombuffer(word, np.uint8)
    return int(_TABLE[at].sum(dtype=np.uint64))


def word_starts(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Where words between blanks begin; none reaches from one text to the next."""
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = ~blank[first]
    return np.flatnonzero(begins)


def word_hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, and where each text's words begin, with the end): words between ASCII white space, A-Z lower-cased."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = is_space(data)
    starts = word_starts(data, offsets, blank)
    return slice_hashes(lowered(data), starts, blank), np.searchsorted(starts, offsets)


def hashed_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's word hashes, in order."""
    for data, offsets in groups(column):
        h, at = word_hashes_of(data, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield h[a:b]


class Finder:
    """Places of hashes in a sorted array: the leading bits give where to start, a few steps the rest."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.bits = max(4, int(len(sorted_hashes) * 2).bit_length())
        self.shift = np.uint64(64 - self.bits)
        lead = (sorted_hashes >> self.shift).astype(np.int64)
        count = np.bincount(lead, minlength=1 << self.bits)
        self.start = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.steps = int(count.max(initial=0))
        self.hashes = np.append(sorted_hashes, ~np.uint64(0))
        self.size = len(sorted_hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where it isn't there."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        out = np.where((self.hashes[at] == h) & (at < self.size), at, -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.steps):
            if not left.size:
                break
            place = np.minimum(at[left] + step, self.size)
            hit = (self.hashes[place] == h[left]) & (place < self.size)
            out[left[hit]] = place[hit]
            left = left[~hit]
        return out
