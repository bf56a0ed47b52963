"""Token ids of whole texts by the tokenizers library, whose answers for recurring stretches of text are remembered.

A byte-level vocabulary cuts a text into pieces before it merges bytes. A piece never reaches across a single space
between two printable characters: it ends before that space and the next one starts with it. And it never holds two kinds of
ASCII letters, digits and signs, but where an apostrophe stands. So a text is cut at these places into units, its ids are its
units' ids one after another, and a unit's ids need the library only once. Columns are cut
as a whole, from their UTF-8 bytes; units are told apart by 64-bit hashes of their bytes, so two given units are taken for one
another with a probability of 2 ** -64. New units of Latin letters, digits and common signs are cut into pieces here by the
library's rule; anything else is cut by its own pre-tokenizer. Texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from assay.llm.common import remember
from assay.llm.words import groups, slice_hashes

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = r"!-&(-/:-@\[-`{-~"  # ASCII signs but the apostrophe, with which contractions start
PLAIN = re.compile(rf"(?:[{LETTERS}0-9{SIGNS}]|\n(?!\n))+")
CUT = re.compile(rf"[{LETTERS}]+|[0-9]+|[{SIGNS}]+|\n")

_SOLID: np.ndarray | None = None


def solid() -> np.ndarray:
    """For each code point under 65536: is it a letter or a printable ASCII sign?"""
    global _SOLID
    if _SOLID is None:
        _SOLID = np.array(["!" <= c <= "~" or c.isalpha() for c in map(chr, range(1 << 16))])
    return _SOLID


#: ASCII letters, digits, and signs but the apostrophe.
_KIND = np.array([1 if c.isalpha() else 2 if c.isdigit() else 3 if "!" <= c <= "~" and c != "'" else 0 for c in map(chr, range(128))] + [0] * 128, np.uint8).tobytes()


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in texts of single spaces between two solid characters, and of ASCII characters of another kind than the one before.

    Characters beyond 16 bits count as not solid."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
    change = change[~edge[change]]
    at = np.flatnonzero(data == 32)
    at = at[~edge[at] & ~edge[at + 1]]
    ok, known = np.ones(len(at), bool), solid()
    for step in (-1, 1):
        near = data[at + step]
        ok &= ((near > 32) & (near < 127)) | (near >= 128)
        odd = np.flatnonzero(ok & (near >= 128))
        if odd.size:
            i = at[odd]
            if step > 0:
                a = near[odd].astype(np.int64)
                b, c = data[i + 2].astype(np.int64), data[np.minimum(i + 3, len(data) - 1)].astype(np.int64)
            else:
                c, b, a = near[odd].astype(np.int64), data[i - 2].astype(np.int64), data[np.maximum(i - 3, 0)].astype(np.int64)
                two = b >= 0xC0
                a, b = np.where(two, b, a), np.where(two, c, b)
            point = np.where((a >= 0xC0) & (a < 0xE0), (a & 31) << 6 | b & 63, np.where((a >= 0xE0) & (a < 0xF0), (a & 15) << 12 | (b & 63) << 6 | c & 63, 0))
            ok[odd] = known[point]
    return np.concatenate([at[ok], change])


class Units:
    """Ids by 64-bit hash, in open addressing: at most ``most`` units, or ``most_ids`` ids, then all are forgotten."""

    def __init__(self, dtype: np.dtype, most: int, most_ids: int):
        self.dtype, self.most, self.most_ids = dtype, most, most_ids
        self.clear()

    def clear(self) -> None:
        self.count, self.used = 0, 0
        self.bits = 16
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, self.dtype)

    def room(self, units: int) -> None:
        """Before this many units come: forget all if they might be too many."""
        if self.count + units > self.most or self.used > self.most_ids:
            self.clear()

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where it isn't there."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while left.size:
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.place[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while h.size:
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.place[slot[won]] = place[won]
            h, place, slot = h[~won], place[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New distinct hashes and their ids."""
        n = len(h)
        size = np.fromiter(map(len, ids), np.int64, n) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)

        def grown(x: np.ndarray, need: int) -> np.ndarray:
            return np.concatenate([x, np.zeros(max(need, len(x)), x.dtype)]) if need > len(x) else x

        self.starts, self.sizes, self.pool = grown(self.starts, self.count + n), grown(self.sizes, self.count + n), grown(self.pool, self.used + len(flat))
        place = np.arange(self.count, self.count + n)
        self.sizes[place], self.starts[place] = size, self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat)] = flat
        self.count, self.used = self.count + n, self.used + len(flat)
        if 2 * self.count > len(self.keys):
            full = np.flatnonzero(self.keys)
            old, at = self.keys[full], self.place[full]
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, at)
        self._put(h, place.astype(np.int32))

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids one after another, and where each unit's ids end."""
        size = self.sizes[place]
        end = np.cumsum(size)
        at = np.repeat(self.starts[place] - (end - size), size)
        at += np.arange(len(at))
        return self.pool[at], end


class Tokens:
    """Ids of texts as little-endian numbers of ``dtype``."""

    def __init__(self, path: str, units: int = 2_000_000, pieces: int = 200_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.size, self.dtype = size, np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        assert sys.byteorder == "little" and array(self.code).itemsize == self.dtype.itemsize
        self.model, self.pre = self.library.model, self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.byte = self._bytes()
        self.units = Units(self.dtype, units, 8 * units)
        self.pieces, self.mapped = _Memo(self._piece, pieces), _Memo(self._mapped, pieces // 10)

    @staticmethod
    def _bytes() -> list[str]:
        """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and on, in order."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(rest)) for b in range(256)]

    def _mapped(self, piece: str) -> bytes:
        """A pre-token in the byte-level alphabet."""
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A pre-token as it stands in the text."""
        byte = self.byte
        return self._mapped("".join([byte[b] for b in piece.encode()]))

    def _unit(self, unit: str) -> bytes:
        """A stretch of text that begins and ends where the library cuts too."""
        if unit.isascii():  # much the commonest shapes: one word
            if unit[0] == " ":
                if unit[1:].isalpha():
                    return self._mapped(self.byte[32] + unit[1:])
            elif unit.isalpha():
                return self._mapped(unit)
        if any(s in unit for s in self.special):
            return array(self.code, self.library.encode(unit, add_special_tokens=False).ids).tobytes()
        if PLAIN.fullmatch(unit, 1 if unit[:1] == " " else 0):
            parts = CUT.findall(unit)
            if unit[0] == " ":
                parts[0] = " " + parts[0]
            return b"".join([self.pieces[p] for p in parts])
        return b"".join([self.mapped[p] for p, _ in self.pre.pre_tokenize_str(unit)])

    def encode(self, column: pa.Array, end: int | None = None):
        """(ids, where each text's ids end) of some whole texts at a time; ``end`` is appended to each text's ids."""
        ended = np.array([] if end is None else [end], self.dtype)
        for data, offsets in groups(column):
            starts = np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], self._outside_special(data, offsets, cuts(data, offsets))])
            starts.sort()
            h = np.maximum(slice_hashes(data, starts), np.uint64(1))  # 0 marks a free place
            self.units.room(len(h))
            place = self.units.find(h)
            new = np.flatnonzero(place < 0)
            if new.size:
                own, first = np.unique(h[new], return_index=True)
                low = starts[new[first]]
                high = np.append(starts, len(data))[new[first] + 1]
                raw = data.tobytes()
                self.units.add(own, [self._unit(raw[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                place[new] = self.units.find(h[new])
            ids, end_of = self.units.gather(place)
            upto = np.concatenate([[0], end_of])[np.searchsorted(starts, offsets)]  # ids before each text
            if len(ended):
                ids = np.insert(ids, upto[1:], ended[0])
                upto = upto + np.arange(len(upto))
            yield ids, upto[1:]

    def _outside_special(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cuts of texts without a special token's string."""
        raw = data.tobytes()
        for special in map(str.encode, self.special):
            k = raw.find(special)
            while k >= 0:
                d = int(np.searchsorted(offsets, k, "right")) - 1
                if k + len(special) <= offsets[d + 1]:
                    at = at[(at < offsets[d]) | (at >= offsets[d + 1])]
                k = raw.find(special, k + 1)
        return at


class _Memo(dict):
    """Answers of ``make``. When ``most`` are held they become the old ones, of which those still asked for are taken over."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_open: dict[str, Tokens] = {}
remember("tokens", _open.clear)


def tokens(path: str | None) -> Tokens:
    """One a worker process and vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _open:
        _open[path] = Tokens(path)
    return _open[path]
