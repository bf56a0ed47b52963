"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

Words are lower-cased and lose the signs around them; shingles are ``shingle`` consecutive words (an item of fewer words is
one shingle). A shingle that several items share weighs one over their number, any other weighs 1. A window of a document
has as many words as the item it is compared with, and a text of fewer words than the item is one window; its 64-bit SimHash adds up its weighted shingles. A window is a
candidate for the items of its size whose fingerprints lie within ``radius`` bits: the bits are cut into BLOCKS blocks, and
of two fingerprints that near one block at least differs in ``radius // BLOCKS`` bits or fewer, so looking up each block with all
flips of so many bits finds them all (of two random fingerprints 15 % pass a look-up). At similarity 0.8 fingerprints differ in
9.7 bits on average; one window in some 1,500 lies beyond 18, and its neighbours are looked up too. Candidates are verified by their exact weighted-shingle similarity, sum of smaller over sum of larger weighted counts, at least
``similarity``. Windows that share no shingle with any item have similarity 0 and get no fingerprint.

The benchmark goes to the executors in blocks of about ``items_a_block`` items, one pass over the documents each. With
several blocks, each pass is written before the next starts, so that one block is held at a time; shingles' holders are counted over the whole benchmark first, and every block gets the counts of all
shingles that several items hold (12 bytes each), since a window may hold shingles of other blocks' items: results do not
depend on the blocks.

Cases: null and empty texts, and items without words, match nothing; texts are read whole, very long ones in overlapping
pieces; null and repeated ids on either side are kept row for row; of several windows for one item the most similar
counts, then the first; an empty table of documents gives an empty table, an empty benchmark no leaks; columns that are
not named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import discard, forget_others, materialize, remember, ship, table
from assay.llm.shingles import rolling
from assay.llm.words import groups, hash_of, is_space, lowered, slice_hashes, word_starts

UNIT = 64  # a weight of 1, as an integer
BLOCKS, WIDTH = 4, 16
PIECE = 1 << 16
EDGE = "\"'`.,;:!?()[]{}<>*#|-_"


_EDGE = np.zeros(256, bool)
_EDGE[list(EDGE.encode())] = True


#: Of words with letters beyond ASCII, hash with A-Z lower-cased -> hash with all letters lower-cased.
_lowered: dict[int, int] = {}
MOST = 500_000
remember("plain words", _lowered.clear)


def plain_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's word hashes, in order: lower-cased, without the signs around words (a word of signs alone keeps them)."""
    for data, offsets in groups(column):
        blank = is_space(data)
        starts = word_starts(data, offsets, blank)
        if not len(starts):
            yield from (np.empty(0, np.uint64) for _ in offsets[1:])
            continue
        ends = np.append(starts[1:], len(data))
        solid = np.flatnonzero(~(blank | _EDGE[data]))
        low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        there = np.append(solid, 0)
        begin, end = np.where(low < high, there[low], starts), there[high - 1] + 1
        signs = np.flatnonzero(low == high)
        gaps = np.flatnonzero(blank)  # a word of signs ends at the next white space or text
        end[signs] = np.minimum(np.append(gaps, len(data))[np.searchsorted(gaps, starts[signs])], ends[signs])
        step = np.zeros(len(data) + 1, np.int8)
        step[begin] += 1
        step[end] -= 1
        h = slice_hashes(lowered(data), begin, np.cumsum(step[:-1], dtype=np.int8) == 0)
        wide = np.concatenate([[0], np.cumsum(data >= 128)])
        text = data.tobytes()
        odd = np.flatnonzero(wide[ends] > wide[starts])
        said = [_lowered.get(x) for x in h[odd].tolist()]
        for i, x in enumerate(said):
            if x is None:
                if len(_lowered) >= MOST:
                    _lowered.clear()
                k = odd[i]
                said[i] = _lowered[int(h[k])] = hash_of(text[begin[k] : end[k]].decode("utf-8", "replace").lower().encode())
        h[odd] = np.array(said, np.uint64)
        at = np.searchsorted(starts, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield h[a:b]


def hashes(text: str | None) -> np.ndarray:
    (h,) = plain_words(pa.array([text], pa.string()))
    return h


def bits_of(x: np.ndarray) -> np.ndarray:
    """(n, 64) signs +1 and -1 of 64-bit hashes."""
    return (np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)


def fold(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Items:
    """Benchmark items, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int, radius: int, similarity: float, shared: tuple[np.ndarray, np.ndarray] | None = None):
        """shared: sorted shingles that several items of the whole benchmark hold, and their holders; where these items are all, none."""
        self.radius, self.similarity = radius, similarity
        coded = [(i, h) for i, h in ((i, hashes(t)) for i, t in items) if len(h)]
        grams = [rolling(h, shingle) for _, h in coded]
        self.sizes: dict[int, list[int]] = {}
        for k, (_, h) in enumerate(coded):
            self.sizes.setdefault(len(h), []).append(k)
        self.ids = [i for i, _ in coded]
        self.width = {s: min(shingle, s) for s in self.sizes}
        held = Counter(x for g in grams for x in set(g.tolist()))
        self.known = np.array(sorted(held), np.uint64)
        if shared is None:
            many = sorted(x for x, n in held.items() if n > 1)
            shared = np.array(many, np.uint64), np.array([held[x] for x in many], np.int32)
        self.many, self.weight = shared[0], np.maximum(1, np.round(UNIT / shared[1])).astype(np.int32)
        # Which items hold each known shingle.
        pairs = sorted((x, k) for k, g in enumerate(grams) for x in set(g.tolist()))
        self.holder = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([x for x, _ in pairs], np.uint64), self.known)
        self.size = np.array([len(h) for _, h in coded], np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.known & np.uint64((1 << 22) - 1)] = True
        self.counts = [np.unique(g, return_counts=True) for g in grams]
        self.prints = np.array([fold((bits_of(g).astype(np.int32) * self.weights(g)[:, None]).sum(axis=0)[None, :])[0] for g in grams], np.uint64)
        flips = np.arange(1 << WIDTH, dtype=np.uint16)
        self.flips = flips[np.bitwise_count(flips) <= radius // BLOCKS]
        # For each size and block the items in order of the block's value.
        self.index = {}
        for s, own in self.sizes.items():
            own = np.array(own)
            for j in range(BLOCKS):
                v = self.block(self.prints[own], j)
                order = np.argsort(v, kind="stable")
                self.index[s, j] = v[order], own[order]

    def weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.many):
            return np.full(len(grams), UNIT, np.int32)
        at = np.minimum(np.searchsorted(self.many, grams), len(self.many) - 1)
        return np.where(self.many[at] == grams, self.weight[at], UNIT).astype(np.int32)

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        maybe = np.flatnonzero(self.filter[grams & np.uint64((1 << 22) - 1)])
        if not maybe.size:
            return maybe
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == grams[maybe]]

    def sizes_of(self, grams: np.ndarray) -> list[int]:
        """The sizes of all items that hold one of these known shingles: only they can be alike."""
        at = np.unique(np.searchsorted(self.known, grams))
        ends = np.append(self.first[1:], len(self.holder))
        held = np.concatenate([self.holder[a:b] for a, b in zip(self.first[at], ends[at], strict=True)])
        return np.unique(self.size[held]).tolist()

    @staticmethod
    def block(prints: np.ndarray, j: int) -> np.ndarray:
        """The j-th WIDTH bits of fingerprints."""
        return (prints >> np.uint64(WIDTH * j)).astype(np.uint16)

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of all fingerprints within the radius."""
        found = []
        for j in range(BLOCKS):
            values, own = self.index[size, j]
            there = np.zeros(1 << WIDTH, bool)
            there[values] = True
            for a in range(0, len(prints), 256):
                probes = (self.block(prints[a : a + 256], j)[:, None] ^ self.flips).ravel()
                hit = np.flatnonzero(there[probes])
                if not hit.size:
                    continue
                window, v = hit // len(self.flips), probes[hit]
                low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                n = high - low
                item = own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
                found.append(np.column_stack([np.repeat(window + a, n), item]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        ok = popcount(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= self.radius
        return pairs[ok, 0], pairs[ok, 1]

    def alike(self, grams: np.ndarray, item: int) -> float:
        """Exact weighted similarity of a window's shingles and an item's."""
        x, n = np.unique(grams, return_counts=True)
        y, m = self.counts[item]
        every = np.union1d(x, y)
        a, b = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = n, m
        w = self.weights(every)
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, distance in bits), the best window of each item, in a text's word hashes."""
        best: dict[int, tuple[float, int, int, int]] = {}
        longest = max(self.sizes, default=0)
        for a in range(0, len(h), PIECE):
            self._piece(h[a : a + PIECE + longest - 1], a, best, not a and len(h) < PIECE + longest)
        return [(k, start, size, sim, dist) for k, (sim, start, size, dist) in sorted(best.items())]

    def _piece(self, h: np.ndarray, base: int, best: dict, whole: bool) -> None:
        for width in set(self.width.values()):
            if len(h) < width:
                continue
            grams = rolling(h, width)
            hits = self.shared(grams)
            if not hits.size:
                continue
            longest = max(s for s, w in self.width.items() if w == width)
            # Only stretches around hits get running sums.
            cuts = np.flatnonzero(np.diff(hits) > 2 * longest) + 1
            for run in np.split(hits, cuts):
                low, high = max(0, run[0] - longest), min(len(grams), run[-1] + longest + 1)
                own = grams[low:high]
                total = np.zeros((len(own) + 1, 64), np.int32)
                np.cumsum(bits_of(own).astype(np.int32) * self.weights(own)[:, None], axis=0, out=total[1:])
                for size in (s for s in self.sizes_of(grams[run]) if self.width[s] == width):
                    span = size - width + 1  # shingles of a window
                    if len(own) < span:
                        if not whole:
                            continue  # the piece before this one holds all windows that are so long
                        span = len(own)  # the text is shorter than the item: own is all of it
                    inside = np.zeros(len(own) + 1, np.int32)
                    inside[1:] = np.cumsum(np.isin(np.arange(len(own)), run - low, assume_unique=True))
                    starts = np.flatnonzero(inside[span:] > inside[: len(inside) - span])
                    prints = fold(total[starts + span] - total[starts])
                    for w, k in zip(*self.near(size, prints), strict=True):
                        at = int(starts[w])
                        sim = self.alike(own[at : at + span], int(k))
                        if sim >= self.similarity:
                            place = base + int(low) + at
                            had = best.get(int(k))
                            if had is None or (sim, -place) > (had[0], -had[1]):
                                best[int(k)] = (sim, place, span + width - 1, int(popcount(prints[w : w + 1] ^ self.prints[k : k + 1])[0]))


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int64())]))


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 18, items_a_block: int = 20_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (id, leaks array<struct<item_id, start, words, similarity, distance>>) of all documents, starts in words, and the columns named in keep as kept_<name>."""
    spark = df.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, -(-items.count() // items_a_block))
    others = [c for c in keep if c != text_col]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<struct<item_id: long, start: long, words: long, similarity: double, distance: long>>").alias("leaks"), *(F.col(c).alias(f"kept_{c}") for c in others))
    schema = rows.schema
    shared = spark.sparkContext.broadcast(None if blocks == 1 else _shared(items, shingle))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])
        done = rows.mapInArrow(_pass(sent, shared, shingle, radius, similarity), schema)
        if b + 1 < blocks:
            done = materialize(done, "pass")
            discard(rows)
            sent.unpersist()
        rows = done
    return rows.withColumnRenamed("text", f"kept_{text_col}") if text_col in keep else rows.drop("text")


def _shared(items: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several items hold, and how many hold each."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("plain words")
        for batch in batches:
            own = [np.unique(rolling(h, shingle)) for h in plain_words(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], ["gram"])

    held = items.select("text").mapInArrow(grams, "gram long").groupBy("gram").agg(F.count("*").cast("int").alias("n")).where("n > 1").toArrow()
    x, n = held.column(0).to_numpy().view(np.uint64), held.column(1).to_numpy()
    order = np.argsort(x)
    return x[order], n[order].astype(np.int32)


def _pass(sent, shared, shingle: int, radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("plain words")
        items = Items(sent.value, shingle, radius, similarity, shared.value)
        for batch in batches:
            out = []
            for h, had in zip(plain_words(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = [{"item_id": items.ids[k], "start": a, "words": n, "similarity": s, "distance": d} for k, a, n, s, d in items.leaks(h)]
                out.append([*had, *own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, _LEAK), *batch.columns[3:]], batch.schema.names)

    return run


def op3_decontamination(spark, sf_dir) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.inline("leaks"))
