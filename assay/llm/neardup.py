"""Near-duplicate documents by one-permutation MinHash.

A document's set of word shingles is hashed once; the hash's leading bits choose one of ``bins`` bins, each bin keeps its
smallest hash, and empty bins borrow from a bin that a fixed random order of their own finds first (optimal
densification). ``bins / rows`` bands of ``rows`` bins are bucket keys. With the defaults, a pair of similarity 0.8 shares no
bucket with probability (1 - 0.8 ** 8) ** 64, 8 in a million.

Equal sets become one node first, so exact copies cost nothing more. Candidates within a bucket are star-shaped, and are
confirmed on the full sets of shingle hashes (64 bits a shingle), in two rounds:

1. Members are compared with the bucket's centre only, the member that shares most buckets with others.
2. Where a bucket's members then still fall into several components, those outside its largest one are compared with all
   others by sketches inside a task (two bits of every bin's minimum), and each group of members that their sketches may
   link becomes a star of edges. Components of these edges are families; every node is in one at most. A family's sets meet in one task
   (a large family's in blocks), which compares the nodes outside the family's largest component with all others on full
   sets, skips what is linked already, and gives only the links that join components.

So pairs never become rows: rows grow with a group's size, whatever share of its pairs are alike, and pairs that merely
share a common passage go no further than their sketches. Comparisons inside tasks are as many as a group's members times those outside its largest component.

No link between members of a bucket is lost by the sketch test: sets with at least SMALL shingles that are at the threshold have more differing bins
than ``most_differing`` allows with a probability of some 1e-9: in simulated pairs that is 5.9 deviations at 80 shingles,
and seven from 640 on, where bins are nearly independent. In smaller sets few minima fill all bins and deviations are
wider (2.3 at 5 shingles), so pairs with a smaller set pass unseen.

Cases: a text with fewer words than a shingle is one shingle; null texts, and texts without words, have an empty set, link
with nothing and are their own component; equal rows are copies of each other; null ids are copies like others but never a
component's id (a component of null ids alone has a null id); repeated ids are separate documents with their own sets;
an empty table gives an empty table; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import discard, forget_others, materialize, ship, table
from assay.llm.components import components
from assay.llm.shingles import distinct, rolling, scrambled
from assay.llm.words import hashed_texts

BINS, ROWS = 512, 8
BLOCK = 4096  # members that meet in a task
SET_BYTES = 1 << 24  # of a block's sets
SMALL = 64  # sketches of sets with fewer shingles say too little
FEW = 200_000  # rows of (node, mark, id) that may be broadcast: 20 MB at most
ODD_BITS = np.uint64(0x5555555555555555)


class Signer:
    """Band keys of sorted shingle sets."""

    def __init__(self, bins: int = BINS, rows: int = ROWS, seed: int = 11):
        assert bins & (bins - 1) == 0 and bins % rows == 0
        self.bins, self.rows, self.shift = bins, rows, np.uint64(64 - (bins.bit_length() - 1))
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)
        self.factor = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bins // rows, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The densified sketch; shingles are sorted, so the first of each bin is its smallest."""
        at = (shingles >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[at[first]] = shingles[first]
        full[at[first]] = True
        source = np.arange(self.bins)
        left = np.flatnonzero(~full)
        low, step = 0, 16
        while left.size:
            asked = self.order[left, low : low + step]
            hit = full[asked]
            place = hit.argmax(axis=1)
            found = hit[np.arange(len(left)), place]
            source[left[found]] = asked[found, place[found]]
            left, low, step = left[~found], low + step, step * 2
        return out[source]

    def sketch(self, minima: np.ndarray) -> bytes:
        """Two bits of each minimum."""
        code = (scrambled(minima) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
        return (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()

    def bands(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            rows = minima.reshape(-1, self.rows)
            return scrambled((scrambled(rows) * self.factor).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def most_differing(percent: int, bins: int = BINS, deviations: float = 7.0) -> int:
    """Bins that may differ in two bits for a pair at the threshold."""
    same = percent / 100 + (1 - percent / 100) / 4
    return int(np.ceil((1 - same) * bins + deviations * np.sqrt(same * (1 - same) * bins)))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bins in which packed sketches (..., words) differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & ODD_BITS).sum(axis=-1, dtype=np.int32)


def _packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _mark(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes())


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, told, n, mark, sketch, bands): a hash of the text, the set's size and 128-bit fingerprint, two bits of each bin, and its bucket keys."""
    ship(df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        signer = Signer()
        for batch in batches:
            n, mark, sketch, bands = [], [], [], []
            for words in hashed_texts(batch.column(1)):
                s = distinct(rolling(words, shingle))
                n.append(len(s))
                mark.append(_mark(s))
                low = signer.minima(s) if len(s) else None
                sketch.append(None if low is None else signer.sketch(low))
                bands.append(np.empty(0, np.int64) if low is None else signer.bands(low))
            ends = np.cumsum([0, *map(len, bands)])
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "told", "n", "mark", "sketch", "bands"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("told"))
    return rows.mapInArrow(sign, "id long, told long, n long, mark binary, sketch binary, bands array<long>")


def _sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (node, shingles binary) of the given nodes (node, mark, rep, told), read from a document that stands for each: one with this id and hash of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            node, out = [], []
            for n, mark, words in zip(*(c.to_pylist() for c in batch.columns[:2]), hashed_texts(batch.column(2)), strict=True):
                s = distinct(rolling(words, shingle))
                if _mark(s) == mark:
                    node.append(n), out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("own"))
    one = docs.join(nodes, (F.col("own") == F.col("told")) & F.col("id").eqNullSafe(F.col("rep"))).select("node", "mark", "text")
    return one.mapInArrow(read, "node long, shingles binary").dropDuplicates(["node"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, last, left = [], None, None
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for x, y in zip(a, b, strict=True):
            if x is not last:
                last, left = x, np.frombuffer(x, np.uint64)
            right = np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(left, right), len(left) - 1)
            shared.append(int((left[at] == right).sum()))
        n = [[len(x) // 8 for x in c] for c in (a, b)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], ["a", "b", "shared", "na", "nb"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id): one for each document."""
    signed = materialize(sketches(df, id_col, text_col, shingle), "sketches")
    # A node a distinct set. Ids from monotonically_increasing_id are fixed by being written.
    one = F.struct("id", "told")
    nodes = signed.where("n > 0").groupBy("mark").agg(F.coalesce(F.min(F.when(F.col("id").isNotNull(), one)), F.min(one)).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = nodes.select("mark", F.col("one.id").alias("rep"), F.col("one.told").alias("told"), "n", "sketch", "bands")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = materialize(keyed.join(held, "key"), "shared")
    degree = materialize(shared.groupBy("node").agg(F.sum("held").alias("degree")), "degrees")
    centre = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("c"))).alias("top"))
    members = materialize(shared.select("key", "node").join(centre.select("key", (-F.col("top.c")).alias("c")), "key"), "members")
    count = degree.count()
    wanted = F.broadcast(degree.select("node")) if count <= FEW else degree.select("node")
    asked = nodes.select("node", "mark", "rep", "told").join(wanted, "node", "left_semi")
    sets = materialize(_sets(df, F.broadcast(asked) if count <= FEW else asked, id_col, text_col, shingle), "sets")
    joined = _joined(members, nodes.select("node", "n", "sketch"), sets, percent)
    named = nodes.select("mark", "node", "rep").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").select("mark", "component_id")
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("mark")).alias("mark")).join(named, "mark", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = materialize(out, "groups")
    for x in (signed, nodes, shared, degree, members, sets, joined):
        discard(x)
    return out


def _likely(percent: int):
    """Of (a, b, sketch of a, sketch of b, size of the smaller) the pairs whose sketches agree, or say too little."""
    most = most_differing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                small = batch.column(4).to_numpy() < SMALL
                ok = pa.array(small | (differing(_packed(batch.column(2)), _packed(batch.column(3))) <= most))
            else:
                ok = pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    return run


class Labels:
    """What is joined so far among numbered things, as the smallest label of each."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def join(self, x: int, others: np.ndarray) -> np.ndarray:
        """Join x with the others; returns one of them for each group that x wasn't in."""
        own = self.label[x]
        new = others[self.label[others] != own]
        if not new.size:
            return new
        groups, first = np.unique(self.label[new], return_index=True)
        self.label[np.isin(self.label, groups)] = own
        return new[first]


def likely_stars(node: np.ndarray, n: np.ndarray, comp: np.ndarray, role: np.ndarray, sketch: np.ndarray, percent: int, rows: int = 64) -> np.ndarray:
    """Edges (a, b) that join all probes and members across components whose sizes and sketches allow a link; a member has
    bit 1 of role, a probe bit 2. Edges are fewer than nodes."""
    most, out = most_differing(percent), []
    probes, others = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    _, place = np.unique(node, return_inverse=True)
    found = Labels(np.arange(len(node)))
    low, high = n * percent, n * 100
    for a in range(0, len(probes), rows):
        i = probes[a : a + rows]
        ok = (comp[i][:, None] != comp[others][None, :]) & (high[i][:, None] >= low[others][None, :]) & (high[others][None, :] >= low[i][:, None])
        x, y = np.nonzero(ok)
        near = (np.minimum(n[i[x]], n[others[y]]) < SMALL) | (differing(sketch[i[x]], sketch[others[y]]) <= most)
        x, y = x[near], y[near]
        cut = np.searchsorted(x, np.arange(len(i) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            new = found.join(int(place[i[k]]), place[others[y[cut[k] : cut[k + 1]]]])
            if new.size:
                out.append(np.column_stack([np.full(len(new), place[i[k]]), new]))
    return np.unique(node)[np.concatenate(out)] if out else np.empty((0, 2), np.int64)


def exact_links(node: np.ndarray, comp: np.ndarray, role: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links (a, b) that join components of probes and members as full sets do, and no more of them than join any."""
    out, size = [], np.array([len(s) for s in sets])
    found = Labels(np.unique(comp, return_inverse=True)[1])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    local = [flat[e - k : e] for e, k in zip(ends, size, strict=True)]
    others = np.flatnonzero(role & 1)
    others = others[np.argsort(size[others], kind="stable")]  # by size, so that what can be alike stands side by side
    own_size = size[others]
    joined = np.concatenate([local[k] for k in others]) if others.size else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(own_size)])
    held = np.zeros(int(flat.max(initial=0)) + 1, bool)
    for i in np.flatnonzero(role & 2).tolist():
        low = int(np.searchsorted(100 * own_size, percent * size[i], "left"))
        high = int(np.searchsorted(percent * own_size, 100 * size[i], "right"))
        if low >= high or (found.label[others[low:high]] == found.label[i]).all():
            continue
        held[local[i]] = True
        shared = np.add.reduceat(held[joined[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        held[local[i]] = False
        linked = others[low:high][100 * shared >= percent * (size[i] + own_size[low:high] - shared)]
        new = found.join(i, linked)
        if new.size:
            out.append(np.column_stack([np.full(len(new), node[i]), node[new]]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _in_blocks(work, width: int):
    """Rows whose first three columns name their block, ordered by them, through work(columns of a block) to pairs (a, b). The last
    of the width columns is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: list[bytes] = []

        def flush(whole: bool):
            key = np.column_stack(held[:3])
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            done, out = cut if whole else cut[:-1], [np.empty((0, 2), np.int64)]
            for a, b in zip(done[:-1].tolist(), done[1:].tolist(), strict=True):
                if b - a > 1:
                    out.append(work(*(x[a:b] for x in held[3:]), last[a:b]))
            pairs, at = np.concatenate(out).astype(np.int64), int(done[-1])
            held[:], last[:] = [x[at:] for x in held], last[at:]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width - 1)]
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            last += batch.column(width - 1).to_pylist()
            yield flush(False)
        if held and len(held[0]):
            yield flush(True)

    return run


def _dealt(rows: DataFrame, group: str, parts) -> DataFrame:
    """rows (group, node, comp, ...) of all groups with several components, once for each block they are needed in: (group, low, high, role, ...).

    Probes are the rows outside the group's largest component. A group is one block if ``parts`` (of its rows and their sizes' sum n) says
    1; else its rows are dealt out by their nodes, its probes too, and every part of the rows meets every part of the probes."""
    per = rows.groupBy(group, "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    top = per.groupBy(group).agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("held"), F.sum("n").alias("sizes"), F.count("*").alias("comps")).where("comps > 1")
    share = (F.col("held") - F.col("top.m")).cast("double") / F.col("held")
    top = top.select(group, F.col("top.comp").alias("main"), parts.cast("int").alias("parts"), F.ceil(parts * share).cast("int").alias("probe_parts"))
    own = rows.join(top, group).withColumn("probe", F.col("comp") != F.col("main"))
    names = [c for c in rows.columns if c != group]
    zero = F.lit(0)
    one = own.where("parts = 1").select(group, zero.alias("low"), zero.alias("high"), F.when(F.col("probe"), 3).otherwise(1).alias("role"), *names)
    part = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    many = own.where("parts > 1")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = many.select(group, part(F.col("parts")).alias("low"), every("probe_parts").alias("high"), F.lit(1).alias("role"), *names)
    probes = many.where("probe").select(group, every("parts").alias("low"), part(F.col("probe_parts")).alias("high"), F.lit(2).alias("role"), *names)
    return one.unionAll(members).unionAll(probes)


def _joined(members: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, comp) of all links in the buckets. members: (key, node, c), c the bucket's centre; about: (node, n, sketch)."""
    star = members.where("node != c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(about.select(F.col("node").alias("b"), "n", "sketch"), "b").join(about.select(F.col("node").alias("a"), F.col("n").alias("cn"), F.col("sketch").alias("csketch")), "a")
    star = star.where(F.expr(f"100 * least(n, cn) >= {percent} * greatest(n, cn)")).select("a", "b", "csketch", "sketch", F.least("n", "cn").alias("least")).mapInArrow(_likely(percent), "a long, b long")
    links = _confirmed(star, sets, percent)
    comps = components(links)
    labelled = lambda df: df.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = labelled(members.select("key", "node")).join(about.select("node", "n"), "node").select("key", "node", "comp", "n")
    dealt = _dealt(rows, "key", F.ceil(F.col("held") / BLOCK)).join(about.select("node", "sketch"), "node").select("key", "low", "high", "role", "node", "comp", "n", "sketch")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    packed = lambda sketch: np.frombuffer(b"".join(sketch), np.uint64).reshape(len(sketch), -1)
    likely = dealt.mapInArrow(_in_blocks(lambda role, node, comp, n, sketch: likely_stars(node, n, comp, role, packed(sketch), percent), 8), "a long, b long")
    edges = materialize(likely.distinct(), "edges")
    families = components(edges)
    rows = labelled(families.withColumnRenamed("comp", "family")).join(about.select("node", "n"), "node").select("family", "node", "comp", "n")
    dealt = _dealt(rows, "family", F.ceil(F.greatest(F.col("held") / BLOCK, 8 * F.col("sizes") / SET_BYTES))).join(sets, "node")
    dealt = dealt.select("family", "low", "high", "role", "node", "comp", "shingles").repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    exact = lambda role, node, comp, shingles: exact_links(node, comp, role, [np.frombuffer(x, np.uint64) for x in shingles], percent)
    more = materialize(dealt.mapInArrow(_in_blocks(exact, 7), "a long, b long"), "links")
    out = components(links.unionByName(more))
    for x in (links, edges, more, comps, families):
        discard(x)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) those that full sets link."""
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    seen = full.select("a", "b", "sa", "sb").mapInArrow(_overlap, "a long, b long, shared long, na long, nb long")
    linked = 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))
    return materialize(seen.where(linked).select("a", "b"), "links")


def op7_near_duplicates(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))
