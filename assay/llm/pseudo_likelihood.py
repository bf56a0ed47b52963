"""LM scoring by masked pseudo-likelihood with a bidirectional window network, trained in numpy.

Every word is predicted from the ``2 * SIDE`` words around it. The vocabulary is counted over the whole corpus: each word seen
twice or more has an entry of its own with its count, so what is gathered grows with the input. The network predicts one of
CLASSES * MEMBERS ids. The commonest words have an id each; the others share ids in order of frequency, of equal mass,
and a word has its count's share of its id's probability; the last id belongs to unknown words (those seen once), which
share it evenly. The network adds the neighbours' embeddings, each scaled by its place's own vector, through tanh to a
hidden layer, and predicts the id's class and then its member (two small softmaxes). A document's score is the sum over
its words of the conditional log-probability given both sides. Beside it stand how many of its words are unknown, and
how many are barely known, as often seen as an entry needs: of a text's rare words few are known unless the corpus holds it again.

Training reads all documents and predicts every word, with Adagrad from a common start. Documents are dealt to networks of
about ``words_a_network`` words by a hash of id and text and trained on in that hash's order, so the result does not depend on
how the input is split; the networks are averaged, weighed by their words, in a tree of at most FAN a group.

Bounds: the network has a fixed size (0.6 MB). At most ``own_words`` words have entries; where a corpus has more, the
least count that makes an entry rises by powers of two and the words below it are unknown ones. An entry takes 15 bytes in
the driver and in each worker, and 8 more for its index.

Cases: null and empty texts have 0 words, sum 0 and a null mean; outside a document stand border words; rows are scored
one by one, so repeated rows and null ids are kept; an empty table trains nothing and gives an empty table; a table without
words gives null scores; extra columns are not read; texts are read whole, in chunks that keep their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import discard, forget_others, materialize, ship, table
from assay.llm.words import Finder, groups, word_hashes_of

CLASSES, MEMBERS, WIDTH, SIDE = 64, 64, 16, 2
WORDS = CLASSES * MEMBERS
UNKNOWN, BORDER = WORDS - 1, WORDS
CHUNK, STEP, FAN = 1 << 15, 1 << 13, 32
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]
SHAPES = {"embed": (WORDS + 1, WIDTH), "scale": (len(PLACES), WIDTH), "shift": (WIDTH,), "top": (WIDTH, CLASSES), "top_bias": (CLASSES,), "low": (CLASSES, WIDTH, MEMBERS), "low_bias": (CLASSES, MEMBERS)}


@dataclass
class Vocabulary:
    """Sorted hashes of known words with their ids, the logarithms of their shares of them, and whether they are barely known; rarer is how many words are unknown."""

    hashes: np.ndarray
    ids: np.ndarray
    share: np.ndarray
    barely: np.ndarray
    rarer: int

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, rarer: int, least: int = 2) -> Vocabulary:
        order = np.lexsort((hashes, -counts))
        n, most = counts[order].astype(np.float64), UNKNOWN
        rest = n[::-1].cumsum()[::-1]  # the mass from each rank on
        place = np.arange(len(n))
        alone = n * (most - place) >= rest
        few = int(np.argmin(alone)) if not alone.all() else len(n)  # commonest words, with an id each
        few = min(few, most)
        ids, share = place.copy(), np.zeros(len(n))
        if few < len(n):
            bins = most - few
            at = np.minimum(((n[few:].cumsum() - n[few:] / 2) / rest[few] * bins).astype(np.int64), bins - 1)
            ids[few:] = few + at
            share[few:] = np.log(n[few:] / np.bincount(at, n[few:], minlength=bins)[at])
        back = np.argsort(hashes[order])
        return Vocabulary(hashes[order][back], ids[back].astype(np.uint16), share[back].astype(np.float32), n[back] == least, rarer)


class Coder:
    """Ids and shares of words by their hashes."""

    def __init__(self, words: Vocabulary):
        self.finder, self.unknown = Finder(words.hashes), -float(np.log(max(1, words.rarer)))
        self.ids = np.append(words.ids, np.uint16(UNKNOWN))  # the last entry answers for -1
        self.share = np.append(words.share, np.float32(self.unknown))
        self.barely = np.append(words.barely, False)

    def code(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, shares, barely known?)"""
        at = self.finder.find(h)
        return self.ids[at], self.share[at], self.barely[at]


@dataclass
class Model:
    flat: np.ndarray | None
    words: Vocabulary


class Network:
    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        size = sum(int(np.prod(s)) for s in SHAPES.values())
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.normal(0, 0.1, s) if k in ("embed", "top", "low") else np.ones(s) if k == "scale" else np.zeros(s)).astype(np.float32).ravel() for k, s in SHAPES.items()])
        self.flat = np.array(flat, np.float32)
        assert self.flat.size == size
        self.p, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = self.flat[at : at + n].reshape(s)
            at += n

    def hidden(self, around: np.ndarray) -> np.ndarray:
        p, z = self.p, np.tile(self.p["shift"], (len(around), 1))
        for j in range(len(PLACES)):
            e = p["embed"].take(around[:, j], axis=0)
            e *= p["scale"][j]
            z += e
        return np.tanh(z, out=z)

    @staticmethod
    def by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of ids by class, and (class, from, to) of those that occur."""
        cls = (ids // MEMBERS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def log_prob(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of ids, not of the words that share them."""
        p, n = self.p, len(ids)
        order, classes = self.by_class(ids)
        h, own = self.hidden(around[order]), ids[order]
        cls, member = own // MEMBERS, own % MEMBERS
        z = h @ p["top"] + p["top_bias"]
        got = z[np.arange(n), cls]
        got -= np.log(np.exp(z, out=z).sum(axis=1))
        for c, a, b in classes:
            z = h[a:b] @ p["low"][c] + p["low_bias"][c]
            got[a:b] += z[np.arange(b - a), member[a:b]]
            got[a:b] -= np.log(np.exp(z, out=z).sum(axis=1))
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradient(self, ids: np.ndarray, around: np.ndarray) -> dict:
        """Of the mean log-probability; of embeddings (rows, their gradients)."""
        n, p = len(ids), self.p
        order, classes = self.by_class(ids)
        around, own = around[order], ids[order]
        h = self.hidden(around)
        cls, member = own // MEMBERS, own % MEMBERS
        g = {"low": np.zeros(SHAPES["low"], np.float32), "low_bias": np.zeros(SHAPES["low_bias"], np.float32)}
        part = np.float32(1 / n)

        def left(x: np.ndarray, w: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            """What each output lacks, over n."""
            z = x @ w
            z += bias
            np.exp(z, out=z)
            z *= -part / z.sum(axis=1, keepdims=True)
            z[np.arange(len(x)), chosen] += part
            return z

        d = left(h, p["top"], p["top_bias"], cls)
        g["top"], g["top_bias"] = h.T @ d, d.sum(axis=0)
        dz = d @ p["top"].T
        for c, a, b in classes:
            d = left(h[a:b], p["low"][c], p["low_bias"][c], member[a:b])
            g["low"][c], g["low_bias"][c] = h[a:b].T @ d, d.sum(axis=0)
            dz[a:b] += d @ p["low"][c].T
        dz *= 1 - h * h
        g["shift"] = dz.sum(axis=0)
        g["scale"] = np.stack([np.einsum("nw,nw->w", p["embed"].take(around[:, j], axis=0), dz) for j in range(len(PLACES))])
        # Of each place the rows' sums, by their order in the place's column.
        rows, sums = [], []
        for j in range(len(PLACES)):
            order = np.argsort(around[:, j].astype(np.uint16), kind="stable")
            sorted_ids = around[order, j]
            first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            rows.append(sorted_ids[first])
            sums.append(np.add.reduceat(dz[order], first, axis=0) * p["scale"][j])
        every, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        whole = np.zeros((len(every), WIDTH), np.float32)
        at = 0
        for x, s in zip(rows, sums, strict=True):
            whole[inverse[at : at + len(x)]] += s  # a row occurs once a place
            at += len(x)
        g["embed"] = every, whole
        return g


class Trainer:
    """Adagrad, uphill."""

    def __init__(self, net: Network, rate: float = 0.1):
        self.net, self.rate = net, np.float32(rate)
        self.past = {k: np.full(x.shape, 1e-8, np.float32) for k, x in net.p.items()}

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        for k, x in self.net.gradient(ids, around).items():
            at, x = x if isinstance(x, tuple) else (..., x)
            past = self.past[k][at] + x * x
            self.past[k][at] = past
            self.net.p[k][at] += self.rate * x / np.sqrt(past)


def coded(coder: Coder, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shares, barely known?, neighbours' ids, where each text begins, with the end) of some whole texts at a time."""
    for data, offsets in groups(column):
        h, at = word_hashes_of(data, offsets)
        ids, share, barely = coder.code(h)
        place = np.arange(len(ids)) + SIDE * (2 * np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
        padded = np.full(len(ids) + 2 * SIDE * (len(at) - 1), BORDER, np.int16)
        padded[place] = ids
        yield ids.astype(np.int16), share, barely, np.stack([padded[place + j] for j in PLACES], axis=1), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_others()
    for batch in batches:
        h = [word_hashes_of(*group)[0] for group in groups(batch.column(0))]
        x, n = np.unique(np.concatenate([np.empty(0, np.uint64), *h]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def vocabulary(texts: DataFrame, own_words: int = 1 << 22) -> tuple[Vocabulary, int] | None:
    """Of a table of texts, with the number of all words; null if there is none."""
    counted = materialize(texts.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # How many words there are by their counts' number of bits.
    by_bits = {r.bits: r for r in counted.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()}
    if not by_bits:
        return None
    bits = 2
    while sum(r.words for b, r in by_bits.items() if b >= bits) > own_words:
        bits += 1
    own = counted.where(F.col("n") >= 1 << (bits - 1)).toArrow()
    found = Vocabulary.of(own.column(0).to_numpy().view(np.uint64), own.column(1).to_numpy(), sum(r.words for b, r in by_bits.items() if b < bits), 1 << (bits - 1))
    discard(counted)
    return found, sum(r.n for r in by_bits.values())


def _train(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    forget_others()
    net, coder = Network(model.flat), Coder(model.words)
    trainer, ids, around, held, total = Trainer(net), [], [], 0, 0

    def step() -> None:
        nonlocal ids, around, held, total
        w, a = np.concatenate(ids), np.concatenate(around)
        whole = max(1, len(w) // STEP)
        for i in range(whole):
            trainer.step(w[i * STEP : (i + 1) * STEP if i + 1 < whole else None], a[i * STEP : (i + 1) * STEP if i + 1 < whole else None])
        total += len(w)
        ids, around, held = [], [], 0

    for batch in batches:
        for own, _, _, near, _ in coded(coder, batch.column(0)):
            for i in range(0, len(own), CHUNK):
                ids.append(own[i : i + CHUNK]), around.append(near[i : i + CHUNK])
                held += len(ids[-1])
                if held >= STEP:
                    step()
    if held:
        step()
    if total:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(total)]), pa.array([net.flat.tobytes()], pa.binary())], ["part", "n", "net"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of parts one network, added up in the parts' order."""
    held = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
    for group in sorted({r[0] // FAN for r in held}):
        own = [r for r in held if r[0] // FAN == group]
        n = sum(m for _, m, _ in own)
        mean = sum(np.frombuffer(blob, np.float32).astype(np.float64) * (m / n) for _, m, blob in own)
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["part", "n", "net"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, words_a_network: int = 1 << 22, own_words: int = 1 << 22) -> Model | None:
    """The vocabulary and the averaged network's parameters; null if there is no word to learn from."""
    ship(df.sparkSession)
    texts = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h")).where("text IS NOT NULL")
    found = vocabulary(texts, own_words)
    if found is None:
        return None
    words, total = found
    parts = -(-total // words_a_network)
    dealt = texts.repartition(parts, "h").sortWithinPartitions("h").select("text")
    model, form = Model(None, words), "part long, n double, net binary"
    for _ in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast(model)
        nets = materialize(dealt.mapInArrow(lambda b, sent=sent: _train(b, sent.value), form), "networks")
        count = parts
        while count > 1:
            count = -(-count // FAN)
            more = materialize(nets.repartition(count, F.expr(f"part div {FAN}")).mapInArrow(_average, form), "networks")
            discard(nets)
            nets = more
        got = nets.collect()
        discard(nets)
        sent.unpersist()
        model = Model(np.frombuffer(bytes(got[0].net), np.float32), words)
    return model


def score_column(net: Network, coder: Coder, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of log-probabilities, unknown words, barely known ones) of each text."""
    count, total, unknown, barely = [], [], [], []
    for ids, share, few, around, at in coded(coder, column):
        p = share.astype(np.float64)
        for i in range(0, len(ids), CHUNK):
            p[i : i + CHUNK] += net.log_prob(ids[i : i + CHUNK], around[i : i + CHUNK])
        n = np.diff(at)
        count.append(n), total.append(np.zeros(len(n)))
        unknown.append(np.zeros(len(n), np.int64)), barely.append(np.zeros(len(n), np.int64))
        own = np.flatnonzero(n)
        if own.size:
            total[-1][own] = np.add.reduceat(p, at[own])
            unknown[-1][own] = np.add.reduceat((ids == UNKNOWN).astype(np.int64), at[own])
            barely[-1][own] = np.add.reduceat(few.astype(np.int64), at[own])
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + count), np.concatenate([np.empty(0), *total]), np.concatenate(none + unknown), np.concatenate(none + barely)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, log_prob, n_unknown, n_barely): the sum of each word's log-probability given its neighbours."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        made = sent.value and (Network(sent.value.flat), Coder(sent.value.words))
        for batch in batches:
            if made:
                n, total, unknown, barely = score_column(*made, batch.column(1))
            else:
                n = unknown = barely = np.zeros(batch.num_rows, np.int64)
                total = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, total, unknown, barely))], ["id", "n_words", "log_prob", "n_unknown", "n_barely"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, log_prob double, n_unknown long, n_barely long")


def op5_pseudo_likelihood(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs))
    mean = F.col("log_prob") / F.nullif(F.col("n_words"), F.lit(0))
    rare_known = F.col("n_barely") / F.nullif(F.col("n_barely") + F.col("n_unknown"), F.lit(0))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "log_prob", mean.alias("mean_log_prob"), "n_unknown", "n_barely", F.coalesce(rare_known, F.lit(0.0)).alias("rare_known"))
