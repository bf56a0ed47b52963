"""Language identification by interpolated Kneser-Ney character models.

``fit`` learns one model a language from a bounded sample of labelled texts. Each model interpolates character n-grams of
orders 1 to ``order`` by Kneser-Ney (continuation counts below the highest order, one discount an order). All models stand
in one pair of sorted hash arrays: n-grams with their log-probability in each language, and contexts with their log back-off.
Scoring looks up whole texts, all characters of them; the lowest cross-entropy a character wins.

Texts of the sample are cut into n-grams and held-back ones scored on the executors; the driver gets counts. Bounds of the
sample, all parameters: the ``languages`` commonest labels; for each at most about ``sample_texts`` distinct texts, those with
the smallest hashes, and of these at most ``sample_chars`` code points, or CELLS over the square of the number of languages
if that is less (the text that crosses the bound is cut there). So the model has at most CELLS numbers, 4 bytes each.

Letters are lower-cased; every run of other characters counts as one space; letters have 16-bit codes, so that all but the
65,533 commonest of the sample share one. ``rejected`` marks texts that fit no language: their cross-entropy lies further
above the mean of held-back sample texts than ``reject_at`` of its deviations (which fall with the text's length) and
``reject_margin`` nats.

Cases: null texts and texts without a letter are ``und``, score 0, rejected; so is every text when nothing could be learned;
null labels are not learned from; copies of a text are learned once; rows are judged one by one, so repeated rows and null
ids are kept; ties go to the first language by code point; long texts are scored piece by piece with full context; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import discard, forget_others, materialize, ship, table
from assay.llm.words import Finder

ORDER = 4
SPACE, RARE = 0, 1  # codes of "no letter" and of letters outside the alphabet
PIECE = 1 << 18  # characters scored at once
BITS, CELLS = 16, 1 << 26


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text, and so as held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else 0."""
    global _LETTERS
    if _LETTERS is None:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LETTERS = out
    return _LETTERS


def folded(text: str) -> np.ndarray:
    """The text's letters as lower-case code points; runs of anything else as one 0, with one at the start and one at the end."""
    raw = letters()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
    return raw[keep]


def coder(alphabet: np.ndarray) -> np.ndarray:
    """For each code point 0 its code."""
    table = np.full(0x110000, RARE, np.uint16)
    table[0] = SPACE
    table[alphabet] = np.arange(2, 2 + len(alphabet), dtype=np.uint16)
    return table


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # code points with a code of their own; codes start at 2
    bits: int
    order: int
    grams: list[np.ndarray]  # by order - 1: sorted keys
    logp: list[np.ndarray]  # beside them: log-probability by language (of lower orders where a language lacks the n-gram)
    contexts: list[np.ndarray]  # by order - 1: sorted keys of contexts (order - 1 characters)
    backoff: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray  # deviation of a text's mean, times the square root of its length

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = {f"{k}{i}": v for k in ("grams", "logp", "contexts", "backoff") for i, v in enumerate(getattr(self, k))}
        np.savez_compressed(out, alphabet=self.alphabet, head=np.array([self.bits, self.order]), mean=self.mean, spread=self.spread, langs=np.array(self.langs, dtype=object).astype("U"), **parts)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        bits, order = (int(x) for x in z["head"])
        return Model([str(x) for x in z["langs"]], z["alphabet"], bits, order, *([z[f"{k}{i}"] for i in range(order)] for k in ("grams", "logp", "contexts", "backoff")), z["mean"], z["spread"])

    def coder(self) -> np.ndarray:
        return coder(self.alphabet)


def keys(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Keys of the n-grams that end at each code from the n-th on."""
    m = len(codes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(n if m > 0 else 0):
        out = (out << np.uint64(bits)) | codes[j : j + m]
    return out


MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(key: np.ndarray) -> np.ndarray:
    """An even spread of exact keys, one to one, so that sorted arrays can be entered by leading bits."""
    x = key * MIX
    return x ^ (x >> np.uint64(32))


class Scorer:
    def __init__(self, model: Model):
        self.m, self.code = model, model.coder()
        order_of = lambda x: np.argsort(x, kind="stable")
        self.grams, self.logp, self.contexts, self.backoff = [], [], [], []
        for n in range(model.order):
            h, c = hashed(model.grams[n]), hashed(model.contexts[n])
            i, j = order_of(h), order_of(c)
            self.grams.append(Finder(h[i])), self.contexts.append(Finder(c[j]))
            self.logp.append(np.ascontiguousarray(model.logp[n][i])), self.backoff.append(np.ascontiguousarray(model.backoff[n][j]))

    def each(self, codes: np.ndarray) -> np.ndarray:
        """(characters from the order-th on, languages) log-probabilities."""
        m, top = self.m, self.m.order
        count = len(codes) - top + 1
        out = np.zeros((count, len(m.langs)), np.float32)
        todo, full = np.arange(count), keys(codes, top, m.bits)
        for n in range(top, 0, -1):
            key = full[todo] & np.uint64((1 << (m.bits * n)) - 1)
            at = self.grams[n - 1].find(hashed(key))
            hit = at >= 0
            out[todo[hit]] += self.logp[n - 1][at[hit]]
            todo, key = todo[~hit], key[~hit]
            if not todo.size:
                break
            if n > 1:
                at = self.contexts[n - 1].find(hashed(key >> np.uint64(m.bits)))
                out[todo[at >= 0]] += self.backoff[n - 1][at[at >= 0]]
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities (texts, languages), and the number of characters scored; the order - 1 codes before a text are spaces."""
        m, pad = self.m, np.zeros(self.m.order - 1, np.uint64)
        total, count = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64)
        group, owner, held = [], [], 0

        def score() -> None:
            nonlocal group, owner, held
            if group:
                p = self.each(np.concatenate(group))
                # A piece's own characters; the order - 1 places between pieces look back across a border and are left out.
                at = 0
                starts, ends = [], []
                for g in group:
                    starts.append(at), ends.append(at + len(g) - m.order + 1)
                    at += len(g)
                sums = np.add.reduceat(p, np.minimum(np.ravel(np.column_stack([starts, ends])), len(p) - 1), axis=0, dtype=np.float64)[::2]
                last = ends[-1] - starts[-1]
                sums[-1] = p[starts[-1] : starts[-1] + last].sum(axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
            group, owner, held = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = folded(text)
            if not raw.any():
                continue
            codes = np.concatenate([pad, self.code[raw[1:]].astype(np.uint64)])  # the first space is in the padding
            count[i] = len(raw) - 1
            for a in range(0, len(codes) - m.order + 1, PIECE):
                piece = codes[a : a + PIECE + m.order - 1]
                group.append(piece), owner.append(i)
                held += len(piece)
                if held >= PIECE:
                    score()
        score()
        return total, count


def grams(text: str, code: np.ndarray, order: int) -> np.ndarray:
    """Keys of a text's n-grams of the highest order, spaces before it; of a text without letters none."""
    raw = folded(text)
    if not raw.any():
        return np.empty(0, np.uint64)
    return keys(np.concatenate([np.zeros(order - 1, np.uint64), code[raw[1:]].astype(np.uint64)]), order, BITS)


def kneser_ney(key: np.ndarray, count: np.ndarray, order: int, symbols: int, bits: int) -> tuple[list, list]:
    """By order: (keys, log-probability) of n-grams, and (contexts, log back-off) of what they start with, from the counts of the highest order."""
    held, grams, contexts = [key], [], []
    for n in range(order - 1, 0, -1):  # shorter n-grams are ends of longer ones, or their starts where a text begins
        mask = np.uint64((1 << (bits * n)) - 1)
        held.insert(0, np.unique(np.concatenate([held[0] & mask, held[0] >> np.uint64(bits)])))
    low_key, low_p = None, None
    for n in range(1, order + 1):
        key, c = held[n - 1], count
        if n < order:  # continuation counts: after how many distinct characters an n-gram occurs
            key, c = np.unique(held[n] & np.uint64((1 << (bits * n)) - 1), return_counts=True)
        c = c.astype(np.float64)
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
        ctx, inverse = np.unique(key >> np.uint64(bits), return_inverse=True)
        total = np.bincount(inverse, c)
        rest = discount * np.bincount(inverse) / total
        if n == 1:
            lower = np.full(len(key), 1 / symbols)
            base = rest[0] / symbols if len(rest) else 1 / symbols
        else:
            at = np.searchsorted(low_key, key & np.uint64((1 << (bits * (n - 1))) - 1))
            at = np.minimum(at, len(low_key) - 1)
            found = low_key[at] == key & np.uint64((1 << (bits * (n - 1))) - 1)
            lower = np.where(found, low_p[at], base)
        p = np.maximum(c - discount, 0) / total[inverse] + rest[inverse] * lower
        low_key, low_p = key, p
        grams.append((key, np.log(p))), contexts.append((ctx, np.log(rest)))
    return grams, contexts


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], fill) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all languages, and a value for each language: its own, or what fill gives for the keys it lacks."""
    every = np.unique(np.concatenate([k for k, _ in parts]))
    out = np.empty((len(every), len(parts)), np.float32)
    for j, (k, v) in enumerate(parts):
        at = np.minimum(np.searchsorted(k, every), max(len(k) - 1, 0))
        have = k[at] == every
        out[have, j] = v[at[have]]
        out[~have, j] = fill(j, every[~have])
    return every, out


def build(langs: list[str], alphabet: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """A model from each language's counts of n-grams of the highest order; not calibrated yet."""
    model = Model(langs, alphabet, BITS, order, [], [], [], [], np.zeros(len(langs)), np.ones(len(langs)))
    symbols, step = len(alphabet) + 2, np.uint64(BITS)
    tables = [kneser_ney(k, n, order, symbols, BITS) for k, n in counts]
    floor = [np.float32(np.log(1 / symbols)) for _ in langs]
    for n in range(1, order + 1):

        def lower(j: int, key: np.ndarray, n=n) -> np.ndarray:
            """log back-off of the context in language j (0 if it has none) plus the shorter n-gram's log-probability."""
            ctx, rest = tables[j][1][n - 1]
            if n == 1:
                return np.full(len(key), floor[j] + (rest[0] if len(rest) else 0), np.float32)
            at = np.minimum(np.searchsorted(ctx, key >> step), max(len(ctx) - 1, 0))
            off = np.where(ctx[at] == key >> step, rest[at], 0.0)
            short = key & np.uint64((1 << (BITS * (n - 1))) - 1)
            at = np.minimum(np.searchsorted(model.grams[n - 2], short), len(model.grams[n - 2]) - 1)
            have = model.grams[n - 2][at] == short
            rest_p = np.empty(len(key))
            rest_p[have] = model.logp[n - 2][at[have], j]
            if (~have).any():
                rest_p[~have] = lower(j, short[~have], n - 1)
            return (off + rest_p).astype(np.float32)

        k, v = _merge([t[0][n - 1] for t in tables], lower)
        if n == 1:  # every symbol has a unigram, so that a look-up always ends
            missing = np.setdiff1d(np.arange(symbols, dtype=np.uint64), k)
            k2 = np.concatenate([k, missing])
            v2 = np.concatenate([v, np.stack([lower(j, missing) for j in range(len(langs))], 1)]) if len(missing) else v
            i = np.argsort(k2)
            k, v = k2[i], v2[i]
        model.grams.append(k), model.logp.append(v)
        c, b = _merge([t[1][n - 1] for t in tables], lambda j, key: np.zeros(len(key)))
        model.contexts.append(c), model.backoff.append(b.astype(np.float32))
    return model


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.concatenate([np.empty(0, np.uint32), *map(folded, texts)])
    return np.unique(raw[raw != 0], return_counts=True)


def commonest(letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The letters that get a code of their own, sorted."""
    return np.sort(letters[np.lexsort((letters, -n))][: (1 << BITS) - 3])


def moments(scorer: Scorer, lang: int, texts: list[str]) -> np.ndarray:
    """(texts, characters, sum of cross-entropies, sum of their squares a character) of texts in their own language."""
    total, count = scorer.texts(texts)
    own, n = -total[count > 0, lang], count[count > 0]
    return np.array([len(n), n.sum(), own.sum(), (own * own / n).sum()])


def calibrate(model: Model, sums: dict[int, np.ndarray]) -> Model:
    """Each language's mean cross-entropy a character, and its texts' deviation times the square root of their length."""
    for j, (texts, n, first, second) in sums.items():
        if n:
            model.mean[j] = first / n
            model.spread[j] = max(0.5, float(np.sqrt(max(0.0, second - first * first / n) / texts)))
    return model


def _held_back(nth: int, texts: int) -> bool:
    """A fifth of a language's texts calibrates rejection; of few texts all learn and calibrate."""
    return texts < 5 or nth % 5 == 0


def _learns(nth: int, texts: int) -> bool:
    return texts < 5 or nth % 5 != 0


def train(by_lang: dict[str, list[str]], order: int = ORDER) -> Model | None:
    """A model from labelled texts that are at hand."""
    langs = sorted(k for k, v in by_lang.items() if v)
    if not langs:
        return None
    alphabet = commonest(*letter_counts([t for k in langs for t in by_lang[k]]))
    code, pick = coder(alphabet), lambda f, k: [t for i, t in enumerate(by_lang[k]) if f(i, len(by_lang[k]))]
    counts = [np.unique(np.concatenate([np.zeros(1, np.uint64), *(grams(t, code, order) for t in pick(_learns, k))]), return_counts=True) for k in langs]
    model = build(langs, alphabet, counts, order)
    scorer = Scorer(model)
    return calibrate(model, {j: moments(scorer, j, pick(_held_back, k)) for j, k in enumerate(langs)})


def sample(rows: DataFrame, held: dict[str, int], sample_texts: int, sample_chars: int) -> DataFrame:
    """(lang number, nth, texts, text): the texts to learn from, numbered by hash in each language of ``held`` (label: rows)."""
    spark = rows.sparkSession
    about = spark.createDataFrame([(j, k, min(1.0, 1.2 * sample_texts / held[k])) for j, k in enumerate(sorted(held))], "number int, label string, share double")
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    few = rows.join(F.broadcast(about), F.col("lang") == F.col("label")).withColumn("h", spread).where("h < share")  # a row a language: at most ``languages``
    few = few.groupBy("number", "h", F.sha2("text", 256).alias("same")).agg(F.max("text").alias("text"))
    own = Window.partitionBy("number")
    few = few.withColumns({"nth": F.row_number().over(own.orderBy("h", "same")) - 1, "upto": F.sum(F.length("text")).over(own.orderBy("h", "same").rowsBetween(Window.unboundedPreceding, 0))})
    few = few.where((F.col("nth") < sample_texts) & (F.col("upto") - F.length("text") < sample_chars))
    cut = F.expr(f"substring(text, 1, cast(length(text) - greatest(0, upto - {sample_chars}) as int))")
    return few.select("number", "nth", F.count("*").over(own).alias("texts"), cut.alias("text"))


def fit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = 1500, sample_chars: int = 1 << 22, languages: int = 64, order: int = ORDER, learn: Column | None = None
) -> Model | None:
    """Learn from the labelled rows for which ``learn`` holds."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("learn")).where("learn AND lang IS NOT NULL AND text IS NOT NULL")
    held = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not held:
        return None
    few = materialize(sample(rows.drop("learn"), held, sample_texts, min(sample_chars, CELLS // len(held) ** 2)).repartition(max(1, len(held)), "number"), "sample")

    def of_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, str]]:
        return zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def letters_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            x, n = letter_counts(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(n, pa.int64())], ["letter", "n"])

    found = few.mapInArrow(letters_in, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).toArrow()
    alphabet = commonest(found.column(0).to_numpy().astype(np.uint32), found.column(1).to_numpy())

    def grams_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        code = coder(alphabet)
        for batch in batches:
            own: dict[int, list[np.ndarray]] = {}
            for number, nth, texts, text in of_batch(batch):
                if _learns(nth, texts):
                    own.setdefault(number, []).append(grams(text, code, order))
            for number, keys_of in own.items():
                x, n = np.unique(np.concatenate(keys_of), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number), pa.int64()), pa.array(x.view(np.int64)), pa.array(n, pa.int64())], ["number", "gram", "n"])

    counted = few.mapInArrow(grams_in, "number long, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n")).toArrow()
    number, gram, n = (counted.column(k).to_numpy() for k in range(3))
    counts = []
    for j in range(len(held)):
        key, own = gram[number == j].view(np.uint64), n[number == j]
        key, own = np.append(key, np.uint64(0)), np.append(own, 1)  # spaces alone, so that no language is without an n-gram
        key, place = np.unique(key, return_inverse=True)
        counts.append((key, np.bincount(place, own).astype(np.int64)))
    model = build(sorted(held), alphabet, counts, order)
    sent = spark.sparkContext.broadcast(model.dump())

    def scores_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        scorer = Scorer(Model.load(sent.value))
        for batch in batches:
            own: dict[int, list[str]] = {}
            for number, nth, texts, text in of_batch(batch):
                if _held_back(nth, texts):
                    own.setdefault(number, []).append(text)
            for number, back in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([float(x)]) for x in moments(scorer, number, back))], ["number", "texts", "n", "first", "second"])

    sums = few.mapInArrow(scores_in, "number long, texts double, n double, first double, second double").groupBy("number").agg(*(F.sum(c).alias(c) for c in ("texts", "n", "first", "second"))).collect()
    discard(few)
    sent.unpersist()
    return calibrate(model, {r.number: np.array([r.texts, r.n, r.first, r["second"]]) for r in sums})


_OUT = "id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def predictions(scorer: Scorer | None, texts: list[str | None], reject_at: float, reject_margin: float) -> list[tuple]:
    if scorer is None:
        return [("und", 0.0, None, True)] * len(texts)
    m, out = scorer.m, []
    total, count = scorer.texts(texts)
    for t, n in zip(total, count, strict=True):
        if not n:
            out.append(("und", 0.0, None, True))
            continue
        h = -t / n
        j = int(h.argmin())
        odds = np.exp(np.maximum((h[j] - h) * min(int(n), 40), -700))
        over = h[j] - m.mean[j]
        out.append((m.langs[j], float(1 / odds.sum()), float(h[j]), bool(over > reject_at * m.spread[j] / np.sqrt(n) and over > reject_margin)))
    return out


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 8.0, reject_margin: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, lang_pred, score, cross_entropy, rejected), and the columns named in ``keep``. The model, a few MB at most, is broadcast."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model.dump() if model else b"")

    others = [c for c in keep if c != text_col]
    kept = [f"kept_{i}" for i in range(len(others))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        scorer = Scorer(Model.load(sent.value)) if sent.value else None
        for batch in batches:
            lang, score, h, no = zip(*predictions(scorer, batch.column(1).to_pylist(), reject_at, reject_margin), strict=True) if batch.num_rows else ((), (), (), ())
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[1 if with_text else 2 :]], ["id", "lang_pred", "score", "cross_entropy", "rejected", *["text"][: int(with_text)], *kept])

    with_text = text_col in keep
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(others, kept, strict=True)))
    types = ", text string" * with_text + "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    out = rows.mapInArrow(judge, _OUT + types)
    return out.withColumnsRenamed({"text": f"kept_{text_col}"} | {k: f"kept_{c}" for c, k in zip(others, kept, strict=True)})


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learn=~held_out(F.col("doc_id")))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
