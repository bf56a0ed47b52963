"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

``find_secrets`` gives each row its list of spans (kind, start, end), in code points, ends exclusive. Kinds ``assign``,
``access`` and ``hex`` are the fixed patterns. Kind ``token`` is the method's: a run of 20 or more base-64 characters
whose characters per token under a public byte-pair vocabulary are at most ``max_ratio``; common strings of that length
are made of long tokens, random ones are not. Known digests (hexadecimal of a digest's length), UUIDs and identifiers
are left out, and so is what overlaps a fixed span. An identifier's segments are numbers, or words with at most a short
number; a word has more than ``max_ratio`` characters a token itself, or is a token: letter case alone makes no word.

Cases: null and empty texts give an empty list; null ids and repeated rows are kept row for row; spans are sorted by
start, then kind in the order above; whole texts are scanned, whatever their length; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ship, table

KINDS = ("assign", "access", "hex", "token")
_ANYCASE = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_NAMES = "|".join([*map(_ANYCASE, ("password", "passwd", "secret", "token")), _ANYCASE("api") + "_?" + _ANYCASE("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
NEEDED = ("pass", "secret", "token", "key")  # an assignment's name holds one of these
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of two small letters or more, capitals before or after, and a short number; possessive, so that each character is read once.
WORDS = re.compile(r"(?:[A-Z]*+[a-z]{2,}+)*+(?:[A-Z]{2,}+)?+[0-9]{0,4}+|[0-9]++")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("assay", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str, encode, max_ratio: float) -> bool:
    """Is it a digest, a UUID or an identifier?"""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True

    def worded(segment: str) -> bool:
        letters = segment.rstrip("0123456789")
        n = len(encode(letters)) if WORDS.fullmatch(segment) else None
        return n is not None and (n <= 1 or len(letters) > max_ratio * n)

    return all(map(worded, re.split(r"[+/_=-]+", run)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if any(x in low for x in NEEDED) else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def covered(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order, each once."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans_of(text: str, encode, max_ratio: float) -> list[tuple[str, int, int]]:
    found = base_spans(text)
    taken, k = covered(found), 0
    for m in RUN.finditer(text):
        run, (a, b) = m.group(), m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and len(run) <= max_ratio * len(encode(run)) and not known(run, encode, max_ratio):
            found.append(("token", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, max_ratio: float = 2.0) -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>)."""
    ship(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path).encode_ordinary
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", encode, max_ratio)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN)], ["id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, spans array<struct<kind: string, start: long, `end`: long>>")


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k) for k in KINDS),
        F.sha2(F.expr(said("filter(spans, s -> s.kind != 'token')")), 256).alias("base_sha256"),
        F.expr(said("spans")).alias("spans"),
    )
