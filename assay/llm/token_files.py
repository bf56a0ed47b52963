"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

``write_tokens`` encodes every text, appends an end id, ranks ids by how often all texts use them (the commonest is 0; ties by
id) and writes blocks of documents in ascending order of id to a folder: ``blocks`` holds (part, block, body), parts and
blocks in order, and ``ranks`` the ids by rank. A body is

    magic "ASTK1\\n\\0\\0", uint32 documents, uint32 tokens, then
    documents x uint8 (1: the id is null), documents x int64 ids, documents x uint32 token counts,
    ceil(tokens / 4) control bytes, data bytes.

Two bits of a control byte, lowest first, give the bytes less one of each of four ranks; data bytes are little-endian.
``read_tokens`` decodes the bodies in numpy: a table of 256 rows turns control bytes to lengths, running sums to places.
The files are Parquet tables with binary columns: any store that Spark reaches holds them, writers may fail and be run again.

Cases: null and empty texts are just the end id; equal ids are ordered by their token ids' hash, and equal rows each have
their own place; null ids come first; a document longer than a block is a block of its own; an empty table writes no block;
extra columns are not read; texts are encoded whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import discard, forget_others, materialize, scratch_path, ship, table
from assay.llm.tokenize import tokens
from assay.llm.words import raw

MAGIC = b"ASTK1\n\0\0"
BLOCK_TOKENS = 1 << 18
END_ID = 2

#: For each control byte its four lengths.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 values."""
    v = np.ascontiguousarray(values, "<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8)[None, :] < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    end = np.cumsum(length, dtype=np.int64)
    raw, at = np.frombuffer(data + bytes(3), np.uint8), end - length
    if count and end[-1] != len(data):
        raise ValueError("data bytes do not fit the control bytes")
    out = raw[at].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(length > j)
        if not more.size:
            break
        out[more] |= raw[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def body_of(ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join(
        [MAGIC, struct.pack("<II", len(ids), len(ranks)), bytes(i is None for i in ids), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), control, data]
    )


def parse(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, ranks) of a block."""
    if body[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    n, m = struct.unpack_from("<II", body, 8)
    at = 16 + n
    null = body[16:at]
    ids = np.frombuffer(body, "<i8", n, at).tolist()
    counts = np.frombuffer(body, "<u4", n, at + 8 * n)
    at += 12 * n
    data = at + -(-m // 4)
    return [None if z else i for z, i in zip(null, ids, strict=True)], counts, unpack(body[at:data], body[data:], m)


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str | None, end_id: int) -> DataFrame:
    """Rows (id, mark, ids): the text's token ids, the end id included, as little-endian 16- or 32-bit numbers."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("tokens")
        coder = tokens(vocabulary_path)
        for batch in batches:
            flat, upto = [np.empty(0, coder.dtype)], [np.zeros(1, np.int64)]
            for ids, ends in coder.encode(batch.column(1), end_id):
                flat.append(ids), upto.append(ends + upto[-1][-1])
            data, at = np.concatenate(flat).tobytes(), np.concatenate(upto) * coder.dtype.itemsize
            view, cut = memoryview(data), at.tolist()
            mark = [zlib.crc32(view[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            held = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark, pa.int64()), held], ["id", "mark", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, mark long, ids binary")


def vocabulary_size(spark, vocabulary_path: str | None) -> int:
    """As an executor reads it: the driver needn't hold a tokenizer."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("tokens")
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens(vocabulary_path).size], pa.int64())], ["size"])

    return spark.range(1, numPartitions=1).mapInArrow(size, "size long").collect()[0][0]


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write all documents of df to the folder, in ascending order of id."""
    spark = df.sparkSession
    texts = materialize(encode(df, id_col, text_col, vocabulary_path, end_id), "tokens")
    known = vocabulary_size(spark, vocabulary_path)
    size, dtype = max(known, end_id + 1), np.dtype("<u2" if known <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(raw(batch.column(0))[0].view(dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    # At most a row an id of the vocabulary.
    used = texts.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = used.column(0).to_numpy().astype(np.int64), used.column(1).to_numpy().astype(np.int64)
    ranked = token[np.lexsort((token, -n))]
    rank = np.zeros(size, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        ids, counts, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, parts, held, block
            row = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([body_of(ids, counts, np.concatenate(parts))], pa.binary())]
            ids, counts, parts, held, block = [], [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(row, ["part", "block", "tokens", "body"])

        for batch in batches:
            data, offsets = raw(batch.column(1))
            ranks, at = sent.value[data.view(dtype)], (offsets // dtype.itemsize).tolist()
            for i, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                if held and held + b - a > block_tokens:
                    yield flush()
                ids.append(i), counts.append(b - a), parts.append(ranks[a:b])
                held += b - a
        if held:
            yield flush()

    ordered = texts.repartitionByRange(F.col("id").asc_nulls_first(), F.col("mark")).sortWithinPartitions(F.col("id").asc_nulls_first(), "mark").select("id", "ids")
    ordered.mapInArrow(blocks, "part long, block long, tokens long, body binary").write.parquet(f"{folder}/blocks", compression="zstd")
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(ranked)), pa.int64()), "token": pa.array(ranked)})).coalesce(1).write.parquet(f"{folder}/ranks")
    discard(texts)
    sent.unpersist()


def read_tokens(spark, folder: str) -> DataFrame:
    """Rows (part, block, nth, id, offset, n_tokens, ids): each document's token ids as little-endian uint32, decoded from the files; offset counts the block's tokens before it."""
    ship(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").toArrow()
    token = np.zeros(ranks.num_rows, "<u4")
    token[ranks["rank"].to_numpy()] = ranks["token"].to_numpy()
    sent = spark.sparkContext.broadcast(token)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts, r = parse(body)
                flat, start = sent.value[r], np.cumsum(counts, dtype=np.int64) - counts
                own = [flat[a : a + n].tobytes() for a, n in zip(start, counts, strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64()), pa.array(start), pa.array(counts.astype(np.int64)), pa.array(own, pa.binary())],
                    ["part", "block", "nth", "id", "offset", "n_tokens", "ids"],
                )

    # Bodies are up to a few MB each, so a few at a time.
    return spark.read.parquet(f"{folder}/blocks").select("part", "block", "body").mapInArrow(decode, "part long, block long, nth long, id long, offset long, n_tokens long, ids binary")


def starts(spark, folder: str) -> DataFrame:
    """Rows (part, block, base): the tokens of all blocks before. Sums run over parts first, then inside each."""
    held = spark.read.parquet(f"{folder}/blocks").select("part", "block", "tokens")
    whole = held.groupBy("part").agg(F.sum("tokens").alias("n"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("part", F.coalesce(F.sum("n").over(up_to(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = held.withColumn("inside", F.coalesce(F.sum("tokens").over(up_to(Window.partitionBy("part").orderBy("block"))), F.lit(0)))
    return inside.join(whole, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))


def summary(spark, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), read back from the files."""
    read = read_tokens(spark, folder).select("part", "block", "id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    placed = read.join(starts(spark, folder), ["part", "block"])
    return placed.select(F.col("id").alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return summary(spark, folder)
