"""Media columns: byte payloads kept as PNG images in binary columns, read back with checksum tests, and hashed.

``to_media`` stores a text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an 8-bit grey PNG 64 samples wide;
``from_media`` reads any non-interlaced 8-bit PNG back. Every chunk's CRC-32 is tested; samples are unfiltered in numpy.
``feature`` is a 64-bit hash: the image is area-averaged to 32 x 32, its cosine transform's 8 x 8 lowest frequencies are
compared with their median (the constant term is left out).

Cases: null and empty texts give one row of 64 zero bytes and the hash of a flat image, 16 zeros; null ids and repeated
rows are kept row for row; an empty table gives an empty table; extra columns are not read; a text of any length is one
image. ``from_media`` gives null for null media and raises ValueError on a damaged one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ship, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # samples a pixel, by PNG colour type


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6, chunk_bytes: int = 1 << 16) -> bytes:
    """A grey 8-bit PNG of a (height, width) uint8 array; each row takes the filter with the smallest sum of absolute differences."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (samples, sub, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0] = kind
    raw[:, 1:] = np.where((kind == 0)[:, None], samples, np.where((kind == 1)[:, None], sub, up))
    packed = zlib.compress(raw.tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", packed[i : i + chunk_bytes]) for i in range(0, len(packed), chunk_bytes)) + _chunk(b"IEND", b"")


def unfilter(kind: np.ndarray, body: np.ndarray, pixel: int) -> np.ndarray:
    """Undo PNG's row filters; body is (height, bytes a row). Rows of None, Sub and Up are done in bulk; Average and Paeth need a walk."""
    if kind.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    out = body.copy()
    height, stride = out.shape
    rows = np.flatnonzero(kind == 1)
    if rows.size:
        for c in range(pixel):
            out[rows, c::pixel] = np.cumsum(out[rows, c::pixel], axis=1, dtype=np.uint8)
    if not (kind > 2).any():
        # A run of Up rows is a running sum that starts at the last row of another kind.
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        start = np.maximum.accumulate(np.where(kind != 2, np.arange(height), 0))
        base = total[start] - np.where((kind[start] == 2)[:, None], total[start], out[start])
        return np.where((kind == 2)[:, None], total - base, out)
    zero = np.zeros(stride, np.uint8)
    for y in range(height):
        above = out[y - 1] if y else zero
        if kind[y] == 2:
            out[y] += above
        elif kind[y] > 2:
            a, b = [0] * (stride + pixel), [0] * pixel + above.tolist()
            for x, v in enumerate(out[y].tolist(), pixel):
                left, top, corner = a[x - pixel], b[x], b[x - pixel]
                if kind[y] == 3:
                    guess = (left + top) // 2
                else:
                    p = left + top - corner
                    pa_, pb, pc = abs(p - left), abs(p - top), abs(p - corner)
                    guess = left if pa_ <= pb and pa_ <= pc else top if pb <= pc else corner
                a[x] = (v + guess) & 255
            out[y] = a[pixel:]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(height, width * samples a pixel) uint8; ValueError if a signature, length, checksum, header or filter is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size:
            raise ValueError("cut short")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[4:] != (0, 0, 0):
        raise ValueError("only non-interlaced 8-bit images")
    width, height, pixel = header[0], header[1], CHANNELS[header[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != height * (width * pixel + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, width * pixel + 1)
    return unfilter(raw[:, 0], raw[:, 1:], pixel)


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Area means of x's first axis, in n equal parts (parts may cut a sample)."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    edges = np.linspace(0, len(x), n + 1)
    low = np.minimum(edges.astype(np.int64), len(x) - 1)
    at = total[low] + (edges - low)[:, None] * (total[low + 1] - total[low])
    return np.diff(at, axis=0) * (n / len(x))


_COSINE = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)


def dct_hash(samples: np.ndarray) -> str:
    """64-bit low-frequency cosine-transform hash, 16 hex digits; its first bit, the constant term's, is 0."""
    if not samples.size:
        return "0" * 16
    small = _shrink(_shrink(samples, 32).T, 32).T
    low = np.round(_COSINE @ small @ _COSINE.T, 4).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, media = [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            n_bytes.append(len(raw))
            payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
            media.append(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload, feature = [], []
        for data in batch.column(2).to_pylist():
            image = None if data is None else decode_png(data)
            payload.append(None if image is None else image.tobytes())
            feature.append(None if image is None else dct_hash(image))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], ["id", "n_bytes", "media", "payload", "feature"])


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): the text's unpadded length in bytes and its PNG."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Rows (id, n_bytes, media, payload, feature): the stored samples read back, and the image's hash."""
    ship(media.sparkSession)
    return media.select("id", "n_bytes", "media").mapInArrow(_load, "id long, n_bytes long, media binary, payload binary, feature string")


def op1_media_columns(spark, sf_dir) -> DataFrame:
    read = from_media(to_media(table(spark, sf_dir, "documents")))
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
