"""Texts as 8-bit greyscale PNG columns: written, read back with checksum tests, and hashed.

The reader takes any non-interlaced 8-bit greyscale PNG: it tests each chunk's CRC-32 and zlib's
Adler-32, and undoes all five row filters.  The feature is the sign pattern of the lowest 8 x 8
cosine-transform coefficients of the picture, averaged to 32 x 32, against their median.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed data in one IDAT chunk.
IDAT = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of the width; null counts as empty."""
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def write_png(data: bytes, width: int = WIDTH) -> bytes:
    """A PNG of rows of ``width`` samples; each row has the filter (none, left, above) of least sum."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above[1:] -= rows[:-1]
    tried = np.stack([rows, left, above])
    kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    filtered = np.empty((len(rows), width + 1), np.uint8)
    filtered[:, 0] = kind
    filtered[:, 1:] = tried[kind, np.arange(len(rows))]
    packed = zlib.compress(filtered.tobytes(), 4)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of 8-bit samples: runs of one kind at once where that is possible."""
    out, i = np.empty_like(rows), 0
    while i < len(rows):
        kind = kinds[i]
        end = i + 1
        while end < len(rows) and kinds[end] == kind:
            end += 1
        above = out[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[i:end] = rows[i:end]
        elif kind == 1:
            out[i:end] = np.cumsum(rows[i:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[i:end] = np.cumsum(np.vstack([above, rows[i:end]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for j in range(i, end):
                up = [int(v) for v in (out[j - 1] if j else above)]
                line, a, c = rows[j].tolist(), 0, 0
                for x, b in enumerate(up):
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a = line[x] = (line[x] + guess) & 255
                    c = b
                out[j] = line
        else:
            raise ValueError(f"unknown filter {kind}")
        i = end
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples, rows x columns; a ValueError for a wrong signature, checksum, length or kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("chunk is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("checksum of a chunk differs")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    table = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(table[:, 0], table[:, 1:])


def _cosines(n: int = 32) -> np.ndarray:
    k = np.arange(8)[:, None]
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * k)


_COS = _cosines()


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed their median."""
    sides = []
    for axis, n in enumerate(pixels.shape):
        edges = np.arange(33) * n // 32
        sides.append((edges[:-1], np.maximum(edges[1:] - edges[:-1], 1)))
    (top, rows), (left, columns) = sides
    small = pixels if len(pixels) < 32 else np.add.reduceat(pixels, top, axis=0, dtype=np.int64)
    if len(pixels) < 32:
        small, rows = pixels[top].astype(np.int64), np.ones(32, np.int64)
    if pixels.shape[1] < 32:
        small, columns = small[:, left], np.ones(32, np.int64)
    else:
        small = np.add.reduceat(small, left, axis=1)
    low = _COS @ (small / rows[:, None] / columns[None, :]) @ _COS.T
    return np.packbits(low > np.median(low)).tobytes()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text, before padding) and media (binary PNG) of every row.

    A null text is stored like an empty one.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            media = [write_png(payload(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (the samples read back) and hash (binary) of each picture.

    Null media give null payload and hash; a damaged picture fails the task.
    """

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            samples = [None if x is None else read_png(x) for x in batch.column(2).to_pylist()]
            columns = [[None if p is None else f(p) for p in samples] for f in (np.ndarray.tobytes, cosine_hash)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "n_bytes", "media", "payload", "hash"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, "doc_id long, n_bytes long, media binary, payload binary, hash binary")


def op4_png_media(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over all documents."""
    from .store import documents

    docs = documents(spark, sf_dir)
    read = media_features(to_media(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
