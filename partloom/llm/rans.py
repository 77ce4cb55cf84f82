"""Token-id files: static range asymmetric numeral system over shared frequency tables.

File layout (all integers little-endian):

    4 bytes   magic ``PLR1``
    4 bytes   length of the header
    header    JSON: n_tokens, lanes, and for the table, the document index and every block its
              place (offset from the end of the header, length) and the CRC-32 of its bytes;
              a block also has its number of tokens and the CRC-32 of its decoded ids
    table     zlib: present ids (uint32), then their frequencies out of 2^16 (uint16)
    index     zlib: doc_id (int64), null marks (uint8), tokens (uint32) for each document
    blocks    each: final state of every lane (uint32), then the 16-bit words in reading order

All blocks of a file use its one table.  A block is coded on its own, ``lanes`` interleaved states
wide, so the entries of the header are checkpoints from which blocks are decoded in any order, in
parallel or alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import before, fresh_dir, written
from .tokens import encoder, slices, tokenizer_path

MAGIC = b"PLR1"
SCALE = 16
BLOCK = 1 << 18
LANES = 2048
#: Ids in a file; a task with more of them writes several files.
FILE_TOKENS = 1 << 22


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Present ids and their frequencies, each at least 1, in sum 2^16 - 1.

    One slot stays free, so that no frequency fills the whole range and 32-bit states suffice.
    """
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = (1 << SCALE) - 1
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} different ids; a table holds {total} at most")
    if not len(symbols):
        return symbols.astype("<u4"), np.zeros(0, "<u2")
    spare = total - len(symbols)
    shares = counts / counts.sum() * spare
    freqs = np.floor(shares).astype(np.int64) + 1
    rest = total - int(freqs.sum())
    freqs[np.argsort(-(shares - np.floor(shares)), kind="stable")[:rest]] += 1
    return symbols.astype("<u4"), freqs.astype("<u2")


class Coder:
    """Encodes and decodes blocks of one file's table."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, lanes: int):
        self.symbols, self.lanes = symbols, lanes
        self.freqs = freqs.astype(np.uint32)
        self.starts = (np.cumsum(self.freqs, dtype=np.uint32) - self.freqs).astype(np.uint32)
        self._slots = None

    def encode(self, ranks: np.ndarray) -> bytes:
        """``ranks``: places of a block's ids in the table."""
        lanes = self.lanes
        full = np.full(-(-max(len(ranks), 1) // lanes) * lanes, int(np.argmax(self.freqs)), np.int64)
        full[: len(ranks)] = ranks
        freqs, starts = self.freqs[full].reshape(-1, lanes), self.starts[full].reshape(-1, lanes)
        state = np.full(lanes, 1 << SCALE, np.uint32)
        words = []
        for f, c in zip(freqs[::-1], starts[::-1]):
            over = state >= (f << np.uint32(SCALE))
            words.append(state[over].astype("<u2"))
            state = np.where(over, state >> np.uint32(SCALE), state)
            q = state // f
            state = (q << np.uint32(SCALE)) + (state - q * f) + c
        return state.astype("<u4").tobytes() + np.concatenate(words[::-1]).tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        if self._slots is None:
            place = np.repeat(np.arange(len(self.freqs)), self.freqs)
            place = np.append(place, 0)  # the free slot is never met
            self._slots = self.symbols[place], self.freqs[place], np.arange(len(place), dtype=np.uint32) - self.starts[place]
        symbol, freq, inside = self._slots
        state = np.frombuffer(data, "<u4", self.lanes).astype(np.uint32)
        words = np.frombuffer(data, "<u2", offset=4 * self.lanes).astype(np.uint32)
        steps, at = -(-n // self.lanes), 0
        slots = np.empty((steps, self.lanes), np.uint32)
        low = np.uint32((1 << SCALE) - 1)
        for row in slots:
            np.bitwise_and(state, low, out=row)
            state = freq[row] * (state >> np.uint32(SCALE)) + inside[row]
            under = np.flatnonzero(state < (1 << SCALE))
            state[under] = (state[under] << np.uint32(SCALE)) | words[at : at + len(under)]
            at += len(under)
        return symbol[slots.reshape(-1)[:n]]


def file_bytes(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """One file of ``ids``, the joined ids of the documents."""
    symbols, freqs = frequency_table(ids)
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    coder, body, head = Coder(symbols, freqs, lanes), [], {"n_tokens": len(ids), "lanes": lanes}
    at = 0

    def put(data: bytes) -> dict:
        nonlocal at
        body.append(data)
        at += len(data)
        return {"offset": at - len(data), "length": len(data), "crc": zlib.crc32(data)}

    head["table"] = put(zlib.compress(symbols.tobytes() + freqs.tobytes(), 1))
    nulls = np.array([d is None for d in doc_ids], "u1")
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + nulls.tobytes() + np.array(lengths, "<u4").tobytes()
    head["index"] = put(zlib.compress(index, 1)) | {"documents": len(doc_ids)}
    rank = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    rank[symbols] = np.arange(len(symbols))
    head["blocks"] = []
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK]
        head["blocks"].append(put(coder.encode(rank[part])) | {"tokens": len(part), "ids_crc": zlib.crc32(part.astype("<u4").tobytes())})
    told = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(told)), told, *body])


class Reader:
    """Reads one file; ``fetch(offset, length)`` gives its bytes."""

    def __init__(self, fetch):
        magic, n = struct.unpack("<4sI", fetch(0, 8))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.fetch, self.base = fetch, 8 + n
        self.head = json.loads(fetch(8, n))
        table = zlib.decompress(self._part(self.head["table"]))
        k = len(table) // 6
        self.coder = Coder(np.frombuffer(table, "<u4", k), np.frombuffer(table, "<u2", k, 4 * k), self.head["lanes"])

    def _part(self, entry: dict) -> bytes:
        data = self.fetch(self.base + entry["offset"], entry["length"])
        if zlib.crc32(data) != entry["crc"]:
            raise ValueError("checksum of a part differs")
        return data

    def documents(self) -> tuple[list, np.ndarray]:
        """The doc_ids in file order and their numbers of tokens."""
        n, data = self.head["index"]["documents"], zlib.decompress(self._part(self.head["index"]))
        ids, nulls = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)
        return [None if z else int(d) for d, z in zip(ids, nulls)], np.frombuffer(data, "<u4", n, 9 * n)

    def block(self, i: int) -> np.ndarray:
        entry = self.head["blocks"][i]
        ids = self.coder.decode(self._part(entry), entry["tokens"])
        if zlib.crc32(ids.tobytes()) != entry["ids_crc"]:
            raise ValueError("checksum of a block's ids differs")
        return ids

    def range(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``: only the blocks that hold them are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        joined = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return joined[start - first * BLOCK : start - first * BLOCK + n]


def _filesystem(uri: str):
    """The file system of a Hadoop-style URI, for Python on an executor, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every whole text and write token-id files in ascending doc_id order.

    Null text: only the end id.  Null doc_ids come first, ties by the first 32
    characters of the text, then in any order.  Returns one row per file:
    part, number, path, n_tokens, n_bytes and before_n_tokens (ids of all files before it).  Files
    of failed attempts stay unlisted.  An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-ids")
    end = np.array([end_id], "<u4")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, base = _filesystem(folder)
        task = TaskContext.get()
        part, attempt, encode = task.partitionId(), task.taskAttemptId(), encoder(tokenizer, 900_000).encode_bytes
        ids, docs_in, lengths, held, out = [], [], [], 0, []
        closing = end.tobytes()

        def flush() -> None:
            nonlocal ids, docs_in, lengths, held
            number = len(out)
            path = f"{base}/part-{part:06d}-{number:04d}-{attempt}.plr"
            data = file_bytes(np.frombuffer(b"".join(ids), "<u4"), docs_in, lengths)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(path) as f:
                f.write(data)
            out.append((part, number, path, held, len(data)))
            ids, docs_in, lengths, held = [], [], [], 0

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = encode(text) + closing
                ids.append(coded)
                docs_in.append(doc_id)
                lengths.append(len(coded) // 4)
                held += lengths[-1]
                if held >= FILE_TOKENS:
                    flush()
        if docs_in:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "number", "path", "n_tokens", "n_bytes"])

    # rows of one doc_id, null too, are ranged by how their texts begin, and like ones by their place
    keys = [F.col("doc_id"), F.left("text", F.lit(32)).alias("head"), F.monotonically_increasing_id().alias("place")]
    placed = docs.select("text", *keys).repartitionByRange("doc_id", "head", "place").sortWithinPartitions("doc_id", "head", "place").select("doc_id", "text")
    listed = written(placed.mapInArrow(write, "part long, number long, path string, n_tokens long, n_bytes long"), "token-files")
    return before(listed.withColumn("__at", F.col("part") * (1 << 20) + F.col("number")), "__at", ["n_tokens"]).drop("__at")


def read_token_files(listed: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids (binary)."""
    folder_files = listed.count()

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before_n_tokens").to_pylist()):
                files, local = _filesystem(path)
                with files.open_input_file(local) as f:
                    reader = Reader(lambda offset, n, f=f: f.read_at(n, offset))
                    doc_ids, lengths = reader.documents()
                    ends = np.cumsum(lengths, dtype=np.int64)
                    done, held, pending = 0, [], 0  # ids of blocks that no document has got yet
                    block, taken = 0, 0
                    while done < len(doc_ids):
                        while taken + pending < ends[done]:
                            held.append(reader.block(block).tobytes())
                            pending += len(held[-1]) // 4
                            block += 1
                        upto = int(np.searchsorted(ends, taken + pending, side="right"))
                        data = b"".join(held)
                        starts = ends[done:upto] - lengths[done:upto]
                        cut = [data[4 * (s - taken) : 4 * (e - taken)] for s, e in zip(starts.tolist(), ends[done:upto].tolist())]
                        held, pending, taken = [data[4 * (int(ends[upto - 1]) - taken) :]], taken + pending - int(ends[upto - 1]), int(ends[upto - 1])
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[done:upto], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(lengths[done:upto].astype(np.int64)), pa.array(cut, pa.binary())], names)
                        done = upto

    spread = listed.select("path", "before_n_tokens").repartition(max(1, folder_files))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_rans_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all documents."""
    from .store import documents

    listed = write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 0)
    return read_token_files(listed).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
