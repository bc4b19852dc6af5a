"""Token ids as sorted-string-table shards: binary files that are looked up by document id.

A shard holds documents in ascending order of their key: prefix-compressed entries in blocks, a sparse index with the
first key of each block, a Bloom filter over the keys, and a fixed footer. Keys sort as bytes: a null id first, then
ids in signed order, then the number of the row among equal ids. Ids are kept in two bytes where all of them fit.

Defined results: a null text counts as empty and holds only the end id; rows with a null id sort first; rows that
repeat an id follow each other in the order of a hash of their text; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, small_batches, tidy, written
from .tokens import MEMO, encoder, file_bytes

MAGIC = b"TLSST1\0\0"
FOOTER = struct.Struct("<QQQQQQI4x8s")  # index at, size; Bloom at, size; documents; tokens; hashes; magic
BLOCK = 1 << 16
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", nth)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_bits(key: bytes, n_bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + j * b) % n_bits for j in range(hashes)]


class Writer:
    """Writes one shard to an open binary sink; keys must come in ascending order."""

    def __init__(self, sink):
        self.sink, self.at, self.n_docs, self.n_tokens = sink, 0, 0, 0
        self._index: list[tuple[bytes, int, int]] = []
        self._keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self._block, self._restarts, self._previous, self._n = bytearray(), [], b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self._n % RESTART == 0:
            self._restarts.append(len(self._block))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self._previous, strict=True)) if x != y), len(key))
        if not self._n:
            self._first = key
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = ids.astype(f"<u{width}").tobytes()
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + bytes([width]) + key[shared:] + value
        self._previous, self._n = key, self._n + 1
        self._keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self._block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self._n:
            return
        data = bytes(self._block) + struct.pack(f"<{len(self._restarts)}I", *self._restarts) + struct.pack("<I", len(self._restarts))
        self._index.append((self._first, self.at, len(data)))
        self.sink.write(data)
        self.at += len(data)
        self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(k + struct.pack("<QQ", at, size) for k, at, size in self._index)
        n_bits = max(64, len(self._keys) * BLOOM_BITS)
        bloom = bytearray((n_bits + 7) // 8)
        for key in self._keys:
            for bit in _bloom_bits(key[:9], n_bits, BLOOM_HASHES):
                bloom[bit >> 3] |= 1 << (bit & 7)
        bloom = struct.pack("<Q", n_bits) + bytes(bloom)
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_tokens, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads one shard from a random-access file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        at, size, bloom_at, bloom_size, self.n_docs, self.n_tokens, self._hashes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self._bloom_at, self._bloom_size, self._bloom = bloom_at, bloom_size, None
        raw = self._span(at, size)
        step = 13 + 16
        self._first = [raw[i : i + 13] for i in range(0, size, step)]
        self._where = [struct.unpack("<QQ", raw[i + 13 : i + step]) for i in range(0, size, step)]

    def _span(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    @staticmethod
    def _entry(data, at: int, previous: bytes) -> tuple[bytes, np.ndarray, int]:
        shared, at = _read_varint(data, at)
        own, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        width, at = data[at], at + 1
        key = previous[:shared] + data[at : at + own]
        at += own
        return key, np.frombuffer(data, f"<u{width}", size // width, at), at + size

    def _entries(self, block: int, at: int = 0, data: bytes | None = None) -> Iterator[tuple[bytes, np.ndarray]]:
        data = data or self._span(*self._where[block])
        (restarts,) = struct.unpack("<I", data[-4:])
        end, key = len(data) - 4 - 4 * restarts, b""
        while at < end:
            key, ids, at = self._entry(data, at, key)
            yield key, ids

    def scan(self) -> Iterator[list[tuple[int | None, np.ndarray]]]:
        """All documents in order, a block at a time."""
        for b in range(len(self._where)):
            yield [(id_of(k), ids) for k, ids in self._entries(b)]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this document id: Bloom filter, then binary search over blocks and restarts."""
        if self._bloom is None:
            self._bloom = self._span(self._bloom_at, self._bloom_size)
        (n_bits,) = struct.unpack("<Q", self._bloom[:8])
        want = key_of(doc_id)
        if not all(self._bloom[8 + (bit >> 3)] >> (bit & 7) & 1 for bit in _bloom_bits(want[:9], n_bits, self._hashes)):
            return []
        out = []
        for b in range(max(0, bisect_right(self._first, want) - 1), len(self._where)):
            data = self._span(*self._where[b])
            (n,) = struct.unpack("<I", data[-4:])
            restarts = struct.unpack(f"<{n}I", data[-4 - 4 * n : -4])
            lo = bisect_right(restarts, want, key=lambda at: self._entry(data, at, b"")[0]) - 1
            for key, ids in self._entries(b, restarts[max(0, lo)], data):
                if key[:9] == want[:9]:
                    out.append(ids)
                elif key > want:
                    return out
        return out


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def _write(folder: str, sent, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(sent, remembered), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        uri, writer, last, nth = f"{folder}/shard-{task:06d}-{uuid.uuid4().hex}.sst", None, object(), 0
        sink = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    fs, path = _open(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(path)
                    writer = Writer(sink)
                nth = nth + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, nth), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task], pa.int32()), "uri": [uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})
        tidy()

    return run


def write_shards(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remembered: int = MEMO) -> DataFrame:
    """Write all documents; returns the manifest: shard, uri, n_docs, n_tokens, in the order of the shards' ids.

    Shards are ranges of ids, as many as the session's shuffle partitions. A task that is run again writes a file of
    another name; only files that the written manifest names count.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "sstable")
    sent = spark.sparkContext.broadcast(file_bytes(tokenizer_path))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(_write(folder, sent, end_id, remembered), "shard int, uri string, n_docs long, n_tokens long"), "sstable-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = _open(row["uri"])
            with fs.open_input_file(path) as source:
                at = row["start"]
                for block in Reader(source).scan():
                    starts = []
                    for _, ids in block:
                        starts.append(at)
                        at += len(ids)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in block]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in block], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) for _, i in block], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("start")).repartition(n)
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document: shards that lack it are ruled out by their Bloom filters."""
    out = []
    for row in manifest.orderBy("shard").toLocalIterator():
        fs, path = _open(row["uri"])
        with fs.open_input_file(path) as source:
            out += Reader(source).get(doc_id)
    return out
