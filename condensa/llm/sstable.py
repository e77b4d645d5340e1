"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their 64-bit key::

    data block*   entries, then the crc32 of the entries (u32)
      entry       varint shared | varint unshared | varint size | key suffix | ids
    index         per block: last key (8) | offset u64 | size u32
    Bloom filter  ``bits`` bits, seven probes a key
    footer        80 bytes, see _FOOTER

Keys are the identifier plus 2**63, big-endian, so bytes sort as numbers; an entry leaves out the
prefix it shares with the key before it in its block. ``Shard.get`` asks the Bloom filter, then
finds the block by binary search over the sparse index and reads that block alone.

Scale: documents are ranged by key into partitions; each task encodes its rows and rolls shards at
``shard_bytes``. A shard is written under a temporary name and moved, so a task that runs again
replaces it by the same bytes. The manifest (a row a shard) gives the running start of each shard.

Defined cases: null texts are empty documents and hold the end id alone. Rows with a null key have
no place in a keyed file and are left out. Rows that repeat a key are all kept, in order of their
text's hash and text, in as many ranges as they fill. An empty table writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, partitions, table, work_dir
from .tokens import default_path, encoder

MAGIC = b"CSST0001"
_FOOTER = struct.Struct("<QQQQQQ8s8sHHI8s")
_INDEX = struct.Struct("<8sQI")
_PROBES = 7
MANIFEST = "shard string, first_id long, last_id long, documents long, tokens long, bytes long"


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _bloom_probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(_PROBES)]


#: Schemes of Hadoop's connectors and what the same stores are called in Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def _file(uri: str):
    """Arrow's file system for a folder as Spark names it: local, S3, Google, Azure, or HDFS where libhdfs is installed."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")


class ShardWriter:
    """Collects entries in key order and writes them at ``close``; memory is bounded by the shard's size."""

    def __init__(self, dtype: str, block_bytes: int = 64 << 10):
        self.width, self.block_bytes = np.dtype(dtype).itemsize, block_bytes
        self.done: list[bytes] = []
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.offset = self.tokens = 0
        self.block = bytearray()
        self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // self.width
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.done.append(raw)
            self.index.append(_INDEX.pack(self.last, self.offset, len(raw)))
            self.offset += len(raw)
            self.block = bytearray()

    @property
    def size(self) -> int:
        return self.offset + len(self.block)

    def close(self, uri: str) -> int:
        self._end_block()
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _bloom_probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        footer = _FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.keys), self.tokens, self.keys[0], self.keys[-1], self.width, _PROBES, zlib.crc32(index + bytes(bloom)), MAGIC)
        fs, path = _file(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with fs.open_output_stream(temporary) as out:
                for raw in self.done:
                    out.write(raw)
                out.write(index + bytes(bloom) + footer)
            fs.move(temporary, path)
        except BaseException:
            with contextlib.suppress(OSError):
                fs.delete_file(temporary)
            raise
        return self.offset + len(index) + len(bloom) + len(footer)


class Shard:
    def __init__(self, uri: str):
        fs, path = _file(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.first, self.last, width, _, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        index, self.bloom = self.file.read_at(n, at), self.file.read_at(bloom_n, bloom_at)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"{uri}: its index is damaged")
        self.dtype = f"<u{width}"
        self.blocks = list(_INDEX.iter_unpack(index))
        self.block_last = [b[0] for b in self.blocks]

    def _entries(self, block: tuple[bytes, int, int]) -> Iterator[tuple[bytes, bytes]]:
        raw = self.file.read_at(block[2], block[1])
        body, (crc,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            unshared, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + unshared]
            at += unshared
            yield key, body[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for block in self.blocks:
            for key, ids in self._entries(block):
                yield id_of(key), np.frombuffer(ids, dtype=self.dtype)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each row with this key; usually one, none if it isn't there."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_probes(key, 8 * len(self.bloom))):
            return []
        found = []
        for block in self.blocks[bisect_left(self.block_last, key) :]:
            got = [np.frombuffer(ids, dtype=self.dtype) for k, ids in self._entries(block) if k == key]
            found += got
            if not got or block[0] > key:
                break
        return found


def write_shards(docs: DataFrame, out: str, path: str, end_id: int = 0, shards: int | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes and writes ``docs`` (doc_id, text) under ``out``; returns the manifest, already run once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, part = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=model.dtype).tobytes()
        writer = ShardWriter(model.dtype)
        rows: list[dict] = []

        def close() -> None:
            nonlocal writer, part
            if writer.keys:
                name = f"{out}/shard-{task:06d}-{part:04d}.sst"
                rows.append({"first_id": id_of(writer.keys[0]), "last_id": id_of(writer.keys[-1]), "documents": len(writer.keys), "tokens": writer.tokens, "shard": name, "bytes": writer.close(name)})
                writer, part = ShardWriter(model.dtype), part + 1

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 1000):
                for key, ids in zip(keys[at : at + 1000], model.encode(texts[at : at + 1000].to_pylist())):
                    writer.add(key_of(key), ids + end)
                    if writer.size >= shard_bytes:
                        close()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "documents", "tokens", "bytes"))]))

    n = shards or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    order = ["doc_id"]
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Texts are hashed only where an id alone doesn't tell rows apart.
        rows, order = rows.withColumn("hash", F.xxhash64("text")), ["doc_id", "hash"]
    return cut(map_arrow(rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text"), run, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for uri, start in zip(x.shard, x.start):
                rows = []
                for doc_id, ids in Shard(uri):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype("int64")

    before = F.sum("tokens").over(Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    n = max(1, min(manifest.count(), 4 * partitions(manifest.sparkSession)))
    return starts.select("shard", "start").repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, work_dir(spark, "shards"), default_path()))
