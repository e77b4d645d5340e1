"""What the operators of this package share: the shared folder, checkpoints, text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import posixpath
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir  # noqa: F401

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
WORD_BYTE[128:] = True

#: An odd multiplier and its inverse modulo 2**64: hashes of byte ranges come from one prefix sum.
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    return posixpath.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


#: Rows an Arrow batch, where the session has Spark's own default: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def _released() -> None:
    """Gives what a task has freed back to the system: workers live on, and their heaps would only grow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _lean(function):
    def run(batches):
        try:
            yield from function(batches)
        finally:
            _released()

    return run


def _small_batches(df: DataFrame) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches, with memory given back after each task."""
    _small_batches(df)
    return df.mapInArrow(_lean(function), schema)


def map_pandas(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInPandas`` likewise."""
    _small_batches(df)
    return df.mapInPandas(_lean(function), schema)


#: Parts of a table that tasks sum: number of the part, its rows that were touched, their values (and what a sum of a single number needs).
BLOCKS = "block long, places binary, sums binary"


def touched_blocks(total: np.ndarray, part: int, extra: float | None = None) -> pa.RecordBatch:
    """The rows of a task's table that aren't all zeros, in parts of ``part`` rows; ``extra`` goes along as part -1."""
    rows = np.flatnonzero(total.any(axis=1))
    cuts = np.flatnonzero(np.diff(rows // part)) + 1
    pieces = [x for x in np.split(rows, cuts) if len(x)]
    blocks = [int(x[0]) // part for x in pieces]
    at, sums = [x.astype(np.int32).tobytes() for x in pieces], [total[x].astype(np.float32).tobytes() for x in pieces]
    if extra is not None:
        blocks, at, sums = [-1, *blocks], [b"", *at], [np.float64(extra).tobytes(), *sums]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(at, pa.binary()), pa.array(sums, pa.binary())], names=["block", "places", "sums"])


def summed_blocks(blocks: DataFrame, width: int, part: int, slices: int = 16) -> Iterator[tuple[np.ndarray | None, np.ndarray | float]]:
    """Rows and their sums over all tasks, first over slices of the tasks; None and a number for what went along."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        extra: list[float] = []
        for x in batches:
            for b, places, raw in zip(x.block, x.places, x.sums):
                if b < 0:
                    extra.append(float(np.frombuffer(raw)[0]))
                    continue
                if b not in total:
                    total[b] = np.zeros(part, bool), np.zeros((part, width))
                at = np.frombuffer(places, np.int32) - b * part
                total[b][0][at] = True
                total[b][1][at] += np.frombuffer(raw, np.float32).reshape(-1, width)
        rows = [(b, (np.flatnonzero(met) + b * part).astype(np.int32).tobytes(), sums[met].tobytes()) for b, (met, sums) in total.items()]
        rows += [(-1, b"", np.float64(sum(extra)).tobytes())] if extra else []
        yield pd.DataFrame(rows, columns=["block", "places", "sums"]).astype({"block": "int64"})

    n = max(1, min(partitions(blocks.sparkSession), 64))
    sliced = blocks.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    for r in map_pandas(sliced.repartition(n, "block", "slice").drop("slice"), add, BLOCKS).toLocalIterator():
        if r.block < 0:
            yield None, float(np.frombuffer(r.sums)[0])
        else:
            yield np.frombuffer(r.places, np.int32), np.frombuffer(r.sums).reshape(-1, width)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _B), ("down", _B_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POW[key] = np.cumprod(p, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of ``raw``."""
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * down[start])


def encoded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes: runs of ASCII letters and digits and of all non-ASCII bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = WORD_BYTE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, hash_ranges(raw, start, end)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a whole text, in order."""
    return _words(np.frombuffer(encoded(text), dtype=np.uint8))[1]


def many_word_hashes(texts: Iterable[str | None], group_bytes: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of whole texts: the word hashes of all, and where each text's words begin (and the end)."""
    group: list[bytes] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray]:
        start, words = _words(np.frombuffer(b"\n".join(group), dtype=np.uint8))
        at = np.cumsum([0] + [len(x) + 1 for x in group])
        return words, np.searchsorted(start, at)

    for text in texts:
        group.append(encoded(text))
        size += len(group[-1])
        if size >= group_bytes:
            yield done()
            group, size = [], 0
    if group:
        yield done()


def many_shingle_hashes(texts: Iterable[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of the words of each text, a group at a time."""
    for words, at in many_word_hashes(texts):
        every = shingle_hashes(words, k)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            yield every[i : j - k + 1] if j - i >= k else shingle_hashes(words[i:j], k)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_B) + words[i : n - k + 1 + i]
    return mix64(out + np.uint64(k))
