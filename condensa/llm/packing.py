"""Packing by minimum bin slack.

Documents longer than a window are cut into whole windows and a rest. The rests are packed from
the histogram of their lengths alone, which has at most ``capacity`` rows whatever the input: each
window starts with the longest length left, a bitset subset-sum over the remaining multiset finds
the fill closest to capacity, and the counts are read back from the bitsets. That pattern is used
as often as the remaining counts allow. Pieces then look up their place by their rank among the
pieces of their length.

Scale: a rank is a piece's number within (length, hash slice) plus the count of the slices before
it, so no task gets all pieces of one length. Only the histogram reaches the driver.

Defined cases: null texts are empty documents, which hold the end id alone; rows with a null id
are packed like others; rows that repeat an id are packed each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table
from .tokens import default_path, encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def min_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length in a window) and how often each is used, in order."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is not within the window")
    order = sorted(left, reverse=True)
    out: list[tuple[dict[int, int], int]] = []
    while order:
        seed = order[0]
        target = capacity - seed
        reach, mask, trail = 1, (1 << (target + 1)) - 1, []
        for n in order:
            if n > target:
                continue
            trail.append((n, reach))
            rest, step = min(left[n] - (n == seed), target // n), 1
            while rest > 0:
                take = min(step, rest)
                reach |= reach << (n * take) & mask
                rest, step = rest - take, 2 * step
            if reach >> target & 1:
                break
        fill = reach.bit_length() - 1
        pattern = {seed: 1}
        for n, before in reversed(trail):
            while not before >> fill & 1:
                pattern[n] = pattern.get(n, 0) + 1
                fill -= n
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= c * times
        order = [n for n in order if left[n]]
        out.append((pattern, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, in order of rank: first rank, pieces in a window, first sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n, c in sorted(pattern.items(), reverse=True):
            out.setdefault(n, []).append((used.get(n, 0), c, sequence, offset))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = 2048, order_by: tuple[str, ...] = ("doc_id", "start"), slice_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""
    # Pieces that agree in all of ``order_by`` are dealt out by the partition that they were made in.
    pieces = cut(pieces.withColumn("_made", F.spark_partition_id()))
    sizes = pieces.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in sizes}
    places = _places(min_bin_slack(counts, capacity))
    slices = max(64, math.ceil(sum(counts.values()) / slice_rows))
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order_by, "_made"), F.lit(slices)))
    by_slice = pieces.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    by_slice = by_slice.select("length", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order_by))
    ranked = pieces.withColumn("_rank", within).join(by_slice, ["length", "_slice"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n, rank = x.length.to_numpy(), x.pop("_rank").to_numpy()
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for size in np.unique(n):
                at = np.flatnonzero(n == size)
                rows = places[int(size)]
                first, c, seq, off = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1].T
                sequence[at] = seq + (rank[at] - first) // c
                offset[at] = off + (rank[at] - first) % c * size
            yield x.assign(sequence_id=sequence, offset=offset)

    kept = [c for c in ranked.columns if c not in ("_slice", "_before", "_made")]
    ranked = ranked.select(kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pieces of every document's ids: whole windows, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        end = np.array([end_id], dtype=model.dtype).tobytes()
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for at in range(0, len(keys), 1000):
                for key, raw in zip(keys[at : at + 1000], model.encode(texts[at : at + 1000].to_pylist())):
                    ids = memoryview(np.frombuffer(raw + end, dtype=model.dtype).astype("<u4").tobytes())
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        stop = min(start + capacity, n)
                        rows.append((key, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, _PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    return pack(token_pieces(docs, path or default_path(), end_id, capacity), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
