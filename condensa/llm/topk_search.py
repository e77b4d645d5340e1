"""Exact top-k inner-product search over norm buckets.

Vectors are grouped by length, longest first. Each query gets a threshold from the bucket of the
longest vectors (its k-th best score there); a bucket whose greatest length times the query's
length is below it can hold no better one, so that pair of query and bucket is never made. In a
surviving bucket the query's local cosine threshold decides how candidates are pruned: a low one
by length (a prefix of the bucket, sorted by length), a high one by coordinates (the feasible
interval of the query's largest coordinates on unit vectors). Products of all that remain are
computed exactly.

Scale: buckets hold about ``bucket_rows`` rows, and queries go in blocks of ``query_block``; a
group is one bucket and one block. Many vectors of one length are split by hash of the id. A vector
is sent to a block only if a query of the block reaches its bucket. What functions carry is a number
a bucket and a number a block.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null
id, take no part. Shorter vectors count as padded with zeros; an empty vector scores 0 with all.
Products that 64 bits can't hold are computed exactly and returned as the end of the range that they
are beyond; those at one end are tied. Rows that repeat an id are candidates each, but one query (that with the least vector). Fewer than
``k`` candidates: all are returned. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

_PREPARED = "vec_id long, norm double, v binary"
_MATCH = "query_id long, vec_id long, score long"


def _pack(row: np.ndarray) -> bytes:
    small = not len(row) or (row.min() >= -(2**31) and row.max() < 2**31)
    return b"\x04" + row.astype("<i4").tobytes() if small else b"\x08" + row.astype("<i8").tobytes()


def _unpack(cells: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(cells), dim), dtype=np.int64)
    for i, b in enumerate(cells):
        x = np.frombuffer(b, dtype="<i4" if b[0] == 4 else "<i8", offset=1)
        out[i, : len(x)] = x
    return out


def _dim(cells: pd.Series) -> int:
    return max(((len(b) - 1) // b[0] for b in cells), default=0)


def prepare(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows that take part: id, length and the packed integer vector floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column(0), batch.column(1)
            # The cells' components lie one after the other; sums over a cell are differences of running sums.
            at = cells.offsets.to_numpy()
            values = cells.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | values.is_null().to_numpy(zero_copy_only=False))])
            keep = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & cells.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]))
            with np.errstate(invalid="ignore"):
                x = np.clip(np.floor(scale * np.where(np.isfinite(x), x, 0.0)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            rows = [x[at[i] : at[i + 1]] for i in keep]
            norms = [math.sqrt(float(np.dot(r := row.astype(np.float64), r))) for row in rows]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(norms, pa.float64()), pa.array([_pack(row) for row in rows], pa.binary())], names=["vec_id", "norm", "v"])

    return df.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, _PREPARED)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matcher(k: int, coordinate_from: float, focus: int):
    def run(queries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(probes):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        probes = probes.sort_values("norm", ascending=False, kind="stable")
        dim = max(_dim(queries.v), _dim(probes.v))
        q, p = _unpack(queries.v, dim), _unpack(probes.v, dim)
        ids, length = probes.vec_id.to_numpy(), probes.norm.to_numpy()
        own, q_len, least = queries.query_id.to_numpy(), queries.norm.to_numpy(), queries.theta.to_numpy()
        # Every sum of a product is at most the product of the lengths; beyond 64 bits Python's integers are exact.
        size = q_len.max(initial=0) * length[0]
        kind = np.float64 if size < 2.0**52 else np.int64 if size < 2.0**62 else object
        pf, qf = p.astype(kind), q.astype(kind)
        unit = p / np.maximum(length, 1e-300)[:, None]
        # Local cosine thresholds choose the pruning; without a threshold, or for a query of zeros, nothing is pruned.
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isfinite(least) & (q_len > 0) & (length[0] > 0), least / (q_len * length[0]), -1.0)
            shortest = np.where(local > 0, least / q_len * (1 - 1e-9), 0.0)
        prefix = np.searchsorted(-length, -shortest, side="right")
        by_coordinate = local >= coordinate_from
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(i: int, near: np.ndarray, scores: np.ndarray) -> None:
            other = ids[near] != own[i]
            if np.isfinite(least[i]):
                other &= scores >= least[i]
            near, scores = near[other], scores[other]
            best = _best(scores, ids[near], k)
            found.append((np.full(len(best), own[i]), ids[near][best], scores[best].astype(np.int64)))

        def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = a @ b
            return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else out

        plain = np.flatnonzero(~by_coordinate)
        plain = plain[np.argsort(prefix[plain], kind="stable")]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            top = int(prefix[part].max())
            scores = products(qf[part], pf[:top].T)
            for i, row in zip(part, scores):
                n = int(prefix[i])
                emit(i, np.arange(n), row[:n])
        for i in np.flatnonzero(by_coordinate):
            n, t = int(prefix[i]), min(1.0, float(local[i]))
            direction = q[i] / q_len[i]
            mask = np.ones(n, dtype=bool)
            for f in np.argsort(-np.abs(direction))[:focus]:
                c = float(direction[f])
                spread = math.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-9
                # |angle(p, q)| <= acos(t) bounds the coordinate only where q's own lies inside the cap.
                low = -1.0 if c < -t else c * t - spread
                high = 1.0 if c > t else c * t + spread
                mask &= (unit[:n, f] >= low) & (unit[:n, f] <= high)
            near = np.flatnonzero(mask)
            emit(i, near, products(pf[near], qf[i]))
        parts = list(zip(*found))
        return pd.DataFrame({c: np.concatenate(x) if len(x) else np.zeros(0, np.int64) for c, x in zip(("query_id", "vec_id", "score"), parts)})

    return run


def topk_search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bucket_rows: int = 1024, query_block: int = 2048, coordinate_from: float = 0.55, focus: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` with the highest inner product for each row of ``queries`` but its own."""
    probes, asked = prepare(df, id_col, vector_col, scale), prepare(queries, id_col, vector_col, scale)
    asked = cut(asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "norm")).alias("x")).select("query_id", "x.norm", "x.v"))
    n_queries = asked.count()
    n = probes.agg(F.count("*")).first()[0]
    classes = max(1, min(1000, math.ceil(n / bucket_rows)))
    stats = probes.agg(F.max("norm").alias("top"), F.percentile_approx("norm", [i / classes for i in range(1, classes + 1)], 20 * classes).alias("at")).first()
    # Equal lengths repeat a quantile: that class gets as many hash slices as quantiles.
    at = np.array(stats.at if stats.at else [0.0])
    upper, slices = np.unique(at, return_counts=True)
    upper[-1] = max(upper[-1], stats.top or 0.0)
    slices = np.maximum(slices, np.ceil(slices * (n / classes) / bucket_rows).astype(int))
    upper, slices = upper[::-1].copy(), slices[::-1].copy()
    first = np.concatenate([[0], np.cumsum(slices)])
    bound = np.repeat(upper, slices)
    blocks = max(1, math.ceil(n_queries / query_block))

    def spread(reach: np.ndarray, from_bucket: int) -> DataFrame:
        """Vectors with their bucket, once for each block of which a query reaches it."""

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                group = np.searchsorted(-upper, -x.norm.to_numpy(), side="right") - 1
                slot = pd.util.hash_array(x.vec_id.to_numpy().astype(np.uint64)) % slices[group].astype(np.uint64)
                bucket = first[group] + slot.astype(np.int64)
                x = x.assign(bucket=bucket)
                for b in np.flatnonzero(reach >= from_bucket):
                    yield x[(bucket >= from_bucket) & (bucket <= reach[b])].assign(block=b)

        return probes.mapInPandas(place, _PREPARED + ", bucket long, block long")

    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    match = _matcher(k, coordinate_from, focus)

    def matched(q: DataFrame, p: DataFrame) -> DataFrame:
        return q.groupBy("bucket", "block").cogroup(p.groupBy("bucket", "block")).applyInPandas(match, _MATCH)

    head = cut(matched(asked.withColumn("bucket", F.lit(0).cast("long")).withColumn("theta", F.lit(float("-inf"))), spread(np.zeros(blocks, np.int64), 0)))
    found = head
    if len(bound) > 1:
        theta = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("theta"))
        # A bound, so a little lower than the sum that it is rounded from.
        theta = theta.withColumn("theta", F.col("theta") - F.abs("theta") * 1e-12)
        left = asked.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))

        def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Lengths fall with the bucket number: those that a query still needs are a prefix.
            for x in batches:
                least = np.where(x.norm > 0, x.theta / x.norm.where(x.norm > 0, 1.0) / (1 + 1e-9), np.where(x.theta <= 0, -np.inf, np.inf))
                yield x.assign(reach=np.searchsorted(-bound[1:], -least, side="right"))

        left = cut(left.mapInPandas(reaching, "query_id long, norm double, v binary, block long, theta double, reach long").filter("reach > 0"))
        reach = np.zeros(blocks, np.int64)
        for r in left.groupBy("block").agg(F.max("reach").alias("reach")).collect():
            reach[r.block] = r.reach
        left = left.withColumn("bucket", F.explode(F.sequence(F.lit(1).cast("long"), "reach"))).drop("reach")
        found = head.unionByName(matched(left, spread(reach, 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search(df, df.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
