"""Near-duplicate classes by banded consistent weighted samples, verified by weighted Jaccard.

1. Document frequencies of common shingles (see ``icws``): tasks report shingles that are common
   among their own documents, which every common shingle is in some task; of the reported, the
   distinct texts that hold them are then counted exactly.
2. One pass takes each text's samples and bands (see ``icws``). Equal texts become one class.
3. In each band's bucket every text is paired with the bucket's least id, and the pairs are
   verified exactly. Components of the verified pairs are the first classes.
4. Buckets that still hold more than one class are compared across classes, in blocks of at most
   ``block_rows`` rows a side: pairs whose samples agree often enough are verified exactly, until
   the two classes are found to be one. Only links come out.

So a group of thousands of near copies costs a pair a member and band, and links between texts
that a bucket's least id misses are still found. With the default nine bands of three samples a
pair at the threshold of 0.8 shares a bucket with probability 0.998.

Defined cases: a null text has no copies and is a class of its own; texts without words are
copies only of equal texts; texts of under five words are one shingle. Rows with a null id can't be
named in a class and are left out. Rows that repeat an id are one document: its class is that of
all its texts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, many_shingle_hashes, map_arrow, mix64, partitions, table, work_dir
from .components import components
from .icws import Idf, counted, origin, samples, weighted_jaccard

_CHUNK = 4_000_000


def shingle_idf(docs: DataFrame, idf_share: float) -> Idf:
    """Exact document frequencies, copies counted once, of all shingles in at least ``idf_share`` of the documents."""
    n = docs.count()
    texts = docs.select("text").coalesce(max(1, math.ceil(n * idf_share / 4)))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        documents = size = 0

        def common() -> pa.RecordBatch:
            least = max(1, idf_share / 2 * documents)
            # A shingle in so many documents fills its slot of the hash as often; few others do.
            slots = (np.concatenate(held or [np.zeros(0, np.uint64)]) >> np.uint64(44)).astype(np.int64)
            may = np.bincount(slots, minlength=1 << 20) >= least
            left = [np.unique(x[may[(x >> np.uint64(44)).astype(np.int64)]]) for x in held]
            x, c = np.unique(np.concatenate(left), return_counts=True) if left else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = c >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["x", "c"])

        for batch in batches:
            for shingles in many_shingle_hashes(t.as_py() for t in batch.column(0)):
                held.append(shingles)
                documents, size = documents + 1, size + len(shingles)
                if size > _CHUNK:
                    yield common()
                    held, documents, size = [], 0, 0
        yield common()

    # Unreported counts sum to under idf_share / 2 * n, so the common are among these: up to 2 / idf_share times a document's
    # mean number of shingles, which in a small table are all. They come as Arrow columns, since rows of Python objects take many times that.
    reported = map_arrow(texts, report, "x long, c long").groupBy("x").agg(F.sum("c").alias("c")).filter(F.col("c") >= idf_share / 2 * n)
    candidates = np.sort(reported.select("x").toArrow().column("x").to_numpy().view(np.uint64))
    if not len(candidates):
        return Idf(candidates, np.zeros(0), max(n, 1), idf_share)
    finder = docs.sparkSession.sparkContext.broadcast(Idf(candidates, np.ones(len(candidates)), n, idf_share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder.value
        held: list[np.ndarray] = []
        size = 0

        def pairs() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(held, axis=1), axis=1) if held else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["i", "origin"])

        for batch in batches:
            for shingles in many_shingle_hashes(t.as_py() for t in batch.column(0)):
                at = np.unique(found.find(shingles)[1])
                if len(at):
                    held.append(np.stack([at.astype(np.int64), np.full(len(at), np.uint64(origin(shingles)).astype(np.int64))]))
                    size += len(at)
                if size > _CHUNK // 4:
                    yield pairs()
                    held, size = [], 0
        yield pairs()

    # Many copies of a text are one pair a task before they are shuffled.
    df, raw = np.zeros(len(candidates), np.int64), map_arrow(texts, count, "i long, origin long")
    counts = raw.distinct().groupBy("i").count().toArrow()
    df[counts.column("i").to_numpy()] = counts.column("count").to_numpy()
    # All others weigh the bound.
    keep = n / np.maximum(df, 1) < 1 / idf_share
    return Idf(candidates[keep], df[keep], n, idf_share)


def signatures(docs: DataFrame, idf: Idf, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands, samples) of each document; no bands for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        band_seed = mix64(np.arange(1, bands + 1, dtype=np.uint64))

        def sign(part: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            shingles = np.concatenate([p[0] for p in part])
            weights = np.concatenate([p[1] for p in part]) * weigh(shingles)
            starts = np.cumsum([0] + [len(p[0]) for p in part[:-1]])
            got = samples(shingles, weights, starts, bands * rows)
            keys = np.empty((len(part), bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for b in range(bands):
                    key = np.full(len(part), band_seed[b], dtype=np.uint64)
                    for row in got[b * rows : (b + 1) * rows]:
                        key = mix64(key * np.uint64(31) + row)
                    keys[:, b] = key
                return keys, mix64(got).T.astype(np.uint32)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            first: dict[str, int] = {}
            place = [None if t is None else first.setdefault(t, len(first)) for t in texts]
            keys: list[np.ndarray | None] = [None] * len(first)
            signs: list[bytes | None] = [None] * len(first)
            part, owners, size = [], [], 0

            def done() -> None:
                if part:
                    k, s = sign(part)
                    for i, a, b in zip(owners, k.view(np.int64), s):
                        keys[i], signs[i] = a, b.tobytes()

            for i, shingles in enumerate(many_shingle_hashes(first)):
                own = np.unique(shingles, return_counts=True)
                if len(own[0]):
                    part.append(own)
                    owners.append(i)
                    size += len(own[0])
                if size >= 16384:
                    done()
                    part, owners, size = [], [], 0
            done()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([None if i is None else keys[i] for i in place], pa.list_(pa.int64())), pa.array([None if i is None else signs[i] for i in place], pa.binary())],
                names=["doc_id", "text_key", "bands", "samples"],
            )

    own = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5("text")).alias("text_key"))
    return map_arrow(own, run, "doc_id long, text_key binary, bands array<long>, samples binary")


def _verify(pairs: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        last: tuple[str | None, tuple] = (None, ())

        def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
            x, c = counted(text)
            return x, c * weigh(x)

        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b")):
                text_a = text_a.as_py()
                if text_a != last[0]:
                    last = (text_a, weighted(text_a))
                keep.append(weighted_jaccard(last[1], weighted(text_b.as_py())) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


_KEY = ["bucket", "i", "kind", "j"]


def _by_block(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame, pd.DataFrame]]:
    """The blocks that are in both sides of a group of blocks."""
    rights = dict(list(right.groupby(_KEY, sort=False))) if len(right) else {}
    for key, x in left.groupby(_KEY, sort=False) if len(left) else ():
        if key in rights:
            yield key, x, rights[key]


def _samples(x: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(x.samples), np.uint32).reshape(len(x), -1)


def _agreeing(least: int):
    """Rows of blocks whose samples agree often enough with a row of another class on the other side."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, x, y in _by_block(left, right):
            sx, sy, lx, ly, dx, dy = _samples(x), _samples(y), x.label.to_numpy(), y.label.to_numpy(), x.doc.to_numpy(), y.doc.to_numpy()
            near_y = np.zeros(len(y), dtype=bool)
            for i in range(len(x)):
                near = (sy == sx[i]).sum(axis=1) >= least
                near &= ly != lx[i]
                if near.any():
                    near_y |= near
                    out.append((*key, dx[i]))
            out += [(*key, d) for d in dy[near_y]]
        return pd.DataFrame(out, columns=[*_KEY, "doc"]).astype("int64")

    return run


def _across(idf_of, similarity: float, least: int):
    """Links between classes among the rows of two blocks of one bucket."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        weigh = idf_of.value
        parent: dict[int, int] = {}
        read: dict[int, tuple] = {}

        def root(n: int) -> int:
            while parent.get(n, n) != n:
                parent[n] = n = parent.get(parent[n], parent[n])
            return n

        def weighted(doc: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if doc not in read:
                if len(read) > 4096:
                    read.clear()
                x, c = counted(text)
                read[doc] = x, c * weigh(x)
            return read[doc]

        found = []
        for _, x, y in _by_block(left, right):
            sx, sy, lx, ly, dx, dy, tx, ty = _samples(x), _samples(y), x.label.tolist(), y.label.to_numpy(), x.doc.tolist(), y.doc.tolist(), x.text.tolist(), y.text.tolist()
            for i in range(len(x)):
                agree = (sy == sx[i]).sum(axis=1)
                near = np.flatnonzero((agree >= least) & (ly != lx[i]))
                for j in near[np.argsort(-agree[near], kind="stable")]:
                    a, b = root(lx[i]), root(int(ly[j]))
                    if a != b and weighted_jaccard(weighted(dx[i], tx[i]), weighted(dy[j], ty[j])) >= similarity:
                        parent[max(a, b)] = min(a, b)
                        found.append((min(dx[i], dy[j]), max(dx[i], dy[j])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _links_across(members: DataFrame, labels: DataFrame, own: DataFrame, texts: DataFrame, idf: Idf, similarity: float, least: int, block_rows: int) -> DataFrame:
    """Links between classes that share a bucket. The rows of a bucket's largest class are compared only with its other rows."""
    spark = members.sparkSession
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    labelled = cut(labelled.select("bucket", "doc", "label").distinct())
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = cut(mixed.select("bucket", "n", F.col("top.label").alias("large"), F.ceil(F.col("top.n") / block_rows).alias("large_blocks"), F.ceil((F.col("n") - F.col("top.n")) / block_rows).alias("small_blocks")))
    # Read some eight times below, so written once: else each plan holds its joins as often.
    rows = cut(labelled.join(mixed.drop("n"), "bucket").join(own, "doc"))
    within = lambda n: F.pmod(F.xxhash64("doc"), n)
    small, large = rows.filter("label <> large"), rows.filter("label = large")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = small.withColumn("i", within(F.col("small_blocks")))
    # Keys: a block of small rows against one of large rows (kind 0) or of small rows (kind 1, i <= j).
    kept = [*_KEY, "doc", "label", "samples"]
    kind = lambda df, n: df.withColumn("kind", F.lit(n).cast("long"))
    left = kind(one, 0).withColumn("j", F.explode(upto(F.col("large_blocks")))).select(kept)
    left = left.union(kind(one, 1).withColumn("j", F.explode(F.sequence("i", F.col("small_blocks") - 1))).select(kept))
    right = kind(large.withColumn("j", within(F.col("large_blocks"))), 0).withColumn("i", F.explode(upto(F.col("small_blocks")))).select(kept)
    right = right.union(kind(one.withColumn("j", F.col("i")), 1).withColumn("i", F.explode(upto(F.col("j") + 1))).select(kept))
    # Many small blocks go in one group of about as many rows as a large block has.
    groups = max(partitions(spark), math.ceil((mixed.agg(F.sum("n")).first()[0] or 0) / block_rows))
    grouped = lambda df: df.withColumn("g", F.pmod(F.xxhash64(*_KEY), F.lit(groups)))
    left, right = grouped(left), grouped(right)
    near = cut(left.toDF(*left.columns).groupBy("g").cogroup(right.toDF(*right.columns).groupBy("g")).applyInPandas(_agreeing(least), ", ".join(f"{c} long" for c in [*_KEY, "doc"])).distinct())
    if near.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(idf)
    with_text = lambda df: df.join(near, [*_KEY, "doc"], "left_semi").join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    left, right = with_text(left), with_text(right)
    return left.toDF(*left.columns).groupBy("g").cogroup(right.toDF(*right.columns).groupBy("g")).applyInPandas(_across(shared, similarity, least), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 9, rows: int = 3, idf_share: float = 0.002, block_rows: int = 256, agreement: float = 0.5) -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id of the document's class."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    idf = shingle_idf(docs, idf_share)
    signed = cut(signatures(docs, idf, bands, rows))
    copies = cut(signed.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    owned = cut(signed.join(copies, "text_key", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), "bands", "samples"))
    member = owned.select("doc_id", "first")
    own = owned.filter("doc_id = first").select(F.col("doc_id").alias("doc"), "bands", "samples")
    buckets = own.select("doc", F.explode("bands").alias("bucket"))
    shared = cut(buckets.groupBy("bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = cut(buckets.join(shared, "bucket"))
    # The texts that any later step needs, once.
    wanted = cut(members.select("doc").distinct())
    at = work_dir(spark, "texts")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    texts.write.parquet(at)
    texts = spark.read.parquet(at)
    pairs = members.filter("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    links = cut(_verify(pairs, texts, idf, similarity))
    # A row that repeats an id joins the classes of its texts.
    links = links.union(member.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).join(own.select(F.col("doc").alias("b")), "b", "left_semi"))
    labels = components(links)
    more = cut(_links_across(members.select("bucket", "doc"), labels, own.select("doc", "samples"), texts, idf, similarity, math.ceil(agreement * bands * rows), block_rows))
    if not more.isEmpty():
        labels = components(links.union(more))
    classes = member.join(labels.withColumnRenamed("node", "first"), "first", "left")
    return classes.select("doc_id", F.coalesce("label", "first").alias("class_id"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
