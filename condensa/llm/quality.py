"""Quality scores from random-indexing word vectors and a small calibrated network.

Every token has a fixed sparse index vector, given by its hash; its context vector is the sum of
the index vectors of its neighbours, two to each side, over the whole corpus. Tokens are runs of
word characters and runs of punctuation; words in capitals, words that repeat one of the two
tokens before and overlong words are a token each. A document is pooled as mean and spread of its
tokens' unit vectors, with the logarithm of its length. A two-layer network learns the label, and a
temperature fitted on labelled rows that it was not trained on calibrates its probabilities.

Scale: vectors are a table of ``rows`` hashed tokens, summed task by task, which is the bound of
what is shuffled a task and broadcast. Corpus statistics cover all documents. The network is
fitted on at most ``sample_rows`` labelled rows, those with the least hashes of their ids (the
documented bound); their features are all that reaches the driver. Two passes over the texts.

Defined cases: null and empty texts have no tokens; they are scored by the network at the zero
vector. Labels that are null are left out; of several for one id the least counts. With labels of
one kind or none the score is the share of label 1 (0.5 without labels). Rows with a null or a
repeated id are scored each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCKS, hash_ranges, map_arrow, map_pandas, summed_blocks, table, touched_blocks

DIM = 48
_CAPITALS, _REPEAT, _LONG, _FIRST = 0, 1, 2, 8
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[list(range(33)) + [127]] = 0
_CLASS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, dtype=np.int8)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, dtype=np.int8)
_LOWER[97:123] = 1


def tokens(texts: Iterable[str | None], rows: int, group_bytes: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of whole texts: rows of all tokens, and where each text's tokens begin (and the end)."""

    def done() -> tuple[np.ndarray, np.ndarray]:
        at = np.cumsum([0] + [len(x) + 1 for x in group])
        raw = np.frombuffer(b"\n".join(group), dtype=np.uint8)
        kind = np.zeros(len(raw) + 2, dtype=np.int8)
        kind[1:-1] = _CLASS[raw]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        inside = kind[change[:-1] + 1] > 0 if len(change) else np.zeros(0, bool)
        start, end = change[:-1][inside], change[1:][inside]
        word = kind[start + 1] == 1
        hashes = hash_ranges(_FOLD[raw], start, end)
        upper, lower = (np.concatenate([[0], np.cumsum(t[raw], dtype=np.int64)]) for t in (_UPPER, _LOWER))
        out = _FIRST + (hashes % np.uint64(rows - _FIRST)).astype(np.int64)
        out[word & (end - start > 40)] = _LONG
        out[word & (upper[end] - upper[start] >= 2) & (lower[end] == lower[start])] = _CAPITALS
        text = np.searchsorted(at, start, side="right")
        for lag in (1, 2):
            if len(hashes) > lag:
                same = (hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag]) & word[lag:]
                out[lag:][same] = _REPEAT
        return out, np.searchsorted(start, at)

    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append((text or "").encode("utf-8", "replace"))
        size += len(group[-1])
        if size >= group_bytes:
            yield done()
            group, size = [], 0
    if group:
        yield done()


def index_vectors(rows: int, nonzero: int = 6) -> np.ndarray:
    """Fixed sparse ternary vectors."""
    rng = np.random.default_rng(77)
    out = np.zeros((rows, DIM), np.float32)
    for _ in range(nonzero):
        out[np.arange(rows), rng.integers(0, DIM, rows)] = rng.choice(np.float32([-1, 1]), rows)
    return out


def _add_contexts(total: np.ndarray, ids: np.ndarray, at: np.ndarray, index: np.ndarray) -> None:
    if not len(ids):
        return
    own = index[ids]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    context = np.zeros_like(own)
    for lag in (1, 2):
        if len(ids) > lag:
            same = (text[lag:] == text[:-lag]).astype(np.float32)[:, None]
            context[lag:] += own[:-lag] * same
            context[:-lag] += own[lag:] * same
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total[ordered[starts]] += np.add.reduceat(context[order], starts, axis=0)


def word_vectors(docs: DataFrame, rows: int, part: int = 2048) -> np.ndarray:
    """Unit context vectors of all token rows, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(rows), np.zeros((rows, DIM), np.float32)
        for batch in batches:
            for ids, at in tokens((t.as_py() for t in batch.column(0)), rows):
                _add_contexts(total, ids, at, index)
        yield touched_blocks(total, part)

    out = np.zeros((rows, DIM))
    for at, value in summed_blocks(map_arrow(docs.select("text"), run, BLOCKS), DIM, part):
        out[at] += value
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: Iterable[str | None], vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of documents' features: mean and spread of their tokens' vectors, logarithm of their number."""
    for ids, at in tokens(texts, len(vectors)):
        n = np.diff(at)
        out = np.zeros((len(n), 2 * DIM + 1), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            own = vectors[ids]
            starts, count = at[:-1][some], n[some][:, None]
            mean = np.add.reduceat(own, starts, axis=0) / count
            out[some, :DIM] = mean
            out[some, DIM:-1] = np.sqrt(np.maximum(np.add.reduceat(own * own, starts, axis=0) / count - mean * mean, 0))
        out[:, -1] = np.log1p(n) / 4
        yield out


@dataclass
class Network:
    """tanh and logistic layers over standardised inputs; ``temperature`` divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Trained by Adam on the rows not ``apart``; those set the temperature."""
    train = ~apart if (~apart).any() and len(set(y[~apart])) == 2 else np.ones(len(y), bool)
    rng = np.random.default_rng(5)
    xt, yt = x[train].astype(np.float64), y[train].astype(np.float64)
    net = Network(xt.mean(0), xt.std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    xt = (xt - net.centre) / net.scale
    params = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            h = np.tanh(xt[pick] @ params["w1"] + params["b1"])
            error = (1 / (1 + np.exp(-np.clip(h @ params["w2"] + params["b2"], -60, 60))) - yt[pick]) / len(pick)
            back = np.outer(error, params["w2"]) * (1 - h * h)
            grads = {"w1": xt[pick].T @ back + decay * params["w1"], "b1": back.sum(0), "w2": h.T @ error + decay * params["w2"], "b2": np.array([error.sum()])}
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params["w1"], params["b1"], params["w2"], float(params["b2"][0])
    held = apart if apart.any() else np.ones(len(y), bool)
    logit = net.logit(x[held].astype(np.float64))
    net.temperature = float(min(np.geomspace(1, 16, 65), key=lambda t: _loss(logit / t, y[held])))
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_part: int = 2, threshold: float = 0.7, rows: int = 1 << 14, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels are learned only from rows that are not held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))
    vectors = word_vectors(docs, rows)
    shared = spark.sparkContext.broadcast(vectors)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.filter(part("doc_id") != held_out_part).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    size = 2 * DIM + 1

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                f = np.concatenate(list(features(x.text, shared.value)))
                yield pd.DataFrame({"doc_id": x.doc_id, "label": x.label, "f": [r.tobytes() for r in f]})

    # The sample has at most sample_rows rows of two numbers,
    # and rows that repeat an id are one of them, that with the least text.
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    got = map_pandas(one, featured, "doc_id long, label int, f binary").toPandas().sort_values(["doc_id", "f"])
    y = got.label.to_numpy().astype(np.int64) if len(got) else np.zeros(0, np.int64)
    net = None
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) == 2:
        x = np.frombuffer(b"".join(got.f), np.float32).reshape(-1, size)
        net = fit(x, (y > 0).astype(np.float64), (got.doc_id.to_numpy() // 4 % 5) == 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, share)
            if net is not None and batch.num_rows:
                scores = np.concatenate([net.score(f.astype(np.float64)) for f in features((t.as_py() for t in batch.column("text")), shared.value)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(part("doc_id") == held_out_part, F.lit(False)).alias("held_out")
    return map_arrow(docs.select("doc_id", "text", held), scored, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
