"""Language identification by Bayesian fusion of evidence.

The posterior of a document's language multiplies

* the likelihood of its text: byte trigrams, hashed to a table a language; each byte is in three
  trigrams, so the logarithm counts a third;
* the likelihood of the language that its markup declares (``<html lang=...>``), and of its
  address's suffix (country domains, or a path that starts with a language code), each a smoothed
  table of (what is declared, language), counted over all documents by the text's own best guess;
* the prior of its host, smoothed towards its domain's, and that towards the corpus's: grouped
  sums of the posteriors that the text alone gives.

A document has no part in its own prior or evidence: what it added to the sums and counts is taken
off again.

One more language, ``und``, spreads its bytes evenly; it stands for no language that the model
knows. A document is rejected when ``und`` is its best, when the best holds less than
``least`` of the posterior, or when it has no word characters.

Scale: every label is learned. Texts are counted and scored by ``block_languages`` languages at a
time; the trigram tables, 131 KB a language, are what is broadcast. Texts are read in two passes (the
first, a pass a block of languages) and never shuffled; what is written and joined is a row of numbers a document. Hosts are joined, not
broadcast; a hot host is a skewed join, which Spark splits, and rows without a host are dealt out.

Defined cases: null and empty texts, and texts without word characters, are ``und``. Null labels
teach nothing; with no labels at all every document is ``und``. Null addresses and hosts have no
prior but the corpus's. Rows with a null or a repeated id are judged each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTE, cut, encoded, map_arrow, map_pandas, partitions, table

UND = "und"
#: What the text alone gives ``und`` before it is read.
_UND_PRIOR = 1e-3
_BITS = 15
_SPACE = np.where(WORD_BYTE, np.arange(256), 32).astype(np.uint32)
_DOMAIN = r"([^.]+\.[^.]+)$"
_DECLARED = r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b"""


def trigrams(texts: Iterable[str | None], group_bytes: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of whole texts: slots of all trigrams of word bytes (other bytes are one space each), and where each text's begin (and the end)."""

    def done() -> tuple[np.ndarray, np.ndarray]:
        # Two spaces between texts: no trigram with a word byte of two texts.
        raw = _SPACE[np.frombuffer(b"  ".join([*group, b""]), dtype=np.uint8)]
        at = np.cumsum([0] + [len(x) + 2 for x in group])
        if len(raw) < 3:
            return np.zeros(0, np.int64), np.zeros(len(group) + 1, np.int64)
        code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        middle = np.flatnonzero(raw[1:-1] != 32)
        slot = code[middle] * np.uint32(2654435761) >> np.uint32(32 - _BITS)
        return slot.astype(np.int64), np.searchsorted(middle + 1, at)

    group: list[bytes] = []
    size = 0
    for text in texts:
        # A space before each text makes its first byte the middle of a trigram.
        group.append(b" " + encoded(text))
        size += len(group[-1])
        if size >= group_bytes:
            yield done()
            group, size = [], 0
    if group:
        yield done()


def _counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """(languages, slots) trigram counts over all labelled documents."""
    number = {x: i for i, x in enumerate(languages)}
    slots = 1 << _BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), slots), np.int64)
        for batch in batches:
            owner = [number.get(x) for x in batch.column(1).to_pylist()]
            texts = [(o, t) for o, t in zip(owner, batch.column(0)) if o is not None]
            doc = 0
            for got, at in trigrams(t.as_py() for _, t in texts):
                own = np.array([o for o, _ in texts[doc : doc + len(at) - 1]])
                total += np.bincount(got[: at[-1]] + slots * np.repeat(own, np.diff(at)), minlength=total.size).reshape(total.shape)
                doc += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int64()), pa.array([row.tobytes() for row in total], pa.binary())], names=["i", "c"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for i, raw in zip(x.i, x.c):
                value = np.frombuffer(raw, np.int64)
                total[i] = total[i] + value if i in total else value
        yield pd.DataFrame({"i": list(total), "c": [v.tobytes() for v in total.values()]})

    out = np.zeros((len(languages), slots), np.int64)
    parts = map_arrow(docs.select("_text", "_label"), run, "i long, c binary").withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(16)))
    n = max(1, min(partitions(docs.sparkSession), 64))
    for r in map_pandas(parts.repartition(n, "i", "slice").drop("slice"), add, "i long, c binary").toLocalIterator():
        out[r.i] += np.frombuffer(r.c, np.int64)
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _scored(docs: DataFrame, model: np.ndarray, block_languages: int) -> DataFrame:
    """Adds ``ll``, the text's logarithmic likelihood under each row of ``model``, ``post``, its posterior alone, and ``guess``, the best; null without word characters."""
    shared = docs.sparkSession.sparkContext.broadcast([np.ascontiguousarray(model[i : i + block_languages].T.astype(np.float32)) for i in range(0, len(model), block_languages)])
    kept = [c for c in docs.columns if c != "_text"]
    place, n = docs.columns.index("_text"), len(model)
    even = np.log(np.array([(1 - _UND_PRIOR) / max(1, n - 1)] * (n - 1) + [_UND_PRIOR]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in batches:
            ll: list[np.ndarray | None] = []
            for got, at in trigrams(t.as_py() for t in batch.column(place)):
                some = np.flatnonzero(np.diff(at))
                sums: list[np.ndarray | None] = [None] * (len(at) - 1)
                if len(some):
                    scores = [np.add.reduceat(of_slot[got[: at[-1]]], at[:-1][some], axis=0, dtype=np.float64) / 3 for of_slot in blocks]
                    for i, row in zip(some, np.hstack(scores)):
                        sums[i] = row
                ll += sums
            post = [None if x is None else _softmax((x + even)[None])[0] for x in ll]
            guess = [None if x is None else int(x.argmax()) for x in post]
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ll, numbers), pa.array(post, numbers), pa.array(guess, pa.int32())], names=[*kept, "ll", "post", "guess"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    return map_arrow(docs, run, f"{schema}, ll array<double>, post array<double>, guess int")


def _without(sums, own: np.ndarray) -> np.ndarray:
    """Sums less a document's own part; none where there are no sums."""
    return np.maximum(np.array(sums) - own, 0.0) if sums is not None else np.zeros(len(own))


def _prior(host, domain, corpus: np.ndarray, own: np.ndarray, mass: float) -> np.ndarray:
    """The host's prior from all its other documents, smoothed towards the domain's, and that towards the corpus's."""
    everywhere = np.maximum(corpus - own, 0.0) + 1.0
    prior = everywhere / everywhere.sum()
    for sums in (_without(domain, own), _without(host, own)):
        prior = (sums + mass * prior) / (sums.sum() + mass)
    return prior


def _judged(rows: DataFrame, corpus: np.ndarray, evidence: dict[str, tuple[np.ndarray, int]], names: list[str], least: float, mass: float) -> DataFrame:
    """(_id, language, confidence, accepted) from the likelihoods, the priors and the evidence that there is, each without the document itself."""
    place = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(place["_id"])
            column = {c: batch.column(i).to_pylist() for c, i in place.items() if c != "_id"}
            language, confidence = [], []
            for i, ll in enumerate(column["ll"]):
                if ll is None:
                    language.append(UND)
                    confidence.append(1.0)
                    continue
                own = np.array(column["post"][i])
                total = np.array(ll) + np.log(_prior(column["by_host"][i], column["by_domain"][i], corpus, own, mass))
                guess = np.zeros(len(own))
                guess[column["guess"][i]] = 1
                for c, (per_language, values) in evidence.items():
                    if column[c][i] is not None:
                        total += np.log((_without(column[c][i], guess) + 1) / (per_language - guess + values))
                post = _softmax(total[None])[0]
                language.append(names[int(post.argmax())])
                confidence.append(float(post.max()))
            accepted = [name != UND and c >= least for name, c in zip(language, confidence)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(language, pa.string()), pa.array(confidence, pa.float64()), pa.array(accepted, pa.bool_())], names=["_id", "language", "confidence", "accepted"])

    return map_arrow(rows, run, "_id long, language string, confidence double, accepted boolean")


def _evidence(scored: DataFrame, column: str, n: int) -> tuple[DataFrame, np.ndarray, int]:
    """(column, ev_<column>): how many documents of each best guess declare a value; how many any; how many values there are."""
    counts = [F.count(F.when(F.col("guess") == i, 1)).cast("double") for i in range(n)]
    own = cut(scored.filter(F.col(column).isNotNull()).groupBy(column).agg(F.array(*counts).alias(f"ev{column}")))
    total = own.agg(F.count("*").alias("values"), *[F.coalesce(F.sum(F.col(f"ev{column}")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    return own, np.array([*total][1:], float), total[0]


def _sums(scored: DataFrame, by: str, n: int) -> DataFrame:
    """Sums of the text's posteriors by a column."""
    return scored.filter(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias("s"))


def identify(df: DataFrame, id_col: str, text_col: str, url_col: str | None = None, host_col: str | None = None, train: DataFrame | None = None, train_text: str = "text", train_label: str = "lang", least: float = 0.5, mass: float = 20.0, block_languages: int = 64) -> DataFrame:
    """(id, language, confidence, accepted). ``train`` holds labelled texts; hosts come from ``url_col`` or ``host_col``."""
    spark = df.sparkSession
    train = (train if train is not None else df).select(F.col(train_text).alias("_text"), F.col(train_label).cast("string").alias("_label"))
    by_label = train.filter("_label IS NOT NULL AND _text IS NOT NULL").groupBy("_label").count()
    languages = sorted(r["_label"] for r in by_label.collect())
    counts = np.vstack([np.zeros((0, 1 << _BITS)), *(_counts(train, languages[i : i + block_languages]) for i in range(0, len(languages), block_languages))])
    slots = 1 << _BITS
    model = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * slots))
    model = np.vstack([model, np.full(slots, -math.log(slots))])
    names, n = [*languages, UND], len(languages) + 1

    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col else F.lit("")
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)) if url_col else F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), _DECLARED, 1))
    country = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]{2})$", 1)
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(country != "", country).when(path != "", F.concat(F.lit("/"), path))
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), host.alias("_host"),
        F.regexp_extract(host, _DOMAIN, 1).alias("_domain"), F.when(declared != "", declared).alias("_declared"), suffix.alias("_suffix"),
    )
    scored = cut(_scored(rows, model, block_languages))

    total = scored.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    hosts = _sums(scored, "_host", n).withColumn("_domain", F.regexp_extract("_host", _DOMAIN, 1)).withColumnRenamed("s", "by_host")
    hosts = cut(hosts.join(_sums(scored, "_domain", n).withColumnRenamed("s", "by_domain"), "_domain", "left").drop("_domain"))
    # Rows without a host meet none; they are spread over many keys.
    key = F.coalesce("_host", F.concat(F.lit("\0"), F.pmod(F.xxhash64("_id"), F.lit(4096)).cast("string")))
    out = scored.withColumn("_key", key).join(hosts.withColumnRenamed("_host", "_key"), "_key", "left")
    evidence = {}
    for column in ("_declared", "_suffix"):
        counts, per_language, values = _evidence(scored, column, n)
        if values:
            # Declared codes and suffixes are words of two or three letters: tables of at most some ten thousand rows.
            out = out.join(F.broadcast(counts), column, "left")
            evidence[f"ev{column}"] = (per_language, values)
    out = out.select("_id", "ll", "post", "guess", "by_host", "by_domain", *evidence)
    return _judged(out, np.array([*total], float), evidence, names, least, mass).withColumnRenamed("_id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text, and their sources as hosts; ``lang`` teaches the trigram model."""
    return identify(table(spark, sf_dir, "documents"), "doc_id", "text", host_col="source")


def op8_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: text, declared markup language, address suffix and host, with the documents' model."""
    return identify(table(spark, sf_dir, "pages"), "page_id", "html", url_col="url", train=table(spark, sf_dir, "documents"))
