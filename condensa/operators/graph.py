"""Similarity graphs of texts and central texts in them.

Large corpora: relational forms over an index (edges, degrees, prior, ranks by rounds of joins).
Many small corpora, as the turns of conversations: one grouped function call a corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..runtime import cut
from .index import Index


def limits(n: int) -> tuple[float, int]:
    """Least share of the largest weight, and most documents, of a term that makes edges."""
    if n > 5000:
        return 0.05, n // 10
    return (0.02, n // 5) if n > 1000 else (0.005, max(n // 2, 10))


def edges(index: Index) -> DataFrame:
    """(i, j, sim), i < j: cosine of weighted terms; norms count all terms, sums those neither faint nor common.

    Terms are filtered before the self-join, so a term makes at most limit^2 / 2 pairs.
    """
    faint, most = limits(index.n)
    weighed = index.postings.join(index.terms.filter("eidf > 0").select("term", "df", "eidf"), "term").join(index.docs, "doc").select("doc", "term", "df", "eidf", (F.col("eidf") * index.saturation()).alias("w"))
    top = index.terms.agg(F.max("eidf")).first()[0] or 0.0
    norms = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    usable = weighed.filter((F.col("df") >= 2) & (F.col("df") <= most) & (F.col("eidf") >= faint * top))
    a, b = usable.select(F.col("doc").alias("i"), "term", F.col("w").alias("wi")), usable.select(F.col("doc").alias("j"), "term", F.col("w").alias("wj"))
    raw = a.join(b, "term").filter("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("raw"))
    sim = raw.join(norms.select(F.col("doc").alias("i"), F.col("norm").alias("ni")), "i").join(norms.select(F.col("doc").alias("j"), F.col("norm").alias("nj")), "j")
    sim = cut(sim.select("i", "j", (F.col("raw") / (F.col("ni") * F.col("nj"))).alias("sim")).filter("sim > 0"))
    largest = sim.agg(F.max("sim")).first()[0] or 0.0
    return sim.filter(F.col("sim") >= 0.01 * largest)


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("i", "j", "sim").union(links.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def degrees(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, degree) of every document, 0 for those without an edge."""
    sums = both_ways(links).groupBy(F.col("i").alias("doc")).agg(F.sum("sim").alias("degree"))
    return docs.select("doc").join(sums, "doc", "left").select("doc", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def prior(degree: DataFrame, place: str = "doc") -> DataFrame:
    """(doc, prior) by place 0 to n - 1: a lead as strong as early texts are central, and a mild trail."""
    n = degree.count()
    if n <= 1:
        return degree.select("doc", F.lit(1.0).alias("prior"))
    lead = max(3, n // 10)
    a = degree.agg(F.avg("degree").alias("mean"), F.sum(F.when(F.col(place) < lead, F.col("degree")).otherwise(0.0)).alias("first")).first()
    strength = min(1.0, max(0.0, (a["first"] / lead / a["mean"] - 1) * 2.5)) if a["mean"] and a["mean"] > 0 else 0.0
    i = F.col(place)
    weight = 1 + strength * F.exp(-i / max(0.1 * n, 1.0)) + 0.3 * F.exp(-(n - 1 - i) / max(0.05 * n, 1.0))
    return degree.select("doc", weight.alias("prior"))


def query_bias(index: Index, priors: DataFrame, query: str) -> DataFrame:
    """(doc, prior): times (query score + 0.01) if anything matches the query."""
    spark = priors.sparkSession
    asked = spark.createDataFrame([(0, query)], "q long, text string")
    terms = asked.select(F.explode(_words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    scores = terms.join(index.terms, "term").join(index.postings, "term").join(index.docs, "doc").groupBy("doc").agg(F.sum(F.col("eidf") * index.saturation() * F.col("qtf")).alias("score"))
    if scores.isEmpty():
        return priors
    return priors.join(scores, "doc", "left").select("doc", (F.col("prior") * (F.coalesce("score", F.lit(0.0)) + 0.01)).alias("prior"))


def _words(c: str):
    from ..functions.text import words

    return words(c)


#: Texts whose graph one task holds as a matrix (8 MB).
SMALL_GRAPH = 1000


def _small_page_rank(links: DataFrame, priors: DataFrame, rounds: int, epsilon: float | None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, sides = pdf[pdf.j.isna()].sort_values("doc"), pdf[pdf.j.notna()]
        place = {d: k for k, d in enumerate(nodes.doc)}
        sim = np.zeros((len(nodes), len(nodes)))
        i, j = sides.doc.map(place).to_numpy(), sides.j.map(place).to_numpy()
        sim[i, j] = sim[j, i] = sides.x.to_numpy()
        rank = kernels.page_rank(sim, nodes.x.to_numpy(), rounds, epsilon)
        return pd.DataFrame({"doc": nodes.doc, "rank": rank / (rank.max() or 1.0)})

    kind = dict(priors.dtypes)["doc"]
    rows = priors.select("doc", F.lit(None).cast(kind).alias("j"), F.col("prior").alias("x")).union(links.select("i", "j", "sim"))
    return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"doc {kind}, rank double")


def page_rank(links: DataFrame, priors: DataFrame, rounds: int = kernels.ROUNDS, epsilon: float | None = kernels.EPSILON, every: int = 5) -> DataFrame:
    """(doc, rank), the largest is 1. Without ``epsilon`` all rounds are run.

    A graph of at most ``SMALL_GRAPH`` texts, which has at most half its square of edges, is one group's
    matrix; beyond that it is rounds of joins, whose lineage is cut every few rounds.
    """
    if priors.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
        return _small_page_rank(links, priors, rounds, epsilon)
    total = priors.agg(F.sum("prior")).first()[0] or 1.0
    start = cut(priors.select("doc", (F.col("prior") / total).alias("p")))
    both = both_ways(links)
    degree = both.groupBy(F.col("i").alias("doc")).agg(F.sum("sim").alias("deg"))
    step = cut(both.join(degree.withColumnRenamed("doc", "i"), "i").select("i", "j", (F.col("sim") / F.col("deg")).alias("w")))
    nodes = cut(start.join(degree, "doc", "left").withColumn("loose", F.col("deg").isNull()).select("doc", "p", "loose"))
    rank = nodes.select("doc", "p", "loose", F.col("p").alias("r"))
    for k in range(1, rounds + 1):
        sent = step.join(rank.select(F.col("doc").alias("i"), "r"), "i").groupBy(F.col("j").alias("doc")).agg(F.sum(F.col("r") * F.col("w")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("r"))), F.lit(0.0)).alias("lost"))
        new = rank.join(sent, "doc", "left").crossJoin(F.broadcast(lost))  # one row
        d = kernels.DAMPING
        new = new.select("doc", "p", "loose", F.col("r").alias("old"), ((1 - d) * F.col("p") + d * F.col("lost") * F.col("p") + d * F.coalesce("got", F.lit(0.0))).alias("r"))
        rank = cut(new) if k % every == 0 or epsilon is not None else new
        if epsilon is not None and (rank.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0) < epsilon:
            break
        rank = rank.drop("old")
    rank = cut(rank.select("doc", "r"))
    top = rank.agg(F.max("r")).first()[0] or 1.0
    return rank.select("doc", (F.col("r") / top).alias("rank"))


def rank_groups(rows: DataFrame, group: str, order: str, text: str, top_k: int = 5, query: str | None = None) -> DataFrame:
    """Adds score and sel_order (0-based, null if not chosen) to the rows of each small corpus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        got = kernels.rank([t or "" for t in pdf[text]], top_k, query)
        chosen = {i: n for n, i in enumerate(got.selected)}
        return pd.DataFrame({group: pdf[group], order: pdf[order], "score": got.scores, "sel_order": pd.array([chosen.get(i) for i in range(len(pdf))], dtype="Int64")})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, text).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, score double, sel_order long")


def segment(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, idx, sentence) by built-in functions; the merge of short fragments is a fold over the parts."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x))
    parts = F.flatten(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z\"])")))
    none = F.array().cast("array<string>")

    def step(done, part):
        last = F.try_element_at(done, F.lit(-1))
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), part)))
        return F.when((F.size(done) > 0) & (F.length(last) < kernels.FRAGMENT), merged).otherwise(F.concat(done, F.array(part)))

    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.aggregate(parts, none, step)).alias("idx", "sentence"))


def summarize(docs: DataFrame, doc: str, text: str, ratio: float = 0.3) -> DataFrame:
    """(doc, summary): the chosen sentences of each text in their order."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: kernels.summarize(t or "", ratio))

    return docs.select(F.col(doc).alias("doc"), run(text).alias("summary"))
