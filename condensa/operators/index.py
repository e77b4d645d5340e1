"""An inverted index with entropy-weighted lexical retrieval.

``postings`` has (doc, term, tf), ``docs`` has (doc, dl) with empty documents too, ``terms`` has a
row a term with its weights, which follow from ``sums``. Scalars of the corpus (documents, mean
length, largest idf) are one aggregate row. All is grouped aggregation and equi-joins on the term.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rational_sigmoid, words
from ..runtime import stored

K1, B = 1.5, 0.75


def postings_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf). Texts are dealt out by document, so words are counted where they are split; they are never shuffled."""
    return docs.select(doc, text).repartition(F.col(doc)).select(F.col(doc).alias("doc"), F.explode(words(text)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def lengths_of(docs: DataFrame, postings: DataFrame, doc: str) -> DataFrame:
    """(doc, dl) of every document, 0 for those without words; texts are not read again."""
    sums = postings.groupBy("doc").agg(F.sum("tf").alias("dl"))
    return docs.select(F.col(doc).alias("doc")).join(sums, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def idf(df: Column, n: Column | int) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_sums(postings: DataFrame) -> DataFrame:
    """(term, df, cf, v, s, t): what a term's weight needs of its postings, by one aggregation.

    The entropy of p = m / sum(m) is ln(sum m) - sum(m ln m) / sum(m); s and t are the two sums.
    """
    m = rational_sigmoid(F.col("tf").cast("double"))
    return postings.withColumn("_m", m).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.var_pop("tf").alias("v"), F.sum("_m").alias("s"), F.sum(F.col("_m") * F.log("_m")).alias("t"),
    )


def informativeness(sums: DataFrame, n: int) -> DataFrame:
    """(term, df, cf, info): how unevenly a term's occurrences spread over its documents."""
    entropy = F.log("s") - F.col("t") / F.col("s")
    shannon = F.greatest(F.lit(0.0), 1 - F.least(entropy / F.log(F.greatest(F.col("df"), F.lit(2))), F.lit(1.0)))
    alpha = F.col("v") / (F.col("v") + 1)
    plain = 1 - F.col("df") / F.lit(float(max(n, 1)))
    info = F.when(F.col("df") < 2, F.lit(1.0)).when(alpha < 0.001, plain).otherwise(alpha * shannon + (1 - alpha) * plain)
    return sums.select("term", "df", "cf", info.alias("info"))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    average: float
    idf_max: float
    sums: DataFrame

    def stats(self) -> DataFrame:
        """One row: documents, vocabulary, mean length."""
        own = self.terms.agg(F.count("*").alias("vocabulary_size"))
        return own.select(F.lit(self.n).cast("long").alias("document_count"), "vocabulary_size", F.round(F.lit(self.average), 4).alias("average_length"))

    def saturation(self, tf="tf", dl="dl") -> Column:
        relative = F.col(dl) / F.lit(self.average) if self.average else F.lit(0.0)
        return (K1 + 1) * F.col(tf) / (F.col(tf) + K1 * (1 - B + B * relative)) if self.average else F.col(tf).cast("double")

    def search(self, queries: DataFrame, query: str, text: str, top_k: int | None = 10, normalize: bool = False) -> DataFrame:
        """(query, doc, score, rank) of the documents with any term of each query.

        score = base + (coverage / m) * information, where m counts the query's distinct terms,
        matched or not; ties go to the smaller document.
        """
        asked = queries.select(F.col(query).alias("query"), F.explode(words(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
        size = asked.groupBy("query").agg(F.count("*").alias("m"))
        # Written, so that its size is known: few asked terms are broadcast and the postings aren't shuffled, many are joined on the term.
        weighed = stored(asked.join(self.terms, "term"))
        hits = weighed.join(self.postings, "term").join(self.docs, "doc")
        part = F.col("eidf") * self.saturation() * F.col("qtf")
        hits = hits.withColumn("part", part)
        sums = hits.groupBy("query", "doc").agg(F.sum("part").alias("base"), F.sum(F.tanh("part")).alias("coverage"), F.sum(F.col("gamma") * F.col("info") * F.col("qtf")).alias("information"))
        score = F.col("base") + F.col("coverage") / F.col("m") * F.col("information")
        scored = sums.join(size, "query").select("query", "doc", score.alias("score"))
        if normalize:
            scored = stored(scored)
            best = scored.groupBy("query").agg(F.max("score").alias("_top"))
            scored = scored.join(best, "query").select("query", "doc", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.col("score")).alias("score"))
        if top_k is None:
            return scored
        # Sums differ in their last digits by order of addition; equal scores are equal to nine places.
        order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
        return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top_k)


def _weighed(docs: DataFrame, postings: DataFrame, sums: DataFrame) -> Index:
    """An index of written tables: weights of terms are a projection of their sums."""
    size = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    n, average = size["n"], float(size["average"] or 0.0)
    terms = informativeness(sums, n).withColumn("idf", idf(F.col("df"), n))
    top = float(terms.agg(F.max("idf")).first()[0] or 1.0)
    terms = terms.withColumn("gamma", F.col("idf") / top).withColumn("eidf", F.col("idf") * (1 + F.col("gamma") * F.col("info")))
    return Index(docs, postings, terms, n, average, top, sums)


def build(documents: DataFrame, doc: str, text: str) -> Index:
    """The index of a corpus. Texts are split once; postings, documents and sums of terms are written, for they are read several times."""
    postings = stored(postings_of(documents, doc, text))
    return _weighed(stored(lengths_of(documents, postings, doc)), postings, stored(term_sums(postings)))


def update(index: Index, doc: str, text: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> Index:
    """The index after documents have gone (ids ``doc`` of ``removed``) and come (``added``; an id that is there is replaced).

    Only the added texts are split and written. Postings are the old ones without the changed documents and
    the new ones beside them; only sums of terms that a changed document holds are computed again, and every
    term's weight follows from its sums and the new number of documents, so none is stale. Each update adds a
    filter to the postings' plan: ``compact`` after some tens of them. An id that comes twice in ``added``
    or is null there raises; ids of ``removed`` that aren't in the index are passed over.
    """
    ids = [df.select(F.col(doc).alias("doc")) for df in (added, removed) if df is not None]
    if not ids:
        return index
    if added is not None:
        wrong = added.groupBy(F.col(doc).alias("doc")).count().filter("count > 1 OR doc IS NULL").limit(1).collect()
        if wrong:
            raise ValueError(f"an id is added twice or null: {wrong[0]['doc']!r}")
    gone = stored((ids[0].union(ids[1]) if len(ids) == 2 else ids[0]).distinct())
    left = lambda df: df.join(gone, "doc", "left_anti")
    postings, docs, touched = left(index.postings), left(index.docs), index.postings.join(gone, "doc", "left_semi").select("term")
    if added is not None:
        new = stored(postings_of(added, doc, text))
        postings, touched = postings.unionByName(new), touched.union(new.select("term"))
        docs = docs.unionByName(lengths_of(added, new, doc))
    touched = stored(touched.distinct())
    sums = index.sums.join(touched, "term", "left_anti").unionByName(term_sums(postings.join(touched, "term", "left_semi")))
    return _weighed(stored(docs), postings, stored(sums))


def compact(index: Index) -> Index:
    """The same index with its postings written as one table."""
    return replace(index, postings=stored(index.postings))


def keywords(index: Index, top_k: int = 10) -> DataFrame:
    return index.terms.select("term", (F.col("eidf") * F.sqrt("df")).alias("weight")).orderBy(F.desc("weight"), "term").limit(top_k)

