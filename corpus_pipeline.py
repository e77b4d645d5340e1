"""From raw documents to packed training sequences: language, near copies, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns the columns of
``documents``; the last returns pieces of packed sequences.

Defined cases: rows whose doc_id is null or repeated are judged one by one, by a hash of all their
columns in place of the id; of rows that are equal in all columns the near-copy stage keeps one. Null
texts are no language, so they go first. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm.common import cut, table, work_dir
from condensa.llm.decontaminate import find_passages
from condensa.llm.language_id import identify
from condensa.llm.near_dedup import near_duplicates
from condensa.llm.packing import pack_documents
from condensa.llm.secret_scan import redact

#: Ids are broadcast up to this many (8 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

#: None: consistent weighted samples, the singular vectors and the packing have no SQL form.
ORACLE_SQL = None


def _small(df: DataFrame) -> DataFrame:
    """``df``, one row an id, for a join: broadcast up to ``BROADCAST_IDS`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the doc_id, or where that is null or repeated (``_odd``) a hash of the row."""
    odd = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_odd")))
    plain = F.col("doc_id").cast("long")
    if odd.isEmpty():
        return docs.withColumns({"_odd": F.lit(False), "_key": plain})
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_odd", F.coalesce("_odd", F.lit(False)))
    return marked.withColumn("_key", F.when(F.col("_odd"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).otherwise(plain)).drop("_id")


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows but for those with these keys."""
    return keyed.join(_small(keys.toDF("_gone").distinct()), F.col("_key") == F.col("_gone"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    keyed = _keyed(docs)
    judged = identify(keyed, "_key", "text", host_col="source")
    return _without(keyed, judged.filter("NOT accepted").select("_key")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near copies."""
    keyed = _keyed(docs)
    classes = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    kept = _without(keyed, classes.filter("doc_id <> class_id").select("doc_id"))
    # Rows that are equal in all columns share a key.
    once = kept.filter("_odd").select(docs.columns).distinct()
    return kept.filter("NOT _odd").select(docs.columns).unionByName(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = _keyed(docs)
    found = find_passages(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.select("doc_id")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        at = work_dir(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
