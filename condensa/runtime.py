"""Session helpers: the shared checkpoint folder, lineage cuts and distributed ranks."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="condensa-")
    if not own.isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: for wide tables of which later steps want few columns."""
    at = posixpath.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def ranked_values(df: DataFrame, value: str) -> DataFrame:
    """(v, copies, first): the distinct values of a column as doubles, ascending, how often each comes and the 1-based rank of its first copy.

    Equal values are one row before anything is ranged, so a value that a third of all rows have is no hot key.
    """
    own = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"))
    ranged = cut(own.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    before = F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A row a partition.
    offsets = ranged.groupBy("_part").agg(F.sum("copies").alias("c")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("copies").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), "_part").select("v", "copies", (F.col("_within") + F.col("_before") + 1).alias("first"))


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row in a total order over the whole table.

    Rows are ranged by the order and written once, so that partitions stay what they are; a rank is
    the row's number in its partition plus the counts of the partitions before. The order must be total
    (end it with a unique column), so that equal values don't all go to one range; for values alone
    see ``ranked_values``.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A row a partition.
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_within", within).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_part", "_within", "_before")
