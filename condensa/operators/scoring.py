"""From two scores of each entry to one, and to tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ranked
from . import stats

#: Fixed values of the scoring phases.
GINI_LEAST, REDUNDANT, CORE_FIXED, CORE_LEAST = 0.2, 0.95, 0.15, 20
SELF_WEIGHT, RELEVANCE_WEIGHT = 0.4, 0.6


def core_size(n: int, knee: int, fixed: bool = False) -> int:
    if fixed:
        return max(1, int(n * CORE_FIXED))
    return max(1, min(knee + 1, n // 2), max(1, n // CORE_LEAST))


def core(df: DataFrame, idx: str, score: str, fixed: bool = False) -> DataFrame:
    """Adds ``core_rank`` (by score, ties to the smaller place) and ``is_core``."""
    n = df.count()
    knee = stats.kneedle(df, score).first()
    size = core_size(n, knee["knee"] if knee else 0, fixed)
    out = ranked(df.withColumn("_down", -F.col(score)), "_down", idx, name="core_rank").drop("_down")
    return out.withColumn("is_core", F.col("core_rank") <= size)


def blend(df: DataFrame, own: str, relevance: str) -> DataFrame:
    """Adds ``final``: 0.4 and 0.6 of the two, or the first alone where they say the same; divided by the largest."""
    r = stats.pearson(df, own, relevance).first()["r"]
    mixed = F.col(own).cast("double") if r > REDUNDANT else SELF_WEIGHT * F.col(own) + RELEVANCE_WEIGHT * F.coalesce(F.col(relevance), F.lit(0.0))
    top = df.agg(F.max(mixed)).first()[0] or 0.0
    return df.withColumn("final", mixed / F.lit(top) if top > 0 else mixed)


def tiers(df: DataFrame, score: str) -> DataFrame:
    """Adds ``tier``: high from p75, medium from p25, low above 0, else cut."""
    row = stats.cut_points(df, score).first()
    p75, p25 = (row["p75"], row["p25"]) if row else (0.0, 0.0)
    s = F.col(score)
    return df.withColumn("tier", F.when(s >= p75, "high").when(s >= p25, "medium").when(s > 0, "low").otherwise("cut"))
