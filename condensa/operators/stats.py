"""Statistics of a column of scores: inequality, correlation, middle and spread, knee, cut points.

Order statistics are elements of the sorted column, not interpolations. Ranks come from
``runtime.ranked_values``, which needs no task to hold the column or all copies of a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ranked_values


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: 1 - 2 * sum(running sums) / (n * sum) + 1 / n; 0 for under two values or none but zeros."""
    own = ranked_values(df, value)
    # Each value is in n - rank + 1 running sums, so sum(running sums) = (n + 1) * sum(v) - sum(rank * v).
    c = F.col("copies")
    a = own.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.sum(c * F.col("v")).alias("s"), F.sum((c * F.col("first") + c * (c - 1) / 2) * F.col("v")).alias("r"))
    n, s = F.col("n").cast("double"), F.col("s")
    value_of = 1 - 2 * ((n + 1) * s - F.col("r")) / (n * s) + 1 / n
    return a.select(F.when((F.col("n") < 2) | (s == 0) | s.isNull(), 0.0).otherwise(value_of).alias("gini"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation; 0 for under three pairs or where a side hardly varies."""
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    a = own.agg(F.count("*").alias("n"), (F.covar_pop("x", "y") * F.count("*")).alias("c"), F.sqrt(F.var_pop("x") * F.count("*")).alias("dx"), F.sqrt(F.var_pop("y") * F.count("*")).alias("dy"))
    flat = (F.col("n") < 3) | (F.col("dx") < 1e-10) | (F.col("dy") < 1e-10)
    return a.select(F.when(flat, 0.0).otherwise(F.col("c") / (F.col("dx") * F.col("dy"))).alias("r"))


def _element(df: DataFrame, value: str, shares: dict[str, float]) -> tuple[int, dict[str, float]]:
    """Elements int(n * share) of the sorted column."""
    own = ranked_values(df, value)
    n = own.agg(F.sum("copies")).first()[0]
    if not n:
        return 0, {}
    at = {name: min(n, int(n * share) + 1) for name, share in shares.items()}
    holds = lambda r: (F.col("first") <= r) & (F.lit(r) < F.col("first") + F.col("copies"))
    row = own.agg(*[F.max(F.when(holds(r), F.col("v"))).alias(k) for k, r in at.items()]).first()
    return n, row.asDict()


def upper_median_mad(df: DataFrame, value: str) -> DataFrame:
    """One row: the upper median and 1.4826 times the upper median of distances to it."""
    _, got = _element(df, value, {"median": 0.5})
    spark = df.sparkSession
    if not got:
        return spark.createDataFrame([], "median double, mad double")
    away = df.select(F.abs(F.col(value).cast("double") - F.lit(got["median"])).alias("d"))
    _, mad = _element(away, "d", {"mad": 0.5})
    return spark.createDataFrame([(got["median"], mad["mad"] * 1.4826)], "median double, mad double")


def hub_capped(df: DataFrame, value: str, z: float = 3.0) -> DataFrame:
    """Adds ``capped``: values over median + z * MAD are median + 2 * MAD; all as they are where the MAD is 0."""
    row = upper_median_mad(df, value).first()
    if row is None or not row["mad"]:
        return df.withColumn("capped", F.col(value).cast("double"))
    m, d = F.lit(row["median"]), F.lit(row["mad"])
    v = F.col(value).cast("double")
    return df.withColumn("capped", F.when((v - m) / d > z, m + 2 * d).otherwise(v))


def cut_points(df: DataFrame, value: str) -> DataFrame:
    """One row: p75 and p25, elements int(n * share); the largest and the smallest of up to three values."""
    n, got = _element(df, value, {"p75": 0.75, "p25": 0.25, "low": 0.0, "high": 1.0})
    if not got:
        return df.sparkSession.createDataFrame([], "p75 double, p25 double")
    pair = (got["high"], got["low"]) if n <= 3 else (got["p75"], got["p25"])
    return df.sparkSession.createDataFrame([pair], "p75 double, p25 double")


def kneedle(df: DataFrame, value: str, sensitivity: float = 1.0) -> DataFrame:
    """One row: the 0-based place of the knee of the values in descending order.

    d = y - (1 - x) with both axes scaled to 1; the best place is the first maximum among all but
    the last, and the knee the first later place whose d falls below it by sensitivity * range / n.
    """
    down = ranked_values(df.select((-F.col(value).cast("double")).alias("_down")), "_down")
    own = cut(down.select((-F.col("v")).alias("v"), "copies", (F.col("first") - 1).alias("first")))
    size = own.agg(F.sum("copies").alias("n"), F.max("v").alias("high"), F.min("v").alias("low")).first()
    n, spark = size["n"], df.sparkSession
    if not n:
        return spark.createDataFrame([], "knee long")
    if n < 3 or size["high"] - size["low"] < 1e-10:
        return spark.createDataFrame([(n - 1,)], "knee long")
    spread = size["high"] - size["low"]
    at = lambda i: (F.col("v") - size["low"]) / spread - (1 - i / (n - 1))
    # Among equal values d grows with the place: the last of them is the greatest, the first the least.
    last = own.filter(F.col("first") <= n - 2).withColumn("i", F.least(F.col("first") + F.col("copies") - 1, F.lit(n - 2)))
    best = last.withColumn("d", at(F.col("i"))).agg(F.max(F.struct("d", (-F.col("i")).alias("i"))).alias("x")).select("x.d", (-F.col("x.i")).alias("i")).first()
    after = own.withColumn("i", F.col("first")).filter(F.col("i") > best["i"])
    later = after.filter(at(F.col("i")) < best["d"] - sensitivity * spread / n).agg(F.min("i").alias("i")).first()["i"]
    return spark.createDataFrame([(best["i"] if later is None else later,)], "knee long")
