"""Budgets: from estimated sizes to an allowance for each entry, by tier and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of what preserved entries leave, by tier; the reserve; the least allowance.
TIER_RATIOS = {"high": 0.60, "medium": 0.30, "low": 0.10}
RESERVE, LEAST, FAINT = 0.05, 10, 1e-10


def auto_budget(entries: DataFrame, tokens: str, corpus: str | None = None) -> DataFrame:
    """Half of all entries' estimated tokens, at least 100."""
    by = [corpus] if corpus else []
    return entries.groupBy(*by).agg(F.greatest(F.lit(100), F.floor(F.coalesce(F.sum(tokens), F.lit(0)) / 2)).cast("long").alias("budget"))


def allocate(scored: DataFrame, budget: int, ratios: dict[str, float] | None = None, corpus: str | None = None) -> DataFrame:
    """Adds tier_budget and entry_budget to rows with tokens, score and tier.

    Preserved entries get their own tokens; what they and the reserve leave is dealt to tiers by
    ratio and within a tier by score. Tiers without entries give nothing away. Sums are grouped
    and joined on the tier's few rows.
    """
    ratios = ratios or TIER_RATIOS
    by = [corpus] if corpus else []
    usable = budget - int(budget * RESERVE)
    kept = F.coalesce(F.sum(F.when(F.col("tier") == "preserve", F.col("tokens"))), F.lit(0))
    weight = F.greatest(F.col("score"), F.lit(FAINT))
    sums = scored.groupBy(*by, "tier").agg(F.sum(weight).alias("_sum"), kept.alias("_kept"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    left = F.greatest(F.lit(0), F.lit(usable) - F.sum("_kept").over(whole))
    ratio = F.lit(0.0)
    for tier, r in ratios.items():
        ratio = F.when(F.col("tier") == tier, F.lit(r)).otherwise(ratio)
    sums = sums.withColumn("tier_budget", F.floor(left * ratio).cast("long")).drop("_kept")
    out = scored.join(F.broadcast(sums) if not by else sums, [*by, "tier"])
    dealt = F.greatest(F.lit(LEAST), F.floor(F.col("tier_budget") * weight / F.col("_sum")))
    entry = F.when(F.col("tier") == "preserve", F.col("tokens")).when(F.col("tier") == "cut", F.lit(0)).otherwise(dealt)
    return out.withColumn("entry_budget", entry.cast("long")).drop("_sum")


def halved(budget: int | None) -> int | None:
    """What a template's first and last entry get each: half of its budget, none where there is no budget."""
    return budget // 2 if budget else None
