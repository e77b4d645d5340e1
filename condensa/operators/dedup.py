"""Exact, near and template duplicates of entries.

An entry has ``idx`` (its place), ``etype`` (dict, list, string or primitive), ``canon`` (its
canonical form) and ``norm`` (that with volatile parts masked; null for types without near
duplicates). First occurrences are least places of a group, found by partial aggregation and joined
back on the place, which is unique: a copy that a third of all entries share is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def statuses(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, idx, status) of the first entries of their canonical form: unique, or near (their normal form came before). All others are exact.

    Only places and digests are grouped and joined; bodies stay where they are.
    """
    scope = scope or []
    digest = lambda c: F.unhex(F.sha2(F.col(c), 256))
    own = entries.select(*scope, "idx", digest("canon").alias("_exact"), digest("norm").alias("_near"))
    first = cut(own.groupBy(*scope, "_exact").agg(F.min(F.struct("idx", "_near")).alias("x")).select(*scope, "x.*"))
    near = first.filter("_near IS NOT NULL").groupBy(*scope, "_near").agg(F.min("idx").alias("idx")).select(*scope, "idx", F.lit(True).alias("_own"))
    status = F.when(F.col("_near").isNotNull() & F.col("_own").isNull(), "near").otherwise("unique")
    return first.join(near, [*scope, "idx"], "left").select(*scope, "idx", status.alias("status"))


def classify(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Adds ``status``: unique, exact (its canonical form came before) or near (first of its form, but not of its normal form)."""
    scope = scope or []
    return entries.join(statuses(entries, scope), [*scope, "idx"], "left").withColumn("status", F.coalesce("status", F.lit("exact")))


def unique(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The entries that are unique; others are left out before their bodies are moved."""
    scope = scope or []
    return entries.join(statuses(entries, scope).filter("status = 'unique'").drop("status"), [*scope, "idx"], "left_semi")


def dedup_stats(classified: DataFrame, templates_removed: DataFrame | None = None) -> DataFrame:
    """One row: entries dropped as exact, near and template, and in all."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    out = classified.agg(count("exact").alias("exact"), count("near").alias("near"), count("template").alias("template"))
    return out.withColumn("total_removed", F.col("exact") + F.col("near") + F.col("template"))


def schema_groups(records: DataFrame) -> DataFrame:
    """(schema, n): entries by their sorted top-level keys; ``fields`` is a map of key to value."""
    return records.groupBy(F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("schema")).agg(F.count("*").alias("n"))


def templates(records: DataFrame, value_share: float = 0.8, key_share: float = 0.3, least: int = 3) -> DataFrame:
    """Spans of entries of one schema that mostly repeat: schema, static keys, count, first and last place.

    A key is static if over ``value_share`` of the group's rows have its commonest value; a group
    is a template if over ``key_share`` of its keys are. Groups with the same static map are one
    template, that of the last of them.
    """
    own = records.select("idx", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("schema"), "fields")
    groups = own.groupBy("schema").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max(F.size("fields")).alias("keys")).filter(F.col("n") >= least)
    values = own.select("schema", F.explode("fields").alias("key", "value")).groupBy("schema", "key", "value").agg(F.count("*").alias("c"))
    top = values.groupBy("schema", "key").agg(F.max(F.struct(F.col("c"), F.col("value"))).alias("top"))
    static = top.join(groups, "schema").filter(F.col("top.c") > value_share * F.col("n"))
    static = static.groupBy("schema", "n", "first_idx", "last_idx", "keys").agg(F.array_sort(F.collect_list(F.concat_ws("=", "key", "top.value"))).alias("static"))
    found = static.filter(F.size("static") > key_share * F.col("keys"))
    last = Window.partitionBy("static").orderBy(F.desc("first_idx"))
    return found.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("schema", F.array_join("static", ";").alias("static"), F.col("n").alias("count"), "first_idx", "last_idx")


def collapse(entries: DataFrame, spans: DataFrame, same_schema: bool = False) -> DataFrame:
    """Adds ``removed`` (a dict strictly inside a span) and ``template_count`` (of the span that an entry opens).

    An entry is inside some span exactly if the furthest end among the spans that open before it
    lies beyond it: a running maximum over entries and openings in order of place. Rows are ranged by
    place, and each range starts from the maximum of those before, so no task holds all. With
    ``same_schema`` only spans of the entry's own schema count.
    """
    counts = spans.select(F.col("first_idx").alias("idx"), F.col("count").alias("template_count"))
    if same_schema:
        own = spans.select("schema", "first_idx", "last_idx")
        inside = entries.select("idx", "schema").join(own, "schema").filter("first_idx < idx AND idx < last_idx").select("idx").distinct().withColumn("_in", F.lit(True))
        out = entries.join(inside, "idx", "left").withColumn("removed", F.coalesce("_in", F.lit(False)) & (F.col("etype") == "dict")).drop("_in")
        return out.join(counts, "idx", "left")
    # An opening sorts behind the entry at its own place, which is not inside it.
    both = entries.select("idx", F.lit(0).alias("opening"), F.lit(None).cast("long").alias("reach"))
    both = both.union(spans.select("first_idx", F.lit(1), "last_idx"))
    ranged = cut(both.repartitionByRange("idx", "opening").withColumn("_part", F.spark_partition_id()))
    tops = ranged.groupBy("_part").agg(F.max("reach").alias("top"))
    before = F.max("top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_part", before.alias("_carried"))
    run = F.max("reach").over(Window.partitionBy("_part").orderBy("idx", "opening").rowsBetween(Window.unboundedPreceding, 0))
    reached = ranged.withColumn("_run", run).filter("opening = 0").join(F.broadcast(tops), "_part")
    inside = reached.filter(F.greatest("_run", "_carried") > F.col("idx")).select("idx").withColumn("_in", F.lit(True))
    out = entries.join(inside, "idx", "left").withColumn("removed", F.coalesce("_in", F.lit(False)) & (F.col("etype") == "dict")).drop("_in")
    return out.join(counts, "idx", "left")


def bounded_first(entries: DataFrame, session: str, size: int) -> DataFrame:
    """Rows of each session that the last ``size`` inserted keys don't hold, in order of arrival (first in, first out)."""

    def fold(pdf):
        held: dict = {}
        keep = []
        for key in pdf.sort_values("idx").canon:
            new = key not in held
            keep.append(new)
            if new:
                held[key] = True
                if len(held) > size:
                    held.pop(next(iter(held)))
        return pdf.sort_values("idx")[keep]

    return entries.groupBy(session).applyInPandas(fold, entries.schema)


