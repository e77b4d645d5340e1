"""Logs as tables of lines: templates, severities, and a budget filled by severity.

A log is the rows of one group; ``n`` is a line's place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ERROR_KEYWORDS, MEDIUM_KEYWORDS, SEVERITY, normalized, stripped


def lines_of(logs: DataFrame, log: str, text: str) -> DataFrame:
    return logs.select(F.col(log).alias("log"), F.posexplode(F.split(text, "\n")).alias("n", "line"))


def severity(line: Column) -> Column:
    """0 with an error's word, 1 with a severity and a warning's word, else 2."""
    low = F.lower(line)
    return F.when(low.rlike("|".join(ERROR_KEYWORDS)), 0).when(line.rlike(SEVERITY) & low.rlike("|".join(MEDIUM_KEYWORDS)), 1).otherwise(2)


def template_counts(lines: DataFrame, least: int = 3) -> DataFrame:
    """(log, form, times) of templates seen at least ``least`` times."""
    own = lines.withColumn("form", normalized(stripped("line"))).filter("form <> ''")
    return own.groupBy("log", "form").agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def compress(lines: DataFrame, budget: int) -> DataFrame:
    """(log, compressed): kept lines in order with marks of repetition, and how many were left out.

    Kept are the first two lines of each template; a severity class is a prefix of its lines that
    fits what the classes before left: three running sums, no fold.
    """
    own = lines.withColumn("own", stripped("line")).withColumn("form", normalized("own"))
    blank = F.col("own") == ""
    place = Window.partitionBy("log", "form").orderBy("n")
    own = own.withColumn("times", F.count("*").over(Window.partitionBy("log", "form"))).withColumn("seen", F.row_number().over(place))
    first = own.filter(~blank & (F.col("seen") <= 2)).withColumn("class", severity(F.col("own"))).withColumn("size", F.length("line") + 1)
    kept, left = None, F.lit(budget).cast("long")
    for c in range(3):
        running = F.sum("size").over(Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        group = first.filter(F.col("class") == c)
        if kept is not None:
            used = kept.groupBy("log").agg(F.sum("size").alias("_used"))
            group = group.join(used, "log", "left").withColumn("_left", F.lit(budget) - F.coalesce("_used", F.lit(0))).drop("_used")
        else:
            group = group.withColumn("_left", left)
        fits = group.withColumn("_run", running).filter(F.col("_run") <= F.col("_left")).drop("_run", "_left")
        kept = fits if kept is None else kept.unionByName(fits)
    shown = F.when(F.col("times") > 2, F.concat("line", F.lit("  [repeated "), F.col("times").cast("string"), F.lit(" times]"))).otherwise(F.col("line"))
    texts = kept.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))).alias("lines"))
    total = lines.groupBy("log").agg(F.count("*").alias("total"))
    out = total.join(texts, "log", "left")
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(""))
    omitted = F.col("total") - F.coalesce(F.size("lines"), F.lit(0))
    return out.select("log", F.when(omitted > 0, F.concat(body, F.lit("\n... ["), omitted.cast("string"), F.lit(" log lines omitted]"))).otherwise(body).alias("compressed"))
