"""Code outlines as tables: symbols, their summary, containment and scopes of source files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, outline

SYMBOL = "path string, language string, name string, kind string, type string, line long, endLine long, column long"


def _table(files: DataFrame, schema: str, rows_of) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for x in batches:
            rows = [(path, language, *(r.get(c) for c in columns[2:])) for path, language, text in zip(x.path, x.language, x.text) for r in rows_of(text or "", language) or ()]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "text").mapInPandas(run, schema)


def symbols(files: DataFrame, packs: dict[str, outline.Rules] | None = None) -> DataFrame:
    """Definitions and references of files (path, language, text); none for languages that aren't known. ``packs``: rules of ``outline.load_rules``."""
    return _table(files, SYMBOL, lambda text, language: codecs.symbols(text, language, packs))


def definitions(table: DataFrame) -> DataFrame:
    return table.filter("kind = 'def'")


def select(table: DataFrame, kind: str | None = None, type_: str | None = None, name: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    out = table.filter(F.col("kind") == kind) if kind else table
    out = out.filter(F.col("type") == type_) if type_ else out
    out = out.filter(F.contains(F.lower("name"), F.lit(name.lower()))) if name else out
    return out.filter(~F.col("type").isin(*exclude)) if exclude else out


def _plural(noun, n):
    many = F.when(noun.endswith("s"), F.concat(noun, F.lit("es"))).when(noun.endswith("y"), F.concat(F.substring(noun, F.lit(1), F.length(noun) - 1), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(many))


def summary(table: DataFrame) -> DataFrame:
    """(path, summary): how many definitions of each type, as text; files without any have no row."""
    counts = definitions(table).groupBy("path", "type").agg(F.count("*").alias("n"))
    parts = counts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("c"))
    return parts.select("path", F.array_join(F.transform("c", lambda x: _plural(x["type"], x["n"])), ", ").alias("summary"))


def file_summary(files: DataFrame, longest: int | None = None) -> DataFrame:
    """The summary of each file; with ``longest`` none of files over that many characters."""
    return summary(symbols(files if longest is None else files.filter(F.length("text") <= longest)))


def find(table: DataFrame, name: str, near: int | None = None) -> DataFrame:
    """Definitions by plain or dotted name (the parent holds the child's lines), nearest line first."""
    parent, _, child = name.rpartition(".")
    own = definitions(table).filter(F.col("name") == child)
    if parent:
        outer = definitions(table).filter(F.col("name") == parent.rpartition(".")[2]).select("path", F.col("line").alias("_from"), F.col("endLine").alias("_to")).distinct()
        own = own.join(outer, "path").filter((F.col("_from") <= F.col("line")) & (F.col("_to") >= F.col("endLine"))).drop("_from", "_to").distinct()
    return own.orderBy(F.abs(F.col("line") - near), "path", "line") if near is not None else own.orderBy("path", "line")


def scopes(files: DataFrame) -> DataFrame:
    return _table(files, "path string, language string, scope string, name string, startLine long, endLine long, bindings array<string>", codecs.scopes)


def innermost(points: DataFrame, scope_table: DataFrame) -> DataFrame:
    """Adds to (path, line) the shortest scope that holds the line."""
    own = scope_table.select("path", F.col("scope"), F.col("name").alias("scope_name"), "startLine", "endLine")
    held = points.join(own, "path").filter("startLine <= line AND line <= endLine")
    best = Window.partitionBy(*[c for c in points.columns]).orderBy(F.col("endLine") - F.col("startLine"), F.desc("startLine"))
    return held.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def syntax_errors(files: DataFrame) -> DataFrame:
    return _table(files, "path string, language string, line long, column long, message string", lambda t, lang: codecs.syntax_errors(t, lang))


def injections(files: DataFrame) -> DataFrame:
    def rows(text, language):
        return [{"embedded": r["language"], **r} for r in codecs.injections(text, language) or ()]

    return _table(files, "path string, language string, embedded string, startLine long, endLine long", rows)


def outlines(files: DataFrame) -> DataFrame:
    """(path, text, structure) for the structured codec: 0-based blocks of definitions, none exported, without anchors."""
    own = definitions(symbols(files)).filter(F.col("type").isin("function", "class", "method", "interface", "enum"))
    block = F.struct(F.col("type"), F.col("name"), (F.col("line") - 1).alias("startLine"), (F.col("endLine") - 1).alias("endLine"), F.lit(False).alias("exported"))
    return files.select("path", "text").join(own.groupBy("path").agg(F.sort_array(F.collect_list(block)).alias("structure")), "path", "left")
