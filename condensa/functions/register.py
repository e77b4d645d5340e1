"""SQL names for the functions that have no built-in form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codecs, kernels
from ..operators.fold import fold_value


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in a session; returns their names."""

    @F.pandas_udf("string")
    def compress_string(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else codecs.compress_string(t, int(b)) for t, b in zip(texts, budgets)], dtype="object")

    @F.pandas_udf("string")
    def summarize_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else kernels.summarize(t))

    @F.pandas_udf("string")
    def fold_json(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(fold_value(json.loads(t)), ensure_ascii=False))

    @F.udtf(returnType="name string, kind string, type string, line int, endLine int, column int")
    class SourceSymbols:
        def eval(self, text: str, language: str):
            for s in codecs.symbols(text or "", language) or ():
                yield s["name"], s["kind"], s["type"], s["line"], s["endLine"], s["column"]

    own = {"condensa_compress": compress_string, "condensa_summarize": summarize_text, "condensa_fold": fold_json}
    for name, f in own.items():
        spark.udf.register(name, f)
    spark.udtf.register("condensa_symbols", SourceSymbols)
    return [*own, "condensa_symbols"]
