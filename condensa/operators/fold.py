"""Folding of long arrays to their count and first elements."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The key that marks a folded array (give another where readers expect it), and how many elements stay.
MARKER, SAMPLE = "__folded", 3


def folded(array, threshold: int = 5) -> Column:
    """Count and sample of an array column over ``threshold``; null where it is short enough to stay."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    array = F.col(array) if isinstance(array, str) else array
    return F.when(F.size(array) > threshold, F.struct(F.size(array).cast("long").alias("count"), F.slice(array, 1, SAMPLE).alias("sample")))


def fold_groups(rows: DataFrame, group: str, order: str, value: str, threshold: int = 5) -> DataFrame:
    """The same for arrays that are rows: (group, count, sample) of the groups over ``threshold``, sample in order."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    place = Window.partitionBy(group).orderBy(order, value)
    first = rows.select(group, order, value).withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= SAMPLE)
    sample = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("s")).select(group, F.transform("s", lambda x: x[value]).alias("sample"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("count")).filter(F.col("count") > threshold)
    return sizes.join(sample, group)


def fold_value(value: Any, threshold: int = 5, marker: str = MARKER) -> Any:
    """Recursive folding of an untyped JSON value."""
    if isinstance(value, dict):
        return {k: fold_value(v, threshold, marker) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        if len(value) > threshold:
            return {marker: True, "count": len(value), "sample": [fold_value(v, threshold, marker) for v in value[:SAMPLE]]}
        return [fold_value(v, threshold, marker) for v in value]
    return value


def fold_json(text, threshold: int = 5, marker: str = MARKER) -> Column:
    """``fold_value`` over JSON text, arrays at any depth; text that isn't JSON stays."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(fold_value(json.loads(t), threshold, marker), ensure_ascii=False)
            except (TypeError, ValueError):
                return t

        return texts.map(one)

    return run(F.col(text) if isinstance(text, str) else text)
