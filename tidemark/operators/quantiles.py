"""Exact grouped medians and percentiles of expressions, through ``ranks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranks


def grouped_medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Median of each named expression per group; NULL when it has no value."""
    picked = ranks.percentiles(_long(df, keys, values), [*keys, "metric"], "value", [0.5])
    wide = picked.groupBy(_key(keys)).pivot("metric", list(values)).agg(F.first(F.col("percentiles")[0]))
    # A struct is never null, so groups with a null key find their medians.
    groups = df.select(_key(keys)).distinct()
    return groups.join(wide, "__key", "left").select("__key.*", *values)


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Array of percentiles of one column per group."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return ranks.percentiles(rows.select(*keys, F.col(value).alias("value")), keys, "value", probs)


def _key(keys: list[str]) -> Column:
    return F.struct(*keys).alias("__key")


def _long(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value")) for name, v in values.items()]
    return (
        df.select(*keys, F.explode(F.array(*cells)).alias("cell"))
        .select(*keys, "cell.metric", "cell.value")
        .filter("value is not null")
    )
