"""Macro series files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_series(spark: SparkSession, path: str, series: str) -> DataFrame:
    """A two-column CSV (date, value): "." means missing, rows without a valid date or value are dropped."""
    raw = (
        spark.read.schema("date_text string, value_text string")
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", ".")
        .csv(path)
    )
    return raw.select(
        F.expr("try_cast(trim(date_text) as date)").alias("obs_date"),
        F.lit(series).alias("series"),
        F.expr("try_cast(trim(value_text) as double)").alias("value"),
    ).filter("obs_date is not null and value is not null and not isnan(value)")
