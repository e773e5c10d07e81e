"""Column and dataset profiles of normalised tables.

Columns are turned into (column, value) rows once and profiled by one grouped
aggregate; percentiles go through ``ranks``, because a column holds every row of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import quantiles

# Probabilities of a profile, name tokens of time columns, sparse and parse thresholds.
PROBABILITIES = (0.0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 1.0)
PROBABILITY_NAMES = ("min", "p01", "p05", "p25", "median", "p75", "p95", "p99", "max")
TIME_TOKENS = ("date", "time", "datetime", "expiration")
SPARSE_PCT = 95.0
MIN_PARSE_RATE = 0.80
MILLIS_FROM, SECONDS_FROM = 1e11, 1e8


def numeric_columns(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long_numbers(table: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    doubles = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(keys, columns, "column", "value")


def quantile_profile(
    table: DataFrame, columns: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Nine exact percentiles per column (and group); columns without values are absent."""
    keys = keys or []
    rows = quantiles.grouped_percentiles(
        _long_numbers(table, columns, keys), [*keys, "column"], "value", list(PROBABILITIES)
    )
    return rows.select(
        *keys, "column", *[F.col("percentiles")[i].alias(name) for i, name in enumerate(PROBABILITY_NAMES)]
    )


def approximate_quantile_profile(table: DataFrame, columns: list[str], keys: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """The same columns from mergeable sketches: one pass, bounded state, relative rank error 1/accuracy."""
    keys = keys or []
    grid = F.array(*[F.lit(p) for p in PROBABILITIES])
    rows = _long_numbers(table, columns, keys).filter("value is not null")
    out = rows.groupBy(*keys, "column").agg(F.approx_percentile("value", grid, accuracy).alias("p"))
    return out.select(*keys, "column", *[F.col("p")[i].alias(name) for i, name in enumerate(PROBABILITY_NAMES)])


def distinct_counts(table: DataFrame) -> DataFrame:
    """column, unique_count of every column."""
    texts = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns]).unpivot([], table.columns, "column", "text")
    # Values collapse where they are read, then per column.
    return texts.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.count("text").alias("unique_count"))


def column_profile(
    table: DataFrame, provenance: tuple[str, ...] = (), exact_distinct: bool = True
) -> DataFrame:
    """Counts, distinct values and numeric summary of every column.

    Distinct values of all columns are counted by (column, value), which spreads
    them over the cluster; ``exact_distinct=False`` uses a sketch instead.
    """
    names = table.columns
    numbers = numeric_columns(table)
    texts = table.select(*[F.col(c).cast("string").alias(c) for c in names])
    cells = texts.unpivot([], names, "column", "text")
    distinct = F.countDistinct("text") if exact_distinct else F.approx_count_distinct("text")
    counts = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("non_null_count"), distinct.alias("unique_count")
    )
    long = _long_numbers(table, numbers, []).filter("value is not null and not isnan(value)")
    stats = long.groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    median = quantiles.grouped_percentiles(long, ["column"], "value", [0.5]).select(
        "column", F.col("percentiles")[0].alias("median")
    )
    pct = F.try_divide(100.0 * F.col("non_null_count"), F.col("rows"))
    return (
        counts.join(stats.join(median, "column"), "column", "left")
        .withColumns(
            {
                "non_null_pct": F.round(pct, 4),
                "null_count": F.col("rows") - F.col("non_null_count"),
                "is_provenance": F.col("column").isin(*provenance) if provenance else F.lit(False),
            }
        )
    )


def sparse_columns(profile: DataFrame, threshold_pct: float = SPARSE_PCT) -> DataFrame:
    return profile.filter(~F.col("is_provenance") & (F.col("non_null_pct") < threshold_pct)).select("column", "non_null_pct")


def time_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if any(token in c.lower() for token in TIME_TOKENS)]


def datetime_profile(table: DataFrame) -> DataFrame:
    """Parse rate and range of columns whose name and values look like times.

    Numbers count as epoch milliseconds or seconds by their median size.
    """
    names = time_columns(table)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    numbers = [c for c in names if isinstance(kinds[c], T.NumericType)]
    texts = [c for c in names if c not in numbers]
    parts = []
    if texts:
        rows = table.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], texts, "column", "text")
        parts.append(
            rows.filter("text is not null").select("column", F.expr("try_cast(text as timestamp)").alias("at"))
        )
    if numbers:
        long = _long_numbers(table, numbers, []).filter("value is not null").withColumn("size", F.abs("value"))
        units = quantiles.grouped_percentiles(long.select("column", "size"), ["column"], "size", [0.5]).select(
            "column",
            F.when(F.col("percentiles")[0] >= MILLIS_FROM, 1000.0).when(F.col("percentiles")[0] >= SECONDS_FROM, 1.0).alias("unit"),
        )
        parts.append(
            long.join(F.broadcast(units.filter("unit is not null")), "column").select(
                "column", F.timestamp_micros((F.col("value") / F.col("unit") * 1_000_000).cast("long")).alias("at")
            )
        )
    stacked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rate = F.try_divide(F.count("at"), F.count(F.lit(1)))
    return (
        stacked.groupBy("column")
        .agg(F.round(100.0 * rate, 4).alias("parse_rate_pct"), F.min("at").alias("min_utc"), F.max("at").alias("max_utc"), rate.alias("rate"))
        .filter((F.col("rate") >= MIN_PARSE_RATE) & F.col("min_utc").isNotNull())
        .drop("rate")
    )


def symbol_column(table: DataFrame) -> str | None:
    """symbol, underlying_symbol, or the first column ending in __symbol."""
    for name in ("symbol", "underlying_symbol"):
        if name in table.columns:
            return name
    return next(iter(sorted(c for c in table.columns if c.endswith("__symbol"))), None)


def option_dataset_summary(contracts: DataFrame, fields: list[str]) -> DataFrame:
    """Per symbol and side: rows, expirations, maturity and strike ranges and field coverage."""
    symbol = F.upper(symbol_column(contracts)).alias("symbol")
    coverage = [
        F.round(F.try_divide(100.0 * F.count(c), F.count(F.lit(1))), 4).alias(f"{c}_non_null_pct") for c in fields if c in contracts.columns
    ]
    return contracts.groupBy(symbol, F.upper("put_call").alias("put_call")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("expiration_date").alias("expiration_count"),
        F.min("expiration_date").alias("expiration_min"),
        F.max("expiration_date").alias("expiration_max"),
        F.min("expiration_dte").alias("dte_min"),
        F.max("expiration_dte").alias("dte_max"),
        F.min("strike").alias("strike_min"),
        F.max("strike").alias("strike_max"),
        *coverage,
    )


def price_dataset_summary(history: DataFrame, time: str = "datetime_utc") -> DataFrame:
    """Per symbol: rows, time range and zero-volume candles."""
    zero = F.count_if(F.col("volume") == 0)
    return history.groupBy(F.upper("symbol").alias("symbol")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("start_utc"),
        F.max(time).alias("end_utc"),
        zero.alias("zero_volume_count"),
        (F.try_divide(100.0 * zero, F.count(F.lit(1)))).alias("zero_volume_pct"),
    )
