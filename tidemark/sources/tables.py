"""Price files, run-derived price matrices and write-once outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import table_fingerprint
from tidemark.operators import hash_tree
from tidemark.operators.history import table_exists
from tidemark.session import cut_lineage


def scan_prices(spark: SparkSession, path: str, assets: list[str], universe: str = "ALL") -> DataFrame:
    """A wide daily price CSV (date, one column per asset) as long rows; unreadable cells become NULL."""
    columns = ", ".join(["date_text string", *[f"`{a}` string" for a in assets]])
    wide = spark.read.schema(columns).option("header", True).option("enforceSchema", True).csv(path)
    long = wide.unpivot(["date_text"], [F.col(f"`{a}`") for a in assets], "asset", "text")
    number = F.expr("try_cast(text as double)")
    return long.select(
        F.lit(universe).alias("universe_id"),
        F.to_date(F.expr("try_cast(date_text as timestamp)")).alias("session"),
        "asset",
        F.when(~F.isnan(number), number).alias("close"),
    ).filter("session is not null")


def price_matrix_from_run(history: DataFrame, expected: DataFrame) -> DataFrame:
    """Closes per (session, symbol) of one run's candles; the last candle of a day counts.

    ``history`` is the normalised price-history table and ``expected`` a table
    of ``symbol``. Other symbols are left out; see ``missing_symbols`` for the reverse.
    """
    rows = history.filter(F.col("close") > 0).join(expected.select("symbol"), "symbol", "left_semi")
    return (
        rows.groupBy(F.to_date("datetime_utc").alias("session"), F.col("symbol").alias("asset"))
        .agg(F.max_by("close", F.struct("datetime_utc", "raw_record_id", "candle_index")).alias("close"))
        .withColumn("universe_id", F.lit("RUN"))
        .select("universe_id", "session", "asset", "close")
    )


def missing_symbols(matrix: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected symbols without any close."""
    return expected.join(matrix.select(F.col("asset").alias("symbol")).distinct(), "symbol", "left_anti")


def wide_matrix(matrix: DataFrame, assets: list[str], value: str = "close") -> DataFrame:
    """One row per session with a column per asset."""
    return matrix.groupBy("universe_id", "session").pivot("asset", assets).agg(F.first(value, ignorenulls=True))


def write_matrix(table: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write Parquet and report rows and columns counted while writing."""
    seen = Observation("write")
    table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return {"rows": seen.get["rows"], "columns": len(table.columns)}


class ContentChanged(ValueError):
    """A create-once output exists with other content."""


#: Changed ranges that an error names.
NAMED_RANGES = 20


def write_once(table: DataFrame, path: str, levels: dict[str, Column] | None = None) -> str:
    """CREATED on first write, EXISTS on an identical rerun, an error when the content differs.

    Identity is the order-free fingerprint of all columns by name, compared on the driver as
    one digest per table. With ``levels`` (see ``hash_tree``) a hash tree of key ranges is written
    beside the table: a rerun is compared with the tree alone, and the error names the ranges that differ.
    """
    spark = table.sparkSession
    names = sorted(table.columns)
    if not table_exists(spark, path):
        if levels:
            table = cut_lineage(table, "once")
        table.write.mode("errorifexists").parquet(path)
        if levels:
            hash_tree.build(table, names, levels).write.mode("overwrite").parquet(tree_path(path))
        return "CREATED"
    stored = spark.read.parquet(path)
    if sorted(stored.columns) != names:
        raise ContentChanged(f"{path}: columns differ")
    if levels:
        differing = changed_since(table, path, levels).filter(F.col("level") == len(levels))
        found = differing.orderBy(*levels).limit(NAMED_RANGES).collect()
        if found:
            said = ", ".join("/".join(str(r[n]) for n in levels) + " " + r["change"] for r in found)
            raise ContentChanged(f"{path}: content differs in {said}")
        return "EXISTS"
    before, now = (table_fingerprint(t, names).first() for t in (stored, table))
    if before != now:
        raise ContentChanged(f"{path}: content differs")
    return "EXISTS"


def tree_path(path: str) -> str:
    return f"{path.rstrip('/')}__tree"


def changed_since(table: DataFrame, path: str, levels: dict[str, Column]) -> DataFrame:
    """Ranges of ``table`` that differ from what was written to ``path``, by the tree stored with it; one that a crash left out is made anew."""
    spark = table.sparkSession
    names = sorted(table.columns)
    if not table_exists(spark, tree_path(path)):
        hash_tree.build(spark.read.parquet(path), names, levels).write.mode("overwrite").parquet(tree_path(path))
    tree = cut_lineage(hash_tree.build(table, names, levels), "tree")
    return hash_tree.changed(spark.read.parquet(tree_path(path)), tree, list(levels))


def tampered_ranges(spark: SparkSession, path: str, levels: dict[str, Column]) -> DataFrame:
    """Ranges of the table at ``path`` that no longer are what its stored tree says."""
    return changed_since(spark.read.parquet(path), path, levels)
