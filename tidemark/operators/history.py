"""Append-only tables with a primary key: idempotent, conflict-checked appends.

New rows come from an anti-join on the key and conflicts from an inner join, so
an append never rewrites history. A job that dies and runs again finds its
committed rows and appends only the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

TOLERANCE = 1e-12
EXISTS, APPENDED, DRY_RUN = "EXISTS", "APPENDED", "DRY_RUN"


class HistoryConflict(ValueError):
    """A key is already present with different content, or repeats inside a batch."""


@dataclass(frozen=True)
class AppendReport:
    status: str
    incoming_rows: int
    appended_rows: int


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def null_in(keys: list[str]) -> Column:
    """Rows that no key can name; they equal nothing, so they would be appended again each time."""
    return reduce(lambda p, q: p | q, [F.col(k).isNull() for k in keys])


def same_partitions(existing: DataFrame, incoming: DataFrame, partition_by: list[str] | None) -> DataFrame:
    """History restricted to the partitions a batch touches; the semi-join prunes the scan at run time.

    The partition columns must be part of the key, so no match can lie elsewhere.
    """
    if not partition_by:
        return existing
    return existing.join(incoming.select(*partition_by).distinct(), partition_by, "left_semi")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(existing.select(*keys), keys, "left_anti")


def _differs(field: T.StructField, tolerance: float) -> Column:
    a, b = F.col(f"x.{field.name}"), F.col(f"y.{field.name}")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        close = (F.abs(a - b) <= tolerance) | (F.isnan(a) & F.isnan(b))
        return ~(a.eqNullSafe(b) | F.coalesce(close, F.lit(False)))
    return ~a.eqNullSafe(b)


def conflicts(
    existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str] | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """Keys on both sides whose compared fields differ, with the names of the fields."""
    names = fields or [c for c in incoming.columns if c not in keys]
    kinds = {f.name: f for f in incoming.schema.fields}
    on = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    changed = F.array_compact(F.array(*[F.when(_differs(kinds[n], tolerance), F.lit(n)) for n in names]))
    return (
        existing.alias("x")
        .join(incoming.alias("y"), on)
        .select(*[F.col(f"y.{k}").alias(k) for k in keys], changed.alias("changed_fields"))
        .filter(F.size("changed_fields") > 0)
    )


def classify(
    existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str] | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """Incoming rows labelled NEW, MATCH or CONFLICT in one join."""
    names = fields or [c for c in incoming.columns if c not in keys]
    kinds = {f.name: f for f in incoming.schema.fields}
    on = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    changed = reduce(lambda p, q: p | q, [_differs(kinds[n], tolerance) for n in names], F.lit(False))
    label = F.when(F.col(f"x.{keys[0]}").isNull(), "NEW").when(changed, "CONFLICT").otherwise("MATCH")
    return incoming.alias("y").join(existing.alias("x"), on, "left").select("y.*", label.alias("append_status"))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table has been committed at a path on any supported file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(jvm_path))


def idempotent_append(
    path: str, incoming: DataFrame, keys: list[str], fields: list[str] | None = None, tolerance: float = TOLERANCE,
    dry_run: bool = False, partition_by: list[str] | None = None,
) -> AppendReport:
    """Append unseen keys to a Parquet table; overlapping keys must match.

    ``fields`` names the immutable columns of a ledger; by default every
    non-key column is compared. With ``partition_by`` (key columns) a batch
    reads only the partitions it touches. Only counts and one sample key reach
    the driver.
    """
    if partition_by and not set(partition_by) <= set(keys):
        raise ValueError("partition columns must belong to the key")
    spark = incoming.sparkSession
    if dry_run:
        return AppendReport(DRY_RUN, incoming.count(), 0)
    # The batch is read by every check below, so it is computed once.
    incoming = cut_lineage(incoming, "batch")
    total = incoming.count()
    unnamed = incoming.filter(null_in(keys)).select(*keys).first()
    if unnamed is not None:
        raise HistoryConflict(f"incoming batch has a null in its key: {unnamed.asDict()}")
    repeated = duplicate_keys(incoming, keys).first()
    if repeated is not None:
        raise HistoryConflict(f"incoming batch repeats key {repeated.asDict()}")
    fresh = incoming
    if table_exists(spark, path):
        existing = spark.read.parquet(path)
        if existing.columns != incoming.columns and sorted(existing.columns) != sorted(incoming.columns):
            raise HistoryConflict(f"columns differ: {sorted(set(existing.columns) ^ set(incoming.columns))}")
        existing = same_partitions(existing, incoming, partition_by)
        twice = duplicate_keys(existing, keys).first()
        if twice is not None:
            raise HistoryConflict(f"history repeats key {twice.asDict()}")
        clash = conflicts(existing, incoming, keys, fields, tolerance).first()
        if clash is not None:
            raise HistoryConflict(f"existing key has different content: {clash.asDict()}")
        fresh = new_rows(existing, incoming, keys)
    if fresh.isEmpty():
        return AppendReport(EXISTS, total, 0)
    seen = Observation("append")
    writer = fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return AppendReport(APPENDED, total, seen.get["rows"])


# Keys of the ledgers and the columns that may differ between reruns.
OPTION_HISTORY_KEY = [
    "capture_timestamp_utc", "run_id", "underlying_symbol", "feature_schema_version", "quality_policy_version",
]
CANDIDATE_KEY = ["scanner_snapshot_sha256", "symbol", "handoff_contract_version"]
SIGNAL_KEY = ["information_date", "model_version"]
WEIGHT_KEY = ["information_date", "model_version", "asset"]
PLAN_KEY = ["order_plan_hash"]
PLAN_DETAIL_KEY = ["order_plan_hash", "asset"]
MUTABLE = ("generated_at_utc",)


def ledger_append(path: str, incoming: DataFrame, keys: list[str], **options) -> AppendReport:
    """Append to a ledger: every column is immutable but the generation time."""
    fields = [c for c in incoming.columns if c not in keys and c not in MUTABLE]
    return idempotent_append(path, incoming, keys, fields, **options)
