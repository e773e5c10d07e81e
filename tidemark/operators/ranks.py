"""Exact ranks, ties and percentiles in groups of any size, by range partitions.

Equal values collapse to one counted row, so a value that most rows have is one row. Those are dealt to tasks by
ranges of (group, value) and sorted there; a task adds up the counts it has passed. A group lies in consecutive partitions,
so its rows per partition, one small table, tell how many of its values stand in earlier ones. There is no window over a
group's rows, no sketch and no size from which on another way is taken. Rows with a null key are a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their partition and the sum of ``n`` over the rows before them in it."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        upto = np.cumsum(n) + total
        names = [*batch.schema.names, "__part", "__before"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(upto - n)], names=names)
        total = int(upto[-1]) if len(n) else total


def distinct_ranks(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys..., by..., n, below, total: each different value of a group in the order of ``by``, how many rows have it, how many of the group come before, and the group's rows."""
    key = (F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).alias("__key")
    counts = cut_lineage(rows.groupBy(key, *by).agg(F.count(F.lit(1)).alias("n")), "counts")
    dealt = counts.repartitionByRange("__key", *by).sortWithinPartitions("__key", *by)
    schema = T.StructType([*counts.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())])
    passed = cut_lineage(dealt.mapInArrow(_passed, schema), "passed")
    group = Window.partitionBy("__key")
    earlier = F.coalesce(F.sum("held").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = (
        passed.groupBy("__key", "__part")
        .agg(F.sum("n").alias("held"), F.min("__before").alias("first"))
        .select("__key", "__part", (earlier - F.col("first")).alias("__shift"), F.sum("held").over(group).alias("total"))
    )
    placed = passed.join(shifts, ["__key", "__part"])
    return placed.select(*(["__key.*"] if keys else []), *by, "n", (F.col("__before") + F.col("__shift")).alias("below"), "total")


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys..., value, name: the 1-based rank of each different value, ties averaged."""
    return distinct_ranks(rows, keys, [value]).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))


def percentiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """keys..., percentiles: linear interpolation between the neighbouring ranks, one aggregate over the counted values."""
    below, total = F.col("below"), F.col("total")

    def at(p: float) -> Column:
        return (total - 1) * F.lit(float(p))

    def held(rank: Column) -> Column:
        return F.max(F.when((rank >= below) & (rank < below + F.col("n")), F.col(value)))

    picks = []
    for i, p in enumerate(probs):
        picks += [held(F.floor(at(p))).alias(f"low{i}"), held(F.ceil(at(p))).alias(f"high{i}")]
    found = distinct_ranks(rows, keys, [value]).groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    out = [F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at(p) - F.floor(at(p))) for i, p in enumerate(probs)]
    return found.select(*keys, F.array(*out).alias("percentiles"))
