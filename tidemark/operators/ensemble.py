"""Consensus of several allocators and their disagreement.

Weight rows: ``universe_id, as_of, model, asset, weight``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["universe_id", "as_of"]


def consensus_weights(weights: DataFrame, importance: dict[str, float] | None = None) -> DataFrame:
    """Importance-weighted mean over models, renormalised; equal importance by default."""
    if importance is None:
        share: Column = F.lit(1.0)
    else:
        pairs = [F.lit(v) for item in importance.items() for v in (item[0], float(item[1]))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("model")), F.lit(0.0))
    mixed = weights.groupBy(*GROUP, "asset").agg(F.sum(F.col("weight") * share).alias("weight"))
    return mixed.withColumn("weight", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy(*GROUP))))


def allocation_disagreement(weights: DataFrame) -> DataFrame:
    """Mean, spread and range of each asset's weight over models, with the mean spread of the allocation."""
    spread = F.max("weight") - F.min("weight")
    rows = weights.groupBy(*GROUP, "asset").agg(
        F.avg("weight").alias("mean_weight"),
        F.stddev_pop("weight").alias("allocation_std"),
        spread.alias("allocation_range"),
        F.when(F.avg("weight") != 0, spread / F.avg("weight")).otherwise(0.0).alias("disagreement_score"),
    )
    return rows.withColumn("overall_disagreement", F.avg("allocation_std").over(Window.partitionBy(*GROUP)))


def agreement_label(score: Column) -> Column:
    """HIGH up to 0.5, MEDIUM up to 1.0, LOW beyond."""
    return F.when(score <= 0.5, "HIGH").when(score <= 1.0, "MEDIUM").otherwise("LOW")
