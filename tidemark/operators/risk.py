"""Variance and risk shares of many portfolios against a long covariance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _exposure(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """(Sigma w) per holding: the inner sum runs map-side over the column assets."""
    shared = [k for k in ("universe_id", "as_of") if k in cov.columns and k in weights.columns]
    carried = [k for k in ("universe_id", "as_of") if k in cov.columns and k not in keys]
    columns = weights.select(*dict.fromkeys([*keys, *shared]), F.col("asset").alias("asset_j"), F.col("weight").alias("w_j"))
    groups = list(dict.fromkeys([*keys, *carried]))
    inner = (
        columns.join(cov, [*shared, "asset_j"])
        .groupBy(*groups, F.col("asset_i").alias("asset"))
        .agg(
            F.sum(F.col("cov") * F.col("w_j")).alias("exposure"),
            F.max(F.when(F.col("asset_i") == F.col("asset_j"), F.col("cov"))).alias("own_variance"),
        )
    )
    held = weights.select(*dict.fromkeys([*keys, *shared]), "asset", "weight")
    return inner.join(held, [*[k for k in groups if k in held.columns], "asset"])


def _groups(cov: DataFrame, keys: list[str]) -> list[str]:
    return list(dict.fromkeys([*keys, *[k for k in ("universe_id", "as_of") if k in cov.columns]]))


def portfolio_variance(weights: DataFrame, cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["portfolio_id"]
    variance = F.sum(F.col("weight") * F.col("exposure"))
    return (
        _exposure(weights, cov, keys)
        .groupBy(*_groups(cov, keys))
        .agg(variance.alias("variance"), F.sqrt(variance).alias("volatility"))
    )


def risk_contributions(weights: DataFrame, cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Marginal, component and percentage risk per holding; all zero when there is no variance."""
    keys = keys or ["portfolio_id"]
    group = Window.partitionBy(*_groups(cov, keys))
    variance = F.sum(F.col("weight") * F.col("exposure")).over(group)
    rows = _exposure(weights, cov, keys).withColumn("variance", variance)
    positive = F.col("variance") > 0
    volatility = F.sqrt("variance")
    return rows.select(
        *_groups(cov, keys),
        "asset",
        "weight",
        F.sqrt("own_variance").alias("asset_volatility"),
        F.when(positive, F.col("exposure") / volatility).otherwise(0.0).alias("marginal_risk"),
        F.when(positive, F.col("weight") * F.col("exposure") / volatility).otherwise(0.0).alias("component_risk"),
        F.when(positive, F.col("weight") * F.col("exposure") / F.col("variance")).otherwise(0.0).alias("risk_share"),
    )


def risk_concentration(contributions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["portfolio_id"]
    squares = F.sum(F.col("risk_share") * F.col("risk_share"))
    return contributions.groupBy(*keys).agg(
        squares.alias("risk_concentration"), F.try_divide(F.lit(1.0), squares).alias("effective_risk_positions")
    )


def allocation_comparison(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Volatility, weight and risk concentration of each allocator on the same covariance."""
    contributions = risk_contributions(weights, cov, keys)
    groups = _groups(cov, keys)
    return contributions.groupBy(*groups).agg(
        F.sum("component_risk").alias("volatility"),
        F.sum(F.col("weight") * F.col("weight")).alias("weight_concentration"),
        F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective_positions"),
        F.sum(F.col("risk_share") * F.col("risk_share")).alias("risk_concentration"),
        F.try_divide(F.lit(1.0), F.sum(F.col("risk_share") * F.col("risk_share"))).alias("effective_risk_positions"),
        F.max("weight").alias("largest_weight"),
        F.max("risk_share").alias("largest_risk_share"),
    )
