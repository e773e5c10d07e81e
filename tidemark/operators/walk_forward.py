"""Expanding-window walk-forward evaluation of six allocators over many universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import allocators, covariance, ensemble, forecast, periods
from tidemark.session import cut_lineage

# Rows before the first portfolio, cap, forecast span and cost.
MIN_TRAINING = 756
MAX_WEIGHT = 0.40
EWMA_SPAN = 126
COST_BPS = 5.0
RISK_MODELS = ["minimum_variance", "risk_parity", "hrp"]


def walk_forward_weights(
    returns: DataFrame, min_training: int = MIN_TRAINING, high: float = MAX_WEIGHT, span: int = EWMA_SPAN,
    risk_free: float = 0.0, annual_periods: int = 252, status: bool = False,
) -> DataFrame:
    """Weights of all six models at every eligible month-end, from data up to that date only; with ``status`` also whether solvers came to their end."""
    sums = covariance.expanding_pair_sums(returns, min_training)
    cov = cut_lineage(covariance.shrunk_from_sums(sums, annual_periods).drop("shrinkage"))
    dates = cov.select("universe_id", "as_of").distinct()
    known = forecast.expected_returns(returns, span, annual_periods).select(
        "universe_id", F.col("session").alias("as_of"), "asset", F.col("robust").alias("expected")
    )
    solved = cut_lineage(
        allocators.solved_weights(cov, known.join(dates, ["universe_id", "as_of"], "left_semi"), high=high, risk_free=risk_free, status=status)
    )
    assets = cov.filter("asset_i = asset_j").select("universe_id", "as_of", F.col("asset_i").alias("asset"))
    consensus = ensemble.consensus_weights(solved.filter(F.col("model").isin(RISK_MODELS))).withColumn(
        "model", F.lit("risk_consensus")
    )
    columns = ["universe_id", "as_of", "model", "asset", "weight"]
    given = allocators.equal_weight(assets).select(*columns).unionByName(consensus.select(*columns))
    if status:
        return solved.select(*columns, "converged").unionByName(given.withColumn("converged", F.lit(True)))
    return solved.select(*columns).unionByName(given)


def walk_forward(returns: DataFrame, cost_bps=COST_BPS, **settings) -> tuple[DataFrame, DataFrame]:
    """(period results, weights); the last month-end has no forward period and yields weights only."""
    weights = cut_lineage(walk_forward_weights(returns, **settings)).withColumnRenamed("as_of", "rebalance_date")
    realized = cut_lineage(periods.period_returns(returns))
    return periods.strategy_period_results(weights, realized, cost_bps), weights
