"""Holding periods, drift, turnover and costs for any weight history.

``period_returns`` rows: ``universe_id, rebalance_date, period_end, asset, ret``.
Weight rows: ``universe_id, model, rebalance_date, asset, weight``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_end_dates(returns: DataFrame) -> DataFrame:
    """Last observed session of each month."""
    return returns.groupBy("universe_id", F.trunc("session", "month").alias("month")).agg(
        F.max("session").alias("month_end")
    )


def period_map(returns: DataFrame) -> DataFrame:
    """Consecutive month-ends as ``rebalance_date, period_end`` with the month they cover."""
    order = Window.partitionBy("universe_id").orderBy("month")
    return (
        month_end_dates(returns)
        .withColumn("rebalance_date", F.lag("month_end").over(order))
        .filter("rebalance_date is not null")
        .select("universe_id", "month", "rebalance_date", F.col("month_end").alias("period_end"))
    )


def period_returns(returns: DataFrame) -> DataFrame:
    """Compounded asset return over (rebalance_date, period_end].

    A session belongs to the period that ends at its own month-end, so the
    interval lookup is an equi-join on the month after a partial aggregate.
    """
    compounded = returns.groupBy("universe_id", F.trunc("session", "month").alias("month"), "asset").agg(
        (F.product(1.0 + F.col("ret")) - 1.0).alias("ret")
    )
    return compounded.join(period_map(returns), ["universe_id", "month"]).select(
        "universe_id", "rebalance_date", "period_end", "asset", "ret"
    )


def drifted_weights(weights: DataFrame, realized: DataFrame) -> DataFrame:
    """Weights after the period's returns and before the next rebalance."""
    group = Window.partitionBy("universe_id", "model", "rebalance_date")
    ended = F.col("weight") * (1.0 + F.col("ret"))
    return (
        weights.join(realized, ["universe_id", "rebalance_date", "asset"])
        .withColumn("ended", ended)
        .withColumn("drifted_weight", F.try_divide(F.col("ended"), F.sum("ended").over(group)))
        .drop("ended")
    )


def turnover(weights: DataFrame, realized: DataFrame) -> DataFrame:
    """Half the absolute change from the drifted previous target; a first period trades everything once.

    Drift depends on the previous target alone, so current weights and the
    previous drifted weights are stacked with opposite signs and summed; assets
    missing on either side need no filling.
    """
    model = ["universe_id", "model"]
    drifted = drifted_weights(weights, realized)
    dates = weights.select(*model, "rebalance_date").distinct()
    following = dates.withColumn(
        "next_date", F.lead("rebalance_date").over(Window.partitionBy(*model).orderBy("rebalance_date"))
    )
    carried = (
        drifted.join(following, [*model, "rebalance_date"])
        .filter("next_date is not null")
        .select(
            *model, F.col("next_date").alias("rebalance_date"), "asset", (-F.col("drifted_weight")).alias("change")
        )
    )
    current = weights.select(*model, "rebalance_date", "asset", F.col("weight").alias("change"))
    traded = (
        current.unionByName(carried)
        .groupBy(*model, "rebalance_date", "asset")
        .agg(F.sum("change").alias("change"))
        .groupBy(*model, "rebalance_date")
        .agg((0.5 * F.sum(F.abs("change"))).alias("traded"))
    )
    firsts = dates.groupBy(*model).agg(F.min("rebalance_date").alias("first_date"))
    return traded.join(firsts, model).select(
        *model,
        "rebalance_date",
        F.when(F.col("rebalance_date") == F.col("first_date"), F.lit(1.0)).otherwise(F.col("traded")).alias("turnover"),
    )


def strategy_period_results(
    weights: DataFrame, realized: DataFrame, cost_bps: float | list[float] = 5.0
) -> DataFrame:
    """Gross return, turnover, cost and net return per model and period.

    A list of costs adds a ``cost_bps`` column instead of running again per level.
    """
    model = ["universe_id", "model"]
    held = weights.join(
        realized.select("universe_id", "rebalance_date").distinct(), ["universe_id", "rebalance_date"], "left_semi"
    )
    gross = (
        held.join(realized, ["universe_id", "rebalance_date", "asset"])
        .groupBy(*model, "rebalance_date", "period_end")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross_return"))
    )
    joined = gross.join(turnover(held, realized), [*model, "rebalance_date"])
    if isinstance(cost_bps, (list, tuple)):
        levels = F.array(*[F.lit(float(level)) for level in cost_bps])
        joined = joined.withColumn("cost_bps", F.explode(levels))
        extra, rate = ["cost_bps"], F.col("cost_bps")
    else:
        extra, rate = [], F.lit(float(cost_bps))
    cost = F.col("turnover") * rate / 10000.0
    return joined.select(
        *model,
        *extra,
        "rebalance_date",
        "period_end",
        "gross_return",
        "turnover",
        cost.alias("transaction_cost"),
        (F.col("gross_return") - cost).alias("net_return"),
    )


def blend_weight_history(weights: DataFrame, model_a: str, model_b: str, shares: list[float]) -> DataFrame:
    """Blends (1-share) of A and share of B for every share of a grid; dates need both models."""
    both = (
        weights.filter(F.col("model").isin(model_a, model_b))
        .groupBy("universe_id", "rebalance_date", "asset")
        .agg(
            F.max(F.when(F.col("model") == model_a, F.col("weight"))).alias("a"),
            F.max(F.when(F.col("model") == model_b, F.col("weight"))).alias("b"),
        )
        .filter("a is not null and b is not null")
    )
    grid = F.array(*[F.lit(float(s)) for s in shares])
    return both.withColumn("share", F.explode(grid)).select(
        "universe_id",
        F.format_string("blend_%.2f", "share").alias("model"),
        "rebalance_date",
        "asset",
        ((1.0 - F.col("share")) * F.col("a") + F.col("share") * F.col("b")).alias("weight"),
    )


def incomplete_blend_rows(weights: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Rebalance rows that hold only one of the two models; a blend over them is an error."""
    return (
        weights.filter(F.col("model").isin(model_a, model_b))
        .groupBy("universe_id", "rebalance_date", "asset")
        .agg(F.countDistinct("model").alias("models"))
        .filter("models < 2")
    )
