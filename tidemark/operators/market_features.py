"""Trailing market features of synchronised returns and the regime feature matrix."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import covariance, sliding

SERIES = ["universe_id", "asset"]
RETURN_WINDOWS = (21, 63, 126)
VOLATILITY_WINDOWS = (21, 63)
DRAWDOWN_WINDOW = 126
#: Products over no more rows than this are folded in the order of the rows; longer ones are block scans like all other windows.
FOLDED = 126
CORRELATION_WINDOW = 63

# Names of the pair features and the roles they compare.
CORRELATION_PAIRS = {
    "equity_bond_corr": ("equity", "bond"),
    "equity_gold_corr": ("equity", "gold"),
    "growth_bond_corr": ("growth", "bond"),
    "growth_dividend_corr": ("growth", "dividend"),
}
MOMENTUM_SPREADS = {
    "equity_bond_momentum_spread": ("equity", "bond"),
    "growth_dividend_momentum_spread": ("growth", "dividend"),
    "gold_bond_momentum_spread": ("gold", "bond"),
}


def trailing_features(
    returns: DataFrame, return_windows=RETURN_WINDOWS, volatility_windows=VOLATILITY_WINDOWS, drawdown_windows=(DRAWDOWN_WINDOW,)
) -> DataFrame:
    """Compounded return, annualised volatility and in-window drawdown per asset and session.

    A value is NULL until its window is full. The drawdown compares running
    wealth with its maximum inside the window only, so it needs no per-window
    product: L_t / max(L over the window). Windows are block scans (see ``sliding``).
    """
    span = stats.running(SERIES, "session")
    path = returns.withColumns(
        {"__growth": 1.0 + F.col("ret"), "__wealth": F.product(1.0 + F.col("ret")).over(span), "history": F.count("ret").over(span)}
    )
    folded = {f"return_{n}d": F.product("__growth").over(stats.trailing(SERIES, "session", n)) for n in return_windows if n <= FOLDED}
    wanted = {f"return_{n}d": (sliding.PRODUCT, "__growth", n) for n in return_windows if n > FOLDED}
    wanted |= {f"vol_{n}d": (sliding.MOMENTS, "ret", n) for n in volatility_windows}
    wanted |= {f"drawdown_{n}d": (sliding.MAXIMUM, "__wealth", n) for n in drawdown_windows}

    def full(length: int, value):
        return F.when(F.col("history") >= length, value)

    out = {f"return_{n}d": full(n, F.col(f"return_{n}d") - 1.0) for n in return_windows}
    out |= {f"vol_{n}d": full(n, F.col(f"vol_{n}d") * math.sqrt(stats.TRADING_DAYS)) for n in volatility_windows}
    out |= {f"drawdown_{n}d": full(n, F.try_divide(F.col("__wealth"), F.col(f"drawdown_{n}d")) - 1.0) for n in drawdown_windows}
    columns = ["universe_id", "session", "asset", "history", *out]
    return sliding.trailing(path.withColumns(folded), SERIES, "session", wanted).withColumns(out).select(*columns)


def regime_features(
    returns: DataFrame, dates: DataFrame, assets: list[str], roles: dict[str, str],
    return_windows=RETURN_WINDOWS, volatility_windows=VOLATILITY_WINDOWS,
    drawdown_window: int = DRAWDOWN_WINDOW, correlation_window: int = CORRELATION_WINDOW,
) -> DataFrame:
    """One wide row per (universe, rebalance date); dates without enough history are skipped.

    All dates come out of one window pass. ``assets`` names the columns, so the
    pivot needs no extra job, and ``roles`` maps equity/bond/gold/growth/dividend
    to assets; pair features whose roles are absent are left out.
    """
    needed = max(*return_windows, *volatility_windows, drawdown_window, correlation_window)
    marks = dates.select("universe_id", F.col("rebalance_date").alias("session"))
    per_asset = (
        trailing_features(returns, return_windows, volatility_windows, (drawdown_window,))
        .join(marks, ["universe_id", "session"])
        .filter(F.col("history") >= needed)
    )
    cells = [
        *[f"return_{n}d" for n in return_windows],
        *[f"vol_{n}d" for n in volatility_windows],
        f"drawdown_{drawdown_window}d",
    ]
    aggregates = [
        F.max(F.when(F.col("asset") == asset, F.col(cell))).alias(f"{asset}_{cell}") for cell in cells for asset in assets
    ]
    aggregates += [F.stddev_pop(f"return_{n}d").alias(f"cross_asset_return_dispersion_{n}d") for n in return_windows]
    aggregates += [F.stddev_pop(f"vol_{n}d").alias(f"cross_asset_vol_dispersion_{n}d") for n in volatility_windows]
    wide = per_asset.groupBy("universe_id", "session").agg(*aggregates)

    correlations = covariance.average_trailing_correlation(returns, marks, correlation_window).withColumnRenamed(
        "average_corr", f"average_pairwise_corr_{correlation_window}d"
    )
    named, involved = [], set()
    for name, (a, b) in CORRELATION_PAIRS.items():
        if roles.get(a) in assets and roles.get(b) in assets:
            low, high = sorted((roles[a], roles[b]))
            hit = (F.col("asset_i") == low) & (F.col("asset_j") == high)
            named.append(F.max(F.when(hit, F.col("corr"))).alias(f"{name}_{correlation_window}d"))
            involved |= {low, high}
    if named:
        # Pairs are formed of the named assets only, at the marked dates only.
        pairs = covariance.trailing_pair_correlation(returns.filter(F.col("asset").isin(sorted(involved))), correlation_window, marks)
        kept = pairs.groupBy("universe_id", "session").agg(*named)
        correlations = correlations.join(kept, ["universe_id", "session"], "left")

    spreads = {}
    if CORRELATION_WINDOW in return_windows:
        for name, (a, b) in MOMENTUM_SPREADS.items():
            if roles.get(a) in assets and roles.get(b) in assets:
                cell = f"return_{CORRELATION_WINDOW}d"
                spreads[f"{name}_{CORRELATION_WINDOW}d"] = F.col(f"{roles[a]}_{cell}") - F.col(f"{roles[b]}_{cell}")
    return (
        wide.join(correlations, ["universe_id", "session"])
        .withColumns(spreads)
        .withColumnRenamed("session", "rebalance_date")
    )


def feature_describe(features: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, spread, range and missing count per feature column."""
    return (
        features.unpivot(keys, columns, "feature", "value")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def class_balance(labels: DataFrame, column: str = "best_model") -> DataFrame:
    """Rows and share per class value."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    every = labels.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.try_divide(F.col("rows"), every))
