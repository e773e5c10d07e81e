"""Performance summaries of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats


def series_summary(
    df: DataFrame, keys: list[str], order: str, ret: str, periods: int = stats.MONTHS, risk_free: float = 0.0,
    extra: list | None = None,
) -> DataFrame:
    """Total and annualised return, volatility, Sharpe, Sortino and drawdown per series."""
    path = stats.drawdown_path(df.filter(F.col(ret).isNotNull()), keys, order, ret)
    return path.groupBy(*keys).agg(
        F.count(ret).alias("periods"),
        stats.total_return(ret).alias("total_return"),
        stats.annualized_return(ret, periods).alias("annualized_return"),
        stats.annualized_volatility(ret, periods).alias("annualized_volatility"),
        stats.sharpe(ret, risk_free, periods).alias("sharpe"),
        stats.sortino(ret, risk_free, periods).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        *(extra or []),
    )


def backtest_summary(
    results: DataFrame, keys: list[str] | None = None, periods: int = stats.MONTHS, risk_free: float = 0.0
) -> DataFrame:
    """Summary per model of net period results, with mean turnover and the rank by Sharpe."""
    keys = keys or ["universe_id", "model"]
    return series_summary(
        results, keys, "period_end", "net_return", periods, risk_free, [F.avg("turnover").alias("average_turnover")]
    )


def research_summary(df: DataFrame, keys: list[str], order: str, ret: str, risk_free: float = 0.0) -> DataFrame:
    """The 252-session variants: flat series score 0 and the path starts at the first wealth."""
    path = stats.drawdown_path(df, keys, order, ret, start_at_one=False)
    return path.groupBy(*keys).agg(
        F.count(ret).alias("sessions"),
        stats.research_annualized_return(ret).alias("annualized_return"),
        stats.annualized_volatility(ret, stats.TRADING_DAYS).alias("annualized_volatility"),
        stats.research_sharpe(ret, risk_free).alias("sharpe"),
        stats.research_sortino(ret, risk_free).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )


def worst_rolling_return(df: DataFrame, keys: list[str], order: str, ret: str, windows=(20, 60)) -> DataFrame:
    """Lowest compounded return over full windows of each length."""
    rolled = df
    for length in windows:
        span = stats.trailing(keys, order, length)
        value = F.when(F.count(ret).over(span) == length, F.product(1.0 + F.col(ret)).over(span) - 1.0)
        rolled = rolled.withColumn(f"rolling_{length}", value)
    return rolled.groupBy(*keys).agg(
        *[F.min(f"rolling_{length}").alias(f"worst_rolling_{length}d_return") for length in windows]
    )
