"""Aggregate expressions for periodic return series.

Two conventions live side by side and must not be mixed:

* *period* metrics (monthly by default): undefined ratios are NULL and the
  drawdown path starts from a wealth of 1.0;
* *research* metrics (252 sessions): a flat series scores 0, ruin scores -1 and
  the drawdown path starts at the first observed wealth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252
MONTHS = 12
QUARTERS = 4


def growth(ret: str) -> Column:
    return F.product(1.0 + F.col(ret))


def total_return(ret: str) -> Column:
    return growth(ret) - 1.0


def annualized_return(ret: str, periods: int = MONTHS) -> Column:
    return F.when(growth(ret) > 0, F.pow(growth(ret), F.lit(float(periods)) / F.count(ret)) - 1.0)


def annualized_volatility(ret: str, periods: int = MONTHS) -> Column:
    return F.stddev_samp(ret) * math.sqrt(periods)


def periodic_rate(annual: float, periods: int) -> float:
    return (1.0 + annual) ** (1.0 / periods) - 1.0


def sharpe(ret: str, risk_free: float = 0.0, periods: int = MONTHS) -> Column:
    excess_mean = F.avg(F.col(ret) - F.lit(periodic_rate(risk_free, periods)))
    spread = F.stddev_samp(ret)
    return F.when(spread > 0, excess_mean / spread * math.sqrt(periods))


def sortino(ret: str, risk_free: float = 0.0, periods: int = MONTHS) -> Column:
    excess = F.col(ret) - F.lit(periodic_rate(risk_free, periods))
    downside = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2.0))) * math.sqrt(periods)
    return F.when(downside > 0, F.avg(excess) * float(periods) / downside)


def research_annualized_return(ret: str) -> Column:
    return F.when(growth(ret) <= 0, F.lit(-1.0)).otherwise(
        F.pow(growth(ret), F.lit(float(TRADING_DAYS)) / F.count(ret)) - 1.0
    )


def research_sharpe(ret: str, risk_free: float = 0.0) -> Column:
    vol = annualized_volatility(ret, TRADING_DAYS)
    return F.when(vol <= 0, F.lit(0.0)).otherwise((F.avg(ret) * float(TRADING_DAYS) - risk_free) / vol)


def research_sortino(ret: str, risk_free: float = 0.0) -> Column:
    excess = F.col(ret) - F.lit(risk_free / TRADING_DAYS)
    downside = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2.0))) * math.sqrt(TRADING_DAYS)
    return F.when(downside <= 0, F.lit(0.0)).otherwise(F.avg(excess) * float(TRADING_DAYS) / downside)


def running(keys: list[str], order: str | list[str]) -> WindowSpec:
    """Everything up to the current row of one series.

    A series holds one row per session or period, so its length is bounded by
    the calendar whatever the size of the input tables.
    """
    cols = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)


def trailing(keys: list[str], order: str, rows: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)


def drawdown_path(df, keys: list[str], order: str, ret: str, start_at_one: bool = True):
    """Add ``wealth`` and ``drawdown`` for each series."""
    span = running(keys, order)
    with_wealth = df.withColumn("wealth", F.product(1.0 + F.col(ret)).over(span))
    peak = F.max("wealth").over(span)
    if start_at_one:
        peak = F.greatest(peak, F.lit(1.0))
    return with_wealth.withColumn("drawdown", F.try_divide(F.col("wealth"), peak) - 1.0)
