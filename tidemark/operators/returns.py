"""Prices to returns: cleaning, synchronisation, lookbacks and summaries.

Price tables are long: ``universe_id, session, asset, close``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

SERIES = ["universe_id", "asset"]


def clean_prices(prices: DataFrame, close: str = "close") -> DataFrame:
    """Coerce closes to double and drop the sessions of a universe with no usable close at all.

    Non-positive closes are an error in the data, not a gap: they stay in the
    output flagged by ``violation`` so that a caller can count and refuse them.
    """
    number = F.expr(f"try_cast({close} as double)")
    coerced = prices.withColumn("close", F.when(~F.isnan(number), number))
    usable = F.count("close").over(Window.partitionBy("universe_id", "session"))
    return (
        coerced.withColumn("usable", usable)
        .filter("usable > 0")
        .drop("usable")
        .withColumn("violation", F.coalesce(F.col("close") <= 0, F.lit(False)))
    )


def numbered_sessions(prices: DataFrame) -> DataFrame:
    """Consecutive numbers for the sessions of each universe."""
    return (
        prices.select("universe_id", "session")
        .distinct()
        .withColumn("session_no", F.row_number().over(Window.partitionBy("universe_id").orderBy("session")))
    )


def _with_change(prices: DataFrame, change: Column) -> DataFrame:
    """Add ``ret``, NULL where the asset has no close on the universe's previous session."""
    series = Window.partitionBy(*SERIES).orderBy("session")
    adjacent = F.col("session_no") - F.lag("session_no").over(series) == 1
    return (
        prices.join(numbered_sessions(prices), ["universe_id", "session"])
        .withColumn("previous_close", F.lag("close").over(series))
        .withColumn("ret", F.when(adjacent, change))
    )


def daily_returns(prices: DataFrame) -> DataFrame:
    """Simple returns with no filling across gaps."""
    change = F.try_divide("close", "previous_close") - 1.0
    return _with_change(prices, change).select("universe_id", "session", "asset", "ret")


def log_returns(prices: DataFrame) -> DataFrame:
    change = F.log(F.try_divide("close", "previous_close"))
    return _with_change(prices, change).select("universe_id", "session", "asset", "ret")


def complete_rows(table: DataFrame, value: str) -> DataFrame:
    """Keep the sessions on which every asset of the universe has a value.

    The window holds one session of one universe, so it is as large as the
    universe has assets.
    """
    n_assets = table.groupBy("universe_id").agg(F.countDistinct("asset").alias("n_assets"))
    present = F.count(value).over(Window.partitionBy("universe_id", "session"))
    return (
        table.withColumn("present", present)
        .join(n_assets, "universe_id")
        .filter("present = n_assets")
        .drop("present", "n_assets")
    )


def return_matrix(prices: DataFrame) -> DataFrame:
    """Synchronised returns in long form."""
    return complete_rows(daily_returns(prices), "ret")


def cumulative_returns(returns: DataFrame) -> DataFrame:
    path = F.product(1.0 + F.col("ret")).over(stats.running(SERIES, "session")) - 1.0
    return returns.withColumn("cumulative_return", path)


def return_summary(returns: DataFrame, periods: int = stats.TRADING_DAYS) -> DataFrame:
    """Total return, annualised return and volatility per asset."""
    grown = stats.growth("ret")
    return returns.groupBy(*SERIES).agg(
        F.count("ret").alias("observations"),
        stats.total_return("ret").alias("total_return"),
        (F.pow(grown, F.lit(float(periods)) / F.count("ret")) - 1.0).alias("annualized_return"),
        stats.annualized_volatility("ret", periods).alias("annualized_volatility"),
    )


def point_in_time(table: DataFrame, as_of: str | Column, date: str = "session") -> DataFrame:
    """Rows known on a date; a literal reaches the scan as a pushed filter."""
    limit = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return table.filter(F.col(date) <= limit)


def lookback_returns(prices: DataFrame, as_of: DataFrame, length: int) -> DataFrame:
    """The last ``length`` synchronised returns on or before each ``as_of`` of a universe.

    ``as_of`` holds ``universe_id, as_of``. The result carries ``observations``
    per (universe, as_of); a value below ``length`` means too little history.
    """
    complete = complete_rows(prices, "close")
    sessions = numbered_sessions(complete)
    # The last session on or before each date, carried forward over both lists in order.
    none = F.lit(None)
    line = sessions.select("universe_id", F.col("session").alias("at"), "session_no", none.cast("date").alias("as_of")).unionByName(
        as_of.select("universe_id", F.to_date("as_of").alias("at"), none.cast("int").alias("session_no"), F.to_date("as_of").alias("as_of")).distinct()
    )
    upto = Window.partitionBy("universe_id").orderBy("at", F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = line.withColumn("last_no", F.last("session_no", ignorenulls=True).over(upto)).filter("as_of is not null and last_no is not null").select("universe_id", "as_of", "last_no")
    numbered = complete.join(sessions, ["universe_id", "session"])
    previous = F.lag("close").over(Window.partitionBy(*SERIES).orderBy("session"))
    rets = numbered.withColumn("ret", F.try_divide(F.col("close"), previous) - 1.0).filter("ret is not null")
    # A lookback touches two blocks of session numbers, so it meets those and not all history.
    block = F.floor((F.col("session_no") - 1) / length)
    own = F.floor((F.col("last_no") - 1) / length)
    asked = last.withColumn("block", F.explode(F.array(own, own - 1)))
    picked = rets.withColumn("block", block).join(asked, ["universe_id", "block"]).filter(
        (F.col("session_no") <= F.col("last_no")) & (F.col("session_no") > F.col("last_no") - length)
    )
    seen = F.count(F.lit(1)).over(Window.partitionBy("universe_id", "as_of", "asset"))
    return picked.select("universe_id", "as_of", "session", "asset", "ret", seen.alias("observations"))


def duplicate_sessions(prices: DataFrame) -> DataFrame:
    """Series keys that hold more than one close for a session."""
    return prices.groupBy(*SERIES, "session").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def forward_price_returns(prices: DataFrame, freeze: str, evaluation: str) -> DataFrame:
    """Returns strictly after ``freeze`` up to ``evaluation``; the base is the last complete session on or before it."""
    complete = complete_rows(prices.filter(F.col("close").isNotNull()), "close")
    upto = complete.filter(F.col("session") <= F.to_date(F.lit(evaluation)))
    frozen = F.to_date(F.lit(freeze))
    base = (
        upto.filter(F.col("session") <= frozen)
        .groupBy(*SERIES)
        .agg(F.max("session").alias("session"), F.max_by("close", "session").alias("close"))
    )
    later = upto.filter(F.col("session") > frozen).select(*SERIES, "session", "close")
    previous = F.lag("close").over(Window.partitionBy(*SERIES).orderBy("session"))
    return (
        base.unionByName(later)
        .withColumn("ret", F.try_divide(F.col("close"), previous) - 1.0)
        .filter(F.col("session") > frozen)
        .select("universe_id", "session", "asset", "ret")
    )
