"""Brokerage account payloads: positions, whole-share snapshots and totals.

Account rows hold ``account_id, payload`` with the payload as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCOUNT = (
    "securitiesAccount struct<accountNumber: string, currentBalances: struct<cashBalance: double>, "
    "positions: array<struct<instrument: struct<symbol: string, assetType: string>, longQuantity: double, "
    "shortQuantity: double, marketValue: double, averagePrice: double>>>"
)
# Types that have no daily price, ticker shape, oldest usable price, epoch seconds limit.
UNPRICED_TYPES = ("FIXED_INCOME", "BOND")
TICKER = r"^[A-Za-z][A-Za-z0-9.\-^/]*$"
MAX_PRICE_AGE_DAYS = 7
EPOCH_SECONDS_LIMIT = 100_000_000_000


def positions_of(accounts: DataFrame) -> DataFrame:
    """One row per position entry with cleaned symbol and type; exploding stays inside the row's task."""
    parsed = F.from_json("payload", ACCOUNT)["securitiesAccount"]
    rows = accounts.select("account_id", F.explode(parsed["positions"]).alias("p"))
    return rows.select(
        "account_id",
        F.upper(F.trim("p.instrument.symbol")).alias("symbol"),
        F.upper(F.trim(F.coalesce("p.instrument.assetType", F.lit("")))).alias("asset_type"),
        F.coalesce("p.longQuantity", F.lit(0.0)).alias("long_quantity"),
        F.coalesce("p.shortQuantity", F.lit(0.0)).alias("short_quantity"),
        F.col("p.marketValue").alias("market_value"),
        F.col("p.averagePrice").alias("average_price"),
    )


def normalize_positions(accounts: DataFrame) -> DataFrame:
    """Net quantity and market value per account, symbol and type; entries without either are skipped."""
    value = F.coalesce("market_value", F.lit(0.0))
    net = F.col("long_quantity") - F.col("short_quantity")
    return (
        positions_of(accounts)
        .withColumns({"quantity": net, "market_value": value})
        .filter((F.coalesce("symbol", F.lit("")) != "") & ((F.col("quantity") != 0) | (F.col("market_value") != 0)))
        .groupBy("account_id", "symbol", "asset_type")
        .agg(F.sum("quantity").alias("quantity"), F.sum("market_value").alias("market_value"))
    )


def combine_accounts(positions: DataFrame) -> DataFrame:
    """All accounts together per symbol and type."""
    return positions.groupBy("symbol", "asset_type").agg(
        F.sum("quantity").alias("quantity"), F.sum("market_value").alias("market_value")
    )


def position_problems(accounts: DataFrame) -> DataFrame:
    """Entries a long-only snapshot must refuse, with the reason."""
    value = F.coalesce("market_value", F.col("average_price") * F.col("long_quantity"))
    reason = (
        F.when(F.coalesce("symbol", F.lit("")) == "", "missing symbol")
        .when(F.col("short_quantity") > 0, "short position")
        .when(F.col("long_quantity") < 0, "negative quantity")
        .when(value.isNull(), "missing market value")
        .when(value < 0, "negative market value")
    )
    return positions_of(accounts).withColumn("reason", reason).filter("reason is not null").select("account_id", "symbol", "reason")


def normalize_positions_long_only(accounts: DataFrame, include_cash: bool = True) -> DataFrame:
    """Long positions with a value fallback to average price x quantity, plus a CASH row.

    Accounts with a refused entry or negative cash are left out whole; see
    ``position_problems`` for the entries.
    """
    cash = F.coalesce(F.from_json("payload", ACCOUNT)["securitiesAccount"]["currentBalances"]["cashBalance"], F.lit(0.0))
    header = accounts.select("account_id", cash.alias("cash"))
    refused = position_problems(accounts).select("account_id").union(header.filter("cash < 0").select("account_id")).distinct()
    value = F.coalesce("market_value", F.col("average_price") * F.col("long_quantity"))
    held = (
        positions_of(accounts)
        .groupBy("account_id", "symbol", "asset_type")
        .agg(F.sum("long_quantity").alias("quantity"), F.sum(value).alias("market_value"))
    )
    if include_cash:
        rows = header.filter("cash > 0").select(
            "account_id", F.lit("CASH").alias("symbol"), F.lit("CASH").alias("asset_type"),
            F.col("cash").alias("quantity"), F.col("cash").alias("market_value"),
        )
        held = held.unionByName(rows)
    return held.join(refused, "account_id", "left_anti")


def priceable(positions: DataFrame) -> DataFrame:
    """Weights of the holdings with a daily price and the share of value they cover."""
    text = F.upper(F.trim("symbol"))
    kept = (
        (F.col("market_value") > 0)
        & ~F.upper(F.trim(F.coalesce("asset_type", F.lit("")))).isin(*UNPRICED_TYPES)
        & text.rlike(TICKER)
    )
    totals = positions.groupBy("account_id").agg(
        F.sum("market_value").alias("total_value"), F.sum(F.when(kept, F.col("market_value"))).alias("priced_value")
    )
    return (
        positions.filter(kept)
        .join(totals, "account_id")
        .select(
            "account_id",
            text.alias("symbol"),
            F.try_divide("market_value", "priced_value").alias("weight"),
            F.try_divide("priced_value", "total_value").alias("pricing_coverage"),
        )
    )


def epoch_time(value: Column) -> Column:
    """Epoch seconds or milliseconds to a timestamp; numbers from 1e11 up are milliseconds."""
    return F.when(value.cast("double") >= EPOCH_SECONDS_LIMIT, F.timestamp_millis(value.cast("long"))).otherwise(
        F.timestamp_seconds(value)
    )


def account_snapshot(accounts: DataFrame, quotes: DataFrame, universe: list[str]) -> tuple[DataFrame, DataFrame]:
    """(holdings, account header): whole shares with last prices, cash and the oldest quote time.

    ``quotes`` holds ``symbol, price, quote_time`` (epoch). Every symbol of the
    universe appears for every account, zero when not held.
    """
    cash = F.from_json("payload", ACCOUNT)["securitiesAccount"]["currentBalances"]["cashBalance"]
    names = F.explode(F.array(*[F.lit(s) for s in universe]))
    grid = accounts.select("account_id", names.alias("symbol"))
    held = positions_of(accounts).groupBy("account_id", "symbol").agg(F.sum("long_quantity").alias("shares"))
    last = quotes.filter(F.col("symbol").isin(universe)).select(
        "symbol", "price", epoch_time(F.col("quote_time")).alias("quoted_at")
    )
    holdings = (
        grid.join(held, ["account_id", "symbol"], "left")
        .join(last, "symbol", "left")
        .select("account_id", F.col("symbol").alias("asset"), F.coalesce("shares", F.lit(0.0)).alias("shares"), "price", "quoted_at")
    )
    header = accounts.select("account_id", cash.alias("cash")).join(
        holdings.groupBy("account_id").agg(F.min("quoted_at").alias("price_as_of")), "account_id"
    )
    return holdings, header


def snapshot_problems(accounts: DataFrame, holdings: DataFrame, header: DataFrame, universe: list[str], taken_at: str) -> DataFrame:
    """Reasons an account's snapshot is unusable, one row per (account, reason)."""
    listed = positions_of(accounts).filter("long_quantity <> 0 or short_quantity <> 0")
    taken = F.to_timestamp(F.lit(taken_at))
    age = (F.unix_timestamp(taken) - F.unix_timestamp("price_as_of")) / 86400.0
    parts = [
        listed.filter(~F.col("symbol").isin(universe)).select("account_id", F.lit("unsupported asset").alias("reason")),
        listed.groupBy("account_id", "symbol").count().filter("count > 1").select("account_id", F.lit("duplicate asset").alias("reason")),
        listed.filter("short_quantity > 0").select("account_id", F.lit("short position").alias("reason")),
        holdings.filter("shares <> floor(shares)").select("account_id", F.lit("fractional shares").alias("reason")),
        holdings.filter("price is null or price <= 0").select("account_id", F.lit("missing price").alias("reason")),
        header.filter("cash is null or cash < 0").select("account_id", F.lit("bad cash").alias("reason")),
        header.filter(age > MAX_PRICE_AGE_DAYS).select("account_id", F.lit("stale price").alias("reason")),
        header.filter(age < 0).select("account_id", F.lit("price after snapshot").alias("reason")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def snapshot_totals(holdings: DataFrame, header: DataFrame) -> DataFrame:
    """Holdings value and portfolio value per account."""
    value = holdings.groupBy("account_id").agg(F.sum(F.col("shares") * F.col("price")).alias("holdings_value"))
    return header.join(value, "account_id").withColumn("portfolio_value", F.col("holdings_value") + F.col("cash"))
