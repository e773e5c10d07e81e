"""Market-shaped tables derived from the provided star-schema tables.

Closes come from integer sums of discount cents, so a close is the same double
whatever the order in which partitions are merged. No join is hinted: at scale
orders, customers and line items all outgrow a broadcast, and adaptive
execution turns the small ones into broadcasts on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _shipments(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_discount")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.to_date("l_shipdate").alias("day"),
            F.round(F.col("l_discount") * 100).cast("long").alias("cents"),
            "c_nationkey",
            F.col("c_mktsegment").alias("asset"),
        )
    )


def _close() -> F.Column:
    return (F.lit(100.0) + F.sum("cents").cast("double") / F.count(F.lit(1))).alias("close")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily closes of five assets in one universe."""
    return (
        _shipments(spark, sf)
        .groupBy(F.lit("ALL").alias("universe_id"), F.col("day").alias("session"), "asset")
        .agg(_close())
    )


def monthly_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly closes of five assets in one universe, dated at the first of the month."""
    month = F.trunc("day", "month").alias("session")
    return _shipments(spark, sf).groupBy(F.lit("ALL").alias("universe_id"), month, "asset").agg(_close())


def nation_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly closes with one universe per nation."""
    month = F.trunc("day", "month").alias("session")
    return (
        _shipments(spark, sf)
        .groupBy(F.concat(F.lit("N"), F.col("c_nationkey")).alias("universe_id"), month, "asset")
        .agg(_close())
    )


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """One portfolio per nation: positive account balances by segment, in whole cents, not yet normalised."""
    balance = F.round(F.greatest("c_acctbal", F.lit(0.0)) * 100).cast("long")
    return (
        read(spark, sf, "customer")
        .groupBy(F.concat(F.lit("P"), F.col("c_nationkey")).alias("portfolio_id"), F.col("c_mktsegment").alias("asset"))
        .agg((F.sum(balance).cast("double") / 100.0).alias("weight"))
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole shares per customer account; the order priority plays the asset."""
    orders = read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.groupBy(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("asset")).agg(
        F.floor(F.sum(cents).cast("double") / 100000.0).cast("long").alias("shares")
    )


def reference_prices(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.groupBy(F.col("o_orderpriority").alias("asset")).agg(
        F.round(F.sum(cents).cast("double") / F.count(F.lit(1)) / 100000.0, 2).alias("price")
    )


def macro_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Daily average event value per event type as a sparse macro series."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        read(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("obs_date"), F.col("event_type").alias("series"))
        .agg((F.sum(cents).cast("double") / F.count(F.lit(1)) / 100.0).alias("value"))
    )


SHIPMENTS_SQL = """
shipments as (
  select cast(l_shipdate as date) as day, cast(round(l_discount * 100) as bigint) as cents,
         c_nationkey, c_mktsegment as asset
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

_CLOSE_SQL = "cast(100 as double) + cast(sum(cents) as double) / count(*) as close"

PRICES_SQL = f"""{SHIPMENTS_SQL},
prices as (
  select 'ALL' as universe_id, day as session, asset, {_CLOSE_SQL} from shipments group by day, asset)"""

MONTHLY_PRICES_SQL = f"""{SHIPMENTS_SQL},
prices as (
  select 'ALL' as universe_id, cast(date_trunc('month', day) as date) as session, asset, {_CLOSE_SQL}
  from shipments group by all)"""

NATION_PRICES_SQL = f"""{SHIPMENTS_SQL},
prices as (
  select 'N' || c_nationkey as universe_id, cast(date_trunc('month', day) as date) as session, asset, {_CLOSE_SQL}
  from shipments group by all)"""

RETURNS_SQL = """
sessions as (
  select universe_id, session, row_number() over (partition by universe_id order by session) as session_no
  from (select distinct universe_id, session from prices)),
asset_returns as (
  select universe_id, session, asset, close, session_no,
         case when session_no - lag(session_no) over w = 1 then close / lag(close) over w - 1 end as ret
  from prices join sessions using (universe_id, session)
  window w as (partition by universe_id, asset order by session)),
returns as (
  select universe_id, session, asset, ret
  from (select *, count(ret) over (partition by universe_id, session) as present,
               (select count(distinct asset) from prices p where p.universe_id = a.universe_id) as n_assets
        from asset_returns a)
  where present = n_assets)"""

WEIGHTS_SQL = """
raw_weights as (
  select 'P' || c_nationkey as portfolio_id, c_mktsegment as asset,
         cast(sum(cast(round(greatest(c_acctbal, 0) * 100) as bigint)) as double) / 100 as weight
  from customer group by all),
weights as (
  select portfolio_id, asset, weight / sum(weight) over (partition by portfolio_id) as weight from raw_weights)"""

POSITIONS_SQL = """
positions as (
  select o_custkey as account_id, o_orderpriority as asset,
         cast(floor(cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100000) as bigint) as shares
  from orders group by all),
reference_prices as (
  select o_orderpriority as asset,
         round(cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100000, 2) as price
  from orders group by all)"""

MACRO_SQL = """
macro_observations as (
  select cast(ts as date) as obs_date, event_type as series,
         cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) / 100 as value
  from events group by all)"""


def two_asset_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly closes of two assets per market segment: urgent orders against the rest.

    Two-asset universes have closed-form allocations to check solvers with.
    """
    lineitem = read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_discount")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.col("c_mktsegment").alias("universe_id"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("session"),
            F.when(F.col("o_orderpriority") < "3", "HIGH").otherwise("LOW").alias("asset"),
            F.round(F.col("l_discount") * 100).cast("long").alias("cents"),
        )
        .groupBy("universe_id", "session", "asset")
        .agg(_close())
    )


def brand_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly closes of every brand in one universe."""
    lineitem = read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_discount")
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .select(
            F.lit("BRANDS").alias("universe_id"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("session"),
            F.upper("p_brand").alias("asset"),
            F.round(F.col("l_discount") * 100).cast("long").alias("cents"),
        )
        .groupBy("universe_id", "session", "asset")
        .agg(_close())
    )


TWO_ASSET_PRICES_SQL = f"""
shipments as (
  select c_mktsegment as universe_id, cast(date_trunc('month', l_shipdate) as date) as session,
         case when o_orderpriority < '3' then 'HIGH' else 'LOW' end as asset,
         cast(round(l_discount * 100) as bigint) as cents
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
prices as (select universe_id, session, asset, {_CLOSE_SQL} from shipments group by all)"""

BRAND_PRICES_SQL = f"""
shipments as (
  select 'BRANDS' as universe_id, cast(date_trunc('month', l_shipdate) as date) as session, upper(p_brand) as asset,
         cast(round(l_discount * 100) as bigint) as cents
  from lineitem join part on l_partkey = p_partkey),
prices as (select universe_id, session, asset, {_CLOSE_SQL} from shipments group by all)"""
