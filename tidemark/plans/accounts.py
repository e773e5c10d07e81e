"""Queries on account payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.session import cut_lineage
from tidemark.sources import accounts, harness, harness_payloads

UNIVERSE = ["HIGH", "LOW", "MEDIUM", "URGENT"]

_POSITIONS_SQL = """
base as (
  select o_custkey as account_id, substr(o_orderpriority, 3) as symbol,
         cast(floor(sum(cast(round(o_totalprice * 100) as bigint)) / 100000.0) as double) as units, count(*) as n
  from orders group by all),
entries as (
  select account_id, symbol, case when symbol = 'LOW' then 'BOND' else 'EQUITY' end as asset_type, units as long_quantity,
         case when n > 5 and symbol = 'HIGH' then 3.0::double else 0.0::double end as short_quantity,
         case when n % 4 <> 0 then units * 2.5 end as market_value, 2.0::double as average_price
  from base join customer on c_custkey = account_id),
net as (
  select account_id, symbol, asset_type, long_quantity - short_quantity as quantity, coalesce(market_value, 0) as market_value
  from entries where long_quantity - short_quantity <> 0 or coalesce(market_value, 0) <> 0)"""


@register(
    "normalize_positions",
    f"""with {_POSITIONS_SQL} select account_id, symbol, asset_type, {r("quantity", 4)}, {r("market_value", 4)} from net""",
)
def normalize_positions(spark, sf):
    return rounded(accounts.normalize_positions(harness_payloads.accounts(spark, sf)), 4, "quantity", "market_value")


@register(
    "combine_accounts",
    f"""with {_POSITIONS_SQL}
    select symbol, asset_type, {r("sum(quantity)", 4, "quantity")}, {r("sum(market_value)", 4, "market_value")}
    from net group by symbol, asset_type""",
)
def combine_accounts(spark, sf):
    rows = accounts.combine_accounts(accounts.normalize_positions(harness_payloads.accounts(spark, sf)))
    return rounded(rows, 4, "quantity", "market_value")


_LONG_SQL = f"""{_POSITIONS_SQL},
refused as (
  select account_id from entries where short_quantity > 0
  union select c_custkey from customer where c_acctbal < 0),
held as (
  select account_id, symbol, asset_type, long_quantity as quantity,
         coalesce(market_value, average_price * long_quantity) as market_value from entries
  union all
  select c_custkey, 'CASH', 'CASH', c_acctbal, c_acctbal from customer where c_acctbal > 0),
long_only as (select * from held where account_id not in (select account_id from refused))"""


@register(
    "normalize_positions_long_only",
    f"""with {_LONG_SQL} select account_id, symbol, asset_type, {r("quantity", 4)}, {r("market_value", 4)} from long_only""",
)
def normalize_positions_long_only(spark, sf):
    rows = accounts.normalize_positions_long_only(cut_lineage(harness_payloads.accounts(spark, sf)))
    return rounded(rows, 4, "quantity", "market_value")


@register(
    "priceable_filter",
    f"""with {_LONG_SQL},
    flagged as (
      select *, market_value > 0 and asset_type not in ('FIXED_INCOME', 'BOND')
                and regexp_full_match(symbol, '[A-Za-z][A-Za-z0-9.\\-^/]*') as kept from long_only),
    t as (
      select account_id, sum(market_value) as total, sum(case when kept then market_value end) as priced
      from flagged group by account_id)
    select account_id, symbol, {r("market_value / priced", 8, "weight")}, {r("priced / total", 8, "pricing_coverage")}
    from flagged join t using (account_id) where kept""",
)
def priceable_filter(spark, sf):
    rows = accounts.normalize_positions_long_only(cut_lineage(harness_payloads.accounts(spark, sf)))
    return rounded(accounts.priceable(cut_lineage(rows)), 8, "weight", "pricing_coverage")


def _quotes(spark, sf):
    """Last price per priority; quote times in seconds for one and milliseconds for the others."""
    orders = harness.read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    seconds = F.unix_timestamp(F.max("o_orderdate"))
    symbol = F.substring("o_orderpriority", 3, 20)
    return orders.groupBy(symbol.alias("symbol")).agg(
        F.round(F.sum(cents).cast("double") / F.count(F.lit(1)) / 100000.0, 2).alias("price"),
        F.when(F.max(symbol) == "LOW", seconds).otherwise(seconds * 1000).alias("quote_time"),
    )


_SNAPSHOT_SQL = f"""{_POSITIONS_SQL},
quoted as (
  select substr(o_orderpriority, 3) as symbol, max(o_orderdate) as quoted_at,
         round(cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100000, 2) as price
  from orders group by all),
holdings as (
  select c_custkey as account_id, u.asset, coalesce(e.long_quantity, 0) as shares, q.price, q.quoted_at, c_acctbal as cash
  from customer cross join (select unnest({UNIVERSE!r}) as asset) u
  left join entries e on e.account_id = c_custkey and e.symbol = u.asset left join quoted q on q.symbol = u.asset)"""


@register(
    "account_snapshot",
    f"""with {_SNAPSHOT_SQL}
    select account_id, asset, shares, {r("price", 4)}, cash, min(quoted_at) over (partition by account_id) as price_as_of
    from holdings""",
)
def account_snapshot(spark, sf):
    holdings, header = accounts.account_snapshot(harness_payloads.accounts(spark, sf), _quotes(spark, sf), UNIVERSE)
    rows = holdings.join(header, "account_id").withColumn("price_as_of", F.col("price_as_of").cast("timestamp_ntz"))
    return rounded(rows, 4, "price").drop("quoted_at")


@register(
    "snapshot_totals",
    f"""with {_SNAPSHOT_SQL}
    select account_id, any_value(cash) as cash, {r("sum(shares * price)", 4, "holdings_value")},
           {r("sum(shares * price) + any_value(cash)", 4, "portfolio_value")}
    from holdings group by account_id""",
)
def snapshot_totals(spark, sf):
    holdings, header = accounts.account_snapshot(harness_payloads.accounts(spark, sf), _quotes(spark, sf), UNIVERSE)
    return rounded(accounts.snapshot_totals(holdings, header), 4, "holdings_value", "portfolio_value").drop("price_as_of")


@register(
    "snapshot_problems",
    f"""with {_SNAPSHOT_SQL}
    select distinct account_id, 'unsupported asset' as reason from entries
    where symbol = 'NOT SPECIFIED' and (long_quantity <> 0 or short_quantity <> 0)
    union select account_id, 'short position' from entries where short_quantity > 0
    union select account_id, 'bad cash' from holdings where cash < 0
    union select account_id, 'stale price' from holdings group by account_id
          having epoch(timestamp '2001-08-10') - epoch(min(quoted_at)) > 7 * 86400""",
)
def snapshot_problems(spark, sf):
    rows = cut_lineage(harness_payloads.accounts(spark, sf))
    holdings, header = accounts.account_snapshot(rows, _quotes(spark, sf), UNIVERSE)
    return accounts.snapshot_problems(rows, cut_lineage(holdings), cut_lineage(header), UNIVERSE, "2001-08-10 00:00:00")
