"""Queries on execution targets and rebalance plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import rebalance
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.session import cut_lineage
from tidemark.sources import harness

_COST = 5.0
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Allocation of an account: equal weights over priorities 1-4 of the book, nothing for the fifth;
# a customer with a negative balance allocates to three assets only.
_TARGETS_SQL = f"""
{harness.POSITIONS_SQL},
assets as (select asset, price, row_number() over (order by asset) as rank from reference_prices),
allocation as (
  select c_custkey as account_id, asset, rank, price as close,
         case when rank = 5 then 0.0::double when rank = 4 then 0.00002::double else (1 - 0.00002::double) / 3 end as target_weight
  from customer cross join assets where not (c_acctbal < 0 and rank > 3)),
capital as (select c_custkey as account_id, 100000 + c_custkey * 10 + 0.0::double as portfolio_capital from customer),
joined as (
  select account_id, asset as symbol, a.rank, coalesce(a.target_weight, 0) as w, coalesce(a.close, p.price) as price,
    case when a.close is not null then 'scanner_allocation_close' else 'position_snapshot' end as source, portfolio_capital,
    coalesce(p.shares, 0) as held
  from allocation a full join (select * from positions join reference_prices using (asset)) p using (account_id, asset)
  join capital using (account_id)),
targets as (
  select *, cast(floor(portfolio_capital * w / price) as bigint) as shares from joined),
labelled as (
  select *, case when w <= 1e-15 and held > 0 then 'EXIT' when w <= 1e-15 then 'ZERO_WEIGHT' when shares = 0 then 'ROUNDING_TO_ZERO'
      else 'TARGETED' end as status, case when shares > held then 'BUY' when shares < held then 'SELL' else 'HOLD' end as side
  from targets)"""


def _targets(spark, sf):
    prices = harness.reference_prices(spark, sf)
    rank = F.substring("asset", 1, 1).cast("int")
    weight = F.when(rank == 5, 0.0).when(rank == 4, 0.00002).otherwise((1 - 0.00002) / 3)
    customer = harness.read(spark, sf, "customer")
    accounts = customer.select(F.col("c_custkey").alias("account_id"))
    allocation = (
        customer.select(F.col("c_custkey").alias("account_id"), "c_acctbal")
        .withColumn("asset", F.explode(F.array(*[F.lit(p) for p in PRIORITIES])))
        .join(prices, "asset")
        .filter(~((F.col("c_acctbal") < 0) & (rank > 3)))
        .select("account_id", F.col("asset").alias("symbol"), rank.alias("scanner_rank"), F.col("price").alias("close"), weight.alias("target_weight"))
    )
    positions = harness.positions(spark, sf).join(prices, "asset").select(
        "account_id", F.col("asset").alias("symbol"), F.col("shares").alias("current_position"), F.col("price").alias("reference_price")
    )
    capital = accounts.withColumn("portfolio_capital", (100000 + F.col("account_id") * 10).cast("double"))
    return rebalance.execution_targets(allocation, positions, capital, ["account_id"])


_TARGET = ["reference_price", "target_dollar_value", "target_share_notional", "realized_target_weight", "weight_rounding_error"]


@register(
    "execution_targets",
    f"""with {_TARGETS_SQL}
    select account_id, symbol, cast(rank as integer) as scanner_rank, source as reference_price_source, shares as target_shares,
      held as current_position, shares - held as share_delta, status as target_status, side as trade_side,
      'DRY_RUN' as execution_state, {r("price", 6, "reference_price")}, {r("portfolio_capital * w", 6, "target_dollar_value")},
      {r("shares * price", 6, "target_share_notional")}, {r("shares * price / portfolio_capital", 6, "realized_target_weight")},
      {r("w - shares * price / portfolio_capital", 6, "weight_rounding_error")}
    from labelled""",
)
def execution_targets(spark, sf):
    rows = rounded(_targets(spark, sf).withColumn("symbol", F.col("symbol")), 6, *_TARGET)
    return rows.select(
        "account_id", "symbol", "scanner_rank", "reference_price_source", "target_shares", "current_position", "share_delta",
        "target_status", "trade_side", "execution_state", *_TARGET,
    )


_TOTALS = ["target_notional", "residual_cash", "realized_weight_sum", "total_weight_rounding_error"]


@register(
    "execution_target_totals",
    f"""with {_TARGETS_SQL}
    select account_id, count(*) as row_count,
      {", ".join(f"count(*) filter (status = '{s}') as {s.lower()}_count" for s in ("TARGETED", "ZERO_WEIGHT", "ROUNDING_TO_ZERO", "EXIT"))},
      {", ".join(f"count(*) filter (side = '{s}') as {s.lower()}_count" for s in ("BUY", "SELL", "HOLD"))},
      {r("sum(shares * price)", 6, "target_notional")}, {r("max(portfolio_capital) - sum(shares * price)", 6, "residual_cash")},
      {r("sum(shares * price / portfolio_capital)", 6, "realized_weight_sum")},
      {r("sum(w - shares * price / portfolio_capital)", 6, "total_weight_rounding_error")}
    from labelled group by account_id""",
)
def execution_target_totals(spark, sf):
    return rounded(rebalance.target_totals(_targets(spark, sf), ["account_id"]), 6, *_TOTALS)


# Plans: equal weights over five assets, cash from the customer's balance, five basis points.
_PLAN_SQL = f"""
{harness.POSITIONS_SQL},
cash as (select c_custkey as account_id, greatest(c_acctbal, 0) / 1000 as cash from customer),
grid as (
  select account_id, asset, price, 0.2::double as target_weight, cash, coalesce(shares, 0) as shares
  from cash cross join reference_prices left join positions using (account_id, asset)),
valued as (select *, sum(shares * price) over (partition by account_id) + cash as portfolio_value from grid),
floored as (
  select *, target_weight * portfolio_value as target_dollars, cast(floor(target_weight * portfolio_value / price) as bigint) as first_shares
  from valued where portfolio_value > 0),
need as (
  select *, greatest(first_shares - shares, 0) as buys,
    sum((first_shares - shares) * price + abs(first_shares - shares) * price * 5.0 / 10000) over (partition by account_id) - cash as deficit
  from floored),
freed as (
  select *, coalesce(sum(buys * price * 1.0005) over (partition by account_id order by round(price, 9), asset
                     rows between unbounded preceding and 1 preceding), 0) as freed_before from need),
repaired as (
  select *, case when deficit - freed_before - 1e-8 > 0 and buys > 0
      then least(buys, cast(ceil((deficit - freed_before - 1e-8) / (price * 1.0005)) as bigint)) else 0 end as removed_shares from freed),
traded as (select *, first_shares - removed_shares as target_shares, first_shares - removed_shares - shares as trade_shares from repaired),
costed as (
  select *, sum(abs(trade_shares) * price) over (partition by account_id) as gross_trade_notional,
    sum(trade_shares * price) over (partition by account_id) as net_trade, sum(target_shares * price) over (partition by account_id) as held_value
  from traded),
plan as (
  select *, gross_trade_notional * 5.0 / 10000 as estimated_cost, cash - net_trade - gross_trade_notional * 5.0 / 10000 as cash_after,
    held_value + cash - net_trade - gross_trade_notional * 5.0 / 10000 as ending_value from costed)"""


def _plan(spark, sf):
    prices = harness.reference_prices(spark, sf)
    customer = harness.read(spark, sf, "customer")
    cash = customer.select(F.col("c_custkey").alias("account_id"), (F.greatest("c_acctbal", F.lit(0.0)) / 1000).alias("cash"))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    targets = customer.select(
        F.col("c_custkey").alias("account_id"), F.explode(names).alias("asset"), F.lit(0.2).alias("target_weight")
    )
    return rebalance.rebalance_plan(harness.positions(spark, sf), cash, prices, targets, _COST)


_PLAN = [
    "price", "portfolio_value", "target_dollars", "trade_notional", "estimated_cost", "cash_after", "ending_value",
    "current_weight", "post_trade_weight", "turnover_ratio",
]


@register(
    "rebalance_plan",
    f"""with {_PLAN_SQL}
    select account_id, asset, shares, target_shares, trade_shares, removed_shares,
      case when trade_shares > 0 then 'BUY' when trade_shares < 0 then 'SELL' else 'HOLD' end as side, {r("price", 7)},
      {r("portfolio_value", 7)}, {r("target_dollars", 7)}, {r("abs(trade_shares) * price", 7, "trade_notional")},
      {r("estimated_cost", 7)}, {r("cash_after", 7)}, {r("ending_value", 7)},
      {r("shares * price / portfolio_value", 7, "current_weight")}, {r("target_shares * price / ending_value", 7, "post_trade_weight")},
      {r("gross_trade_notional / portfolio_value", 7, "turnover_ratio")}
    from plan""",
)
def rebalance_plan(spark, sf):
    return rounded(_plan(spark, sf), 7, *_PLAN).select(
        "account_id", "asset", "shares", "target_shares", "trade_shares", "removed_shares", "side", *_PLAN
    )


@register(
    "repair_cash",
    f"""with {_PLAN_SQL}
    select account_id, sum(removed_shares)::bigint as removed, {r("max(deficit)", 4, "deficit")}, {r("max(cash_after)", 4, "cash_after")}
    from plan group by account_id having sum(removed_shares) > 0""",
)
def repair_cash(spark, sf):
    """Accounts that had to give up shares; the deficit is recomputed from the unrepaired targets."""
    plan = _plan(spark, sf).withColumn("first_trade", F.col("trade_shares") + F.col("removed_shares"))
    spent = F.col("first_trade") * F.col("price") + F.abs("first_trade") * F.col("price") * _COST / 10000
    rows = plan.groupBy("account_id").agg(
        F.sum("removed_shares").alias("removed"),
        (F.sum(spent) - F.max("cash")).alias("deficit"),
        F.max("cash_after").alias("cash_after"),
    )
    return rounded(rows.filter("removed > 0"), 4, "deficit", "cash_after")


@register(
    "plan_invariants",
    f"""with {_PLAN_SQL}, f as (
      select count(distinct account_id) as accounts, count(*) filter (abs(portfolio_value - estimated_cost - ending_value) > 1e-6) as broken,
             count(*) filter (cash_after < -1e-6) as negative from plan)
    select accounts, broken, negative from f""",
)
def plan_invariants(spark, sf):
    plan = cut_lineage(_plan(spark, sf))
    accounts = plan.select("account_id").distinct()
    return accounts.join(rebalance.plan_violations(plan), "account_id", "left").agg(
        F.countDistinct("account_id").alias("accounts"),
        F.count_if(F.col("violation") == "VALUE_NOT_CONSERVED").alias("broken"),
        F.count_if(F.col("violation") == "NEGATIVE_CASH").alias("negative"),
    )


_HEADER = {
    "information_date": "2001-10-31", "effective_from": "2001-11-01", "model_version": "v1", "allocation_state": "EQUAL_WEIGHT",
}
_AUDIT = ["portfolio_value_before", "cash_before", "cash_after", "gross_trade_notional", "turnover_ratio", "estimated_transaction_cost"]


@register(
    "plan_audit_summary",
    f"""with {_PLAN_SQL}
    select account_id, '2001-10-31' as information_date, '2001-11-01' as effective_from, 'v1' as model_version,
      'EQUAL_WEIGHT' as allocation_state, 'DRY_RUN' as execution_mode, {r("max(portfolio_value)", 7, "portfolio_value_before")},
      {r("max(cash)", 7, "cash_before")}, {r("max(cash_after)", 7, "cash_after")},
      {r("max(gross_trade_notional)", 7, "gross_trade_notional")},
      {r("max(gross_trade_notional / portfolio_value)", 7, "turnover_ratio")},
      {r("max(estimated_cost)", 7, "estimated_transaction_cost")}, 1::bigint as plans
    from plan group by account_id""",
)
def plan_audit_summary(spark, sf):
    summary, _ = rebalance.plan_tables(_plan(spark, sf), _HEADER)
    per_hash = summary.groupBy("order_plan_hash").agg(F.count(F.lit(1)).alias("plans"))
    return rounded(summary.join(per_hash, "order_plan_hash"), 7, *_AUDIT).drop("order_plan_hash")


@register(
    "plan_audit_detail",
    f"""with {_PLAN_SQL}
    select account_id, asset, 'EQUAL_WEIGHT' as allocation_state, shares, target_shares, trade_shares,
      {r("trade_shares * price", 7, "signed_trade_value")}, {r("target_shares * price", 7, "post_trade_value")} from plan""",
)
def plan_audit_detail(spark, sf):
    _, detail = rebalance.plan_tables(cut_lineage(_plan(spark, sf)), _HEADER)
    return rounded(detail, 7, "signed_trade_value", "post_trade_value").select(
        "account_id", "asset", "allocation_state", "shares", "target_shares", "trade_shares", "signed_trade_value", "post_trade_value"
    )


@register(
    "forward_weight_records",
    f"""with {harness.PRICES_SQL},
    n as (
      select session, lead(session) over (order by session) as next_session from (select distinct session from prices)),
    calendar as (
      select date_trunc('month', session) as month, arg_max_null(next_session, session) as effective_session from n group by 1),
    signals as (
      select o_orderpriority as version, cast(date_trunc('month', o_orderdate) as date) as signal_date,
             case when count(*) % 2 = 0 then 'EQUAL_WEIGHT' else 'MAXIMUM_SHARPE' end as state
      from orders where month(o_orderdate) in (1, 4, 7, 10) group by all),
    info as (select distinct o_orderpriority as version, last_day(cast(o_orderdate as date)) as information_date from orders),
    picked as (
      select i.version, i.information_date, max(s.signal_date) as signal_date, max_by(s.state, s.signal_date) as state
      from info i left join signals s on s.version = i.version and s.signal_date <= i.information_date group by all),
    active as (
      select *, cast((year(information_date) - year(signal_date)) * 12 + month(information_date) - month(signal_date) as integer) as age
      from picked where signal_date > date '1995-12-31'),
    solved as (
      select last_day(session) as information_date, asset, sum(close) as c from prices group by all),
    shares as (select information_date, asset, c / sum(c) over (partition by information_date) as weight from solved)
    select version, information_date, effective_session as effective_from, signal_date, age as age_months,
      state as allocation_state, asset,
      round(case when state = 'EQUAL_WEIGHT' then 0.2 else coalesce(weight, 0) end, 8) + 0.0::double as target_weight
    from active join calendar on month = date_trunc('month', information_date)
    cross join (select distinct asset from prices) left join shares using (information_date, asset)
    where age between 0 and 2 and not (month(information_date) in (1, 4, 7, 10) and age <> 0)""",
)
def forward_weight_records(spark, sf):
    prices = cut_lineage(harness.prices(spark, sf))
    orders = harness.read(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    state = F.when(F.count(F.lit(1)) % 2 == 0, "EQUAL_WEIGHT").otherwise("MAXIMUM_SHARPE")
    signals = (
        orders.filter(dates.is_decision_month(day))
        .groupBy(F.col("o_orderpriority").alias("version"), F.trunc(day, "month").alias("signal_date"))
        .agg(state.alias("state"))
    )
    info = orders.select(F.col("o_orderpriority").alias("version"), F.last_day(day).alias("information_date")).distinct()
    active = dates.active_signal(signals, info, "1995-12-31")
    calendar = dates.session_calendar(prices.select("universe_id", "session").distinct())
    sums = prices.groupBy(F.last_day("session").alias("information_date"), "asset").agg(F.sum("close").alias("c"))
    total = sums.groupBy("information_date").agg(F.sum("c").alias("total"))
    solved = sums.join(total, "information_date").select("information_date", "asset", (F.col("c") / F.col("total")).alias("weight"))
    assets = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return rounded(rebalance.forward_weight_records(active, calendar, solved, assets), 8, "target_weight")
