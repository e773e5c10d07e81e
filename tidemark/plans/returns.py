"""Queries on prices, returns and period alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import periods, portfolios, returns
from tidemark.plans.catalog import register
from tidemark.plans.common import (
    DAILY_SQL,
    PERIODS_SQL,
    RULE_SQL,
    RULE_WEIGHTS_SQL,
    closes,
    daily,
    r,
    results_sql,
    rounded,
    rule_inputs,
)
from tidemark.plans.market_features import ASSETS
from tidemark.sources import harness

_MATRIX = f"with {DAILY_SQL}"


@register(
    "monthly_return_summary",
    f"""with {harness.MONTHLY_PRICES_SQL}, {harness.RETURNS_SQL}
    select universe_id, asset, count(ret) as observations, {r("product(1 + ret) - 1", 6, "total_return")},
           {r("pow(product(1 + ret), 12.0 / count(ret)) - 1", 6, "annualized_return")},
           {r("stddev_samp(ret) * sqrt(12)", 6, "annualized_volatility")}
    from returns group by universe_id, asset""",
)
def monthly_return_summary(spark, sf):
    rets = returns.return_matrix(harness.monthly_prices(spark, sf))
    summary = returns.return_summary(rets, 12)
    return rounded(summary, 6, "total_return", "annualized_return", "annualized_volatility")


@register(
    "clean_prices",
    f"""with {harness.PRICES_SQL}
    select universe_id, session, asset, {r("close", 8)}, close <= 0 as violation from prices where close is not null""",
)
def clean_prices(spark, sf):
    return rounded(returns.clean_prices(harness.prices(spark, sf)), 8, "close")


@register(
    "daily_returns",
    f"{_MATRIX} select universe_id, session, asset, {r('ret', 8)} from asset_returns",
)
def daily_returns(spark, sf):
    return rounded(returns.daily_returns(harness.prices(spark, sf)), 8, "ret")


@register(
    "log_returns",
    f"{_MATRIX} select universe_id, session, asset, {r('ln(1 + ret)', 8, 'ret')} from asset_returns",
)
def log_returns(spark, sf):
    return rounded(returns.log_returns(harness.prices(spark, sf)), 8, "ret")


@register("complete_rows", f"{_MATRIX} select universe_id, session, asset, {r('ret', 8)} from returns")
def complete_rows(spark, sf):
    return rounded(daily(spark, sf), 8, "ret")


@register(
    "cumulative_returns",
    f"""{_MATRIX}
    select universe_id, session, asset, round(cumulative_return, 8) + 0.0::double as cumulative_return from (
      select *, product(1 + ret) over (partition by universe_id, asset order by session rows unbounded preceding) - 1
               as cumulative_return from returns)""",
)
def cumulative_returns(spark, sf):
    return rounded(returns.cumulative_returns(daily(spark, sf)), 8, "cumulative_return").drop("ret")


@register(
    "return_summary",
    f"""{_MATRIX}
    select universe_id, asset, count(ret) as observations, {r("product(1 + ret) - 1", 6, "total_return")},
           {r("pow(product(1 + ret), 252.0 / count(ret)) - 1", 6, "annualized_return")},
           {r("stddev_samp(ret) * sqrt(252)", 6, "annualized_volatility")}
    from returns group by universe_id, asset""",
)
def return_summary(spark, sf):
    return rounded(
        returns.return_summary(daily(spark, sf)), 6, "total_return", "annualized_return", "annualized_volatility"
    )


@register(
    "nation_return_summary",
    f"""with {harness.NATION_PRICES_SQL}, {harness.RETURNS_SQL}
    select universe_id, asset, count(ret) as observations, {r("product(1 + ret) - 1", 6, "total_return")},
           {r("pow(product(1 + ret), 12.0 / count(ret)) - 1", 6, "annualized_return")},
           {r("stddev_samp(ret) * sqrt(12)", 6, "annualized_volatility")}
    from returns group by universe_id, asset""",
)
def nation_return_summary(spark, sf):
    rets = returns.return_matrix(harness.nation_prices(spark, sf))
    return rounded(
        returns.return_summary(rets, 12), 6, "total_return", "annualized_return", "annualized_volatility"
    )


@register(
    "point_in_time",
    f"""with {harness.PRICES_SQL}
    select asset, count(*) as sessions, max(session) as last_session from prices
    where session <= date '1999-12-31' group by asset""",
)
def point_in_time(spark, sf):
    known = returns.point_in_time(harness.prices(spark, sf), "1999-12-31")
    return known.groupBy("asset").agg(F.count(F.lit(1)).alias("sessions"), F.max("session").alias("last_session"))


@register(
    "month_end_dates",
    f"""{_MATRIX}
    select universe_id, cast(date_trunc('month', session) as date) as month, max(session) as month_end
    from returns group by all""",
)
def month_end_dates(spark, sf):
    return periods.month_end_dates(daily(spark, sf))


_PERIODS = f"""with {DAILY_SQL},
month_ends as (
  select universe_id, date_trunc('month', session) as month, max(session) as month_end from returns group by all),
{PERIODS_SQL}"""


@register(
    "period_returns",
    f"{_PERIODS} select universe_id, rebalance_date, period_end, asset, {r('ret', 8)} from period_returns",
)
def period_returns(spark, sf):
    return rounded(periods.period_returns(daily(spark, sf)), 8, "ret")


@register(
    "drifted_weights",
    f"""with {RULE_SQL}, {results_sql()}
    select universe_id, model, rebalance_date, asset, {r("weight", 8)}, {r("drifted_weight", 8)} from drift""",
)
def drifted_weights(spark, sf):
    weights, realized = rule_inputs(spark, sf)
    drifted = periods.drifted_weights(weights, realized)
    return rounded(drifted, 8, "weight", "drifted_weight").select(
        "universe_id", "model", "rebalance_date", "asset", "weight", "drifted_weight"
    )


@register(
    "turnover",
    f"""with {RULE_SQL}, {results_sql()}
    select universe_id, model, rebalance_date, {r("turnover", 8)} from traded""",
)
def turnover(spark, sf):
    weights, realized = rule_inputs(spark, sf)
    held = weights.join(realized.select("universe_id", "rebalance_date").distinct(), ["universe_id", "rebalance_date"])
    return rounded(periods.turnover(held, realized), 8, "turnover")


_RESULT_COLUMNS = ["gross_return", "turnover", "transaction_cost", "net_return"]


@register(
    "strategy_period_results",
    f"""with {RULE_SQL}, {results_sql()}
    select universe_id, model, rebalance_date, period_end, {", ".join(r(c, 8) for c in _RESULT_COLUMNS)}
    from results""",
)
def strategy_period_results(spark, sf):
    weights, realized = rule_inputs(spark, sf)
    return rounded(periods.strategy_period_results(weights, realized), 8, *_RESULT_COLUMNS)


@register(
    "strategy_cost_grid",
    f"""with {RULE_SQL}, {results_sql()}, costs as (select unnest([0.0, 5.0, 10.0, 25.0])::double as cost_bps)
    select universe_id, model, cost_bps, rebalance_date, period_end, {r("gross_return", 8)}, {r("turnover", 8)},
           {r("turnover * cost_bps / 10000", 8, "transaction_cost")},
           {r("gross_return - turnover * cost_bps / 10000", 8, "net_return")}
    from results, costs""",
)
def strategy_cost_grid(spark, sf):
    weights, realized = rule_inputs(spark, sf)
    grid = periods.strategy_period_results(weights, realized, [0.0, 5.0, 10.0, 25.0])
    return rounded(grid, 8, *_RESULT_COLUMNS)


@register(
    "blend_weight_history",
    f"""with {DAILY_SQL}, {RULE_WEIGHTS_SQL}, shares as (select unnest([0.25, 0.5, 0.75])::double as share)
    select universe_id, printf('blend_%.2f', share) as model, rebalance_date, asset,
           round((1 - share) * equal_weight + share * inverse_variance, 8) + 0.0::double as weight
    from wide_weights, shares""",
)
def blend_weight_history(spark, sf):
    weights, _ = rule_inputs(spark, sf)
    blends = periods.blend_weight_history(weights, "equal_weight", "inverse_variance", [0.25, 0.5, 0.75])
    return rounded(blends, 8, "weight")


@register(
    "lookback_returns",
    f"""with {harness.PRICES_SQL},
    complete as (
      select * from (select *, count(close) over (partition by universe_id, session) as present from prices)
      where present = (select count(distinct asset) from prices)),
    as_of as (
      select universe_id, max(session) as as_of from complete group by universe_id, date_trunc('month', session)),
    rets as (
      select universe_id, session, asset,
             close / lag(close) over (partition by universe_id, asset order by session) - 1 as ret from complete),
    ranked as (
      select a.universe_id, as_of, session, asset, ret,
             row_number() over (partition by a.universe_id, as_of, asset order by session desc) as age
      from rets join as_of a on a.universe_id = rets.universe_id and session <= as_of where ret is not null)
    select universe_id, as_of, session, asset, {r("ret", 8)},
           count(*) over (partition by universe_id, as_of, asset) as observations from ranked where age <= 252""",
)
def lookback_returns(spark, sf):
    """At the last complete session of every month."""
    prices = closes(spark, sf)
    month = F.trunc("session", "month")
    ends = returns.complete_rows(prices, "close").groupBy("universe_id", month).agg(F.max("session").alias("as_of")).select("universe_id", "as_of")
    return rounded(returns.lookback_returns(prices, ends, 252), 8, "ret")


@register(
    "forward_price_returns",
    f"""with {harness.PRICES_SQL},
    complete as (
      select * from (select *, count(close) over (partition by universe_id, session) as present from prices)
      where present = (select count(distinct asset) from prices) and session <= date '2001-06-30'),
    kept as (
      select * from complete
      where session >= (select max(session) from complete where session <= date '2000-12-31')),
    rets as (
      select universe_id, session, asset,
             close / lag(close) over (partition by universe_id, asset order by session) - 1 as ret from kept)
    select universe_id, session, asset, {r("ret", 8)} from rets where session > date '2000-12-31'""",
)
def forward_price_returns(spark, sf):
    return rounded(
        returns.forward_price_returns(closes(spark, sf), "2000-12-31", "2001-06-30"), 8, "ret"
    )


@register(
    "normalize_weights",
    f"with {harness.WEIGHTS_SQL} select portfolio_id, asset, {r('weight', 8)} from weights",
)
def normalize_weights(spark, sf):
    return rounded(portfolios.normalize_weights(harness.weights(spark, sf)), 8, "weight")


@register(
    "portfolio_returns",
    f"""with {DAILY_SQL}, {harness.WEIGHTS_SQL}
    select portfolio_id, universe_id, session, round(sum(weight * ret), 8) + 0.0::double as ret
    from returns join weights using (asset) group by all""",
)
def portfolio_returns(spark, sf):
    weights = portfolios.normalize_weights(harness.weights(spark, sf))
    return rounded(portfolios.portfolio_returns(daily(spark, sf), weights), 8, "ret")


@register(
    "blend_weights",
    f"""with {harness.WEIGHTS_SQL},
    paired as (
      select a.portfolio_id, coalesce(a.asset, b.asset) as asset, coalesce(a.weight, 0) as personal,
             coalesce(b.weight, 0) as optimizer
      from weights a full join (select * from weights where portfolio_id = 'P0') b on a.asset = b.asset),
    alphas as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha),
    mixed as (select portfolio_id, alpha, asset, (1 - alpha) * personal + alpha * optimizer as weight from paired, alphas)
    select portfolio_id, alpha, asset,
           round(weight / sum(weight) over (partition by portfolio_id, alpha), 8) + 0.0::double as weight from mixed""",
)
def blend_weights(spark, sf):
    personal = portfolios.normalize_weights(harness.weights(spark, sf))
    optimizer = personal.filter("portfolio_id = 'P0'").select("asset", "weight")
    slots = personal.select("portfolio_id").distinct().withColumn("asset", F.explode(F.array(*[F.lit(a) for a in ASSETS])))
    every = slots.join(optimizer, "asset").select("portfolio_id", "asset", "weight")
    return rounded(portfolios.blend_weights(personal, every, [0.0, 0.25, 0.5, 0.75, 1.0]), 8, "weight")


@register(
    "month_distance",
    """select o_orderpriority, cast(date_trunc('month', o_orderdate) as date) as month,
              cast((2002 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) as bigint) as months_to_2002,
              month(o_orderdate) in (1, 4, 7, 10) as decision_month, count(*) as n_orders
       from orders group by all""",
)
def month_distance(spark, sf):
    orders = harness.read(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return orders.groupBy(
        "o_orderpriority",
        F.trunc(day, "month").alias("month"),
        dates.month_distance(day, F.to_date(F.lit("2002-01-01"))).cast("long").alias("months_to_2002"),
        dates.is_decision_month(day).alias("decision_month"),
    ).agg(F.count(F.lit(1)).alias("n_orders"))


@register(
    "session_calendar",
    f"""with {harness.PRICES_SQL},
    s as (select distinct universe_id, session from prices),
    n as (select *, lead(session) over (partition by universe_id order by session) as next_session from s)
    select universe_id, cast(date_trunc('month', session) as date) as month, max(session) as last_session,
           arg_max_null(next_session, session) as effective_session
    from n group by 1, 2""",
)
def session_calendar(spark, sf):
    sessions = harness.prices(spark, sf).select("universe_id", "session").distinct()
    return dates.session_calendar(sessions)


@register(
    "signal_date",
    """with d as (select distinct cast(o_orderdate as date) as as_of from orders),
    ends as (
      select as_of, last_day(as_of) as this_end, cast(date_trunc('month', as_of) - interval 1 day as date) as prior_end
      from d),
    business as (
      select as_of,
        cast(case dayofweek(this_end) when 6 then this_end - 1 when 0 then this_end - 2 else this_end end as date) as this_bme,
        cast(case dayofweek(prior_end) when 6 then prior_end - 1 when 0 then prior_end - 2 else prior_end end as date) as prior_bme
      from ends)
    select as_of, case when this_bme <= as_of then this_bme else prior_bme end as signal_date from business""",
)
def signal_date(spark, sf):
    days = harness.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return days.select("as_of", dates.last_completed_month_end(F.col("as_of")).alias("signal_date"))


@register(
    "active_signal",
    """with signals as (
      select o_orderpriority as version, cast(date_trunc('month', o_orderdate) as date) as signal_date, count(*) as state
      from orders where month(o_orderdate) in (1, 4, 7, 10) group by all),
    info as (select distinct o_orderpriority as version, last_day(cast(o_orderdate as date)) as information_date from orders),
    picked as (
      select i.version, i.information_date, max(s.signal_date) as signal_date, max_by(s.state, s.signal_date) as state
      from info i left join signals s on s.version = i.version and s.signal_date <= i.information_date group by all),
    aged as (
      select *, cast((year(information_date) - year(signal_date)) * 12 + month(information_date) - month(signal_date)
                     as integer) as age_months from picked)
    select version, information_date, signal_date, state, age_months,
      case when signal_date is null then 'NO_SIGNAL'
           when signal_date <= date '1995-12-31' then 'IN_SAMPLE'
           when month(information_date) in (1, 4, 7, 10) and age_months <> 0 then 'DECISION_MONTH_WITHOUT_SIGNAL'
           when age_months not between 0 and 2 then 'STALE'
           else 'ACTIVE' end as status
    from aged""",
)
def active_signal(spark, sf):
    orders = harness.read(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    signals = (
        orders.filter(dates.is_decision_month(day))
        .groupBy(F.col("o_orderpriority").alias("version"), F.trunc(day, "month").alias("signal_date"))
        .agg(F.count(F.lit(1)).alias("state"))
    )
    info = orders.select(
        F.col("o_orderpriority").alias("version"), F.last_day(day).alias("information_date")
    ).distinct()
    return dates.active_signal(signals, info, frozen_through="1995-12-31")
