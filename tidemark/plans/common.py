"""Shared pieces of the registered queries: rounding, rule-based models and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import periods, returns
from tidemark.session import cut_lineage
from tidemark.sources import harness

MIN_HISTORY = 126


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round to a grid both engines agree on; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def rounded_small(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """``rounded`` for values that stay whole numbers of a double on the grid, by the steps that SQL's engine takes; no decimal is made of each."""
    grid = F.lit(10.0**digits)
    return df.withColumns({c: F.signum(c) * (F.floor(F.abs(c) * grid + 0.5) / grid) + F.lit(0.0) for c in columns})


def r(column: str, digits: int, alias: str | None = None) -> str:
    """The same rounding as SQL text."""
    return f"round({column}, {digits}) + 0.0::double as {alias or column}"


def closes(spark: SparkSession, sf: str) -> DataFrame:
    """Daily closes, aggregated from the raw rows once however many branches read them."""
    return cut_lineage(harness.prices(spark, sf))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return returns.return_matrix(closes(spark, sf))


def rule_weights(prices: DataFrame, rets: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Month-end weights of four rule-based models that need no solver.

    equal_weight, price_weight (close over the sum of closes), inverse_variance
    (expanding sample variance) and low_risk (all in the least volatile asset).
    """
    series = Window.partitionBy("universe_id", "asset").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    moments = rets.withColumns(
        {"variance": F.var_samp("ret").over(series), "seen": F.count("ret").over(series)}
    )
    ends = periods.month_end_dates(rets).select("universe_id", F.col("month_end").alias("session"))
    at_end = (
        moments.join(ends, ["universe_id", "session"])
        .filter(F.col("seen") >= min_history)
        .join(prices, ["universe_id", "session", "asset"])
    )
    group = Window.partitionBy("universe_id", "session")
    first = F.row_number().over(group.orderBy("variance", "asset")) == 1
    wide = at_end.select(
        "universe_id",
        F.col("session").alias("rebalance_date"),
        "asset",
        (1.0 / F.count(F.lit(1)).over(group)).alias("equal_weight"),
        (F.col("close") / F.sum("close").over(group)).alias("price_weight"),
        F.try_divide(F.try_divide(F.lit(1.0), F.col("variance")), F.sum(F.try_divide(F.lit(1.0), F.col("variance"))).over(group)).alias("inverse_variance"),
        F.when(first, F.lit(1.0)).otherwise(F.lit(0.0)).alias("low_risk"),
    )
    return wide.unpivot(
        ["universe_id", "rebalance_date", "asset"],
        ["equal_weight", "price_weight", "inverse_variance", "low_risk"],
        "model",
        "weight",
    )


def rule_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily returns, weights, period returns) of the rule-based models on the daily universe."""
    prices = closes(spark, sf)
    rets = cut_lineage(returns.return_matrix(prices))
    return rets, cut_lineage(rule_weights(prices, rets)), cut_lineage(periods.period_returns(rets))


def rule_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return rule_tables(spark, sf)[1:]


def rule_results(spark: SparkSession, sf: str, cost_bps=5.0) -> DataFrame:
    weights, realized = rule_inputs(spark, sf)
    return periods.strategy_period_results(weights, realized, cost_bps)


DAILY_SQL = f"{harness.PRICES_SQL}, {harness.RETURNS_SQL}"

RULE_WEIGHTS_SQL = f"""
moments as (
  select universe_id, session, asset, ret, var_samp(ret) over w as variance, count(ret) over w as seen
  from returns window w as (partition by universe_id, asset order by session rows unbounded preceding)),
month_ends as (
  select universe_id, date_trunc('month', session) as month, max(session) as month_end from returns group by all),
at_end as (
  select m.universe_id, m.session as rebalance_date, m.asset, variance, close
  from moments m join month_ends e on e.universe_id = m.universe_id and e.month_end = m.session
       join prices p on p.universe_id = m.universe_id and p.session = m.session and p.asset = m.asset
  where seen >= {MIN_HISTORY}),
wide_weights as (
  select universe_id, rebalance_date, asset,
         1.0::double / count(*) over g as equal_weight, close / sum(close) over g as price_weight,
         (1 / variance) / sum(1 / variance) over g as inverse_variance,
         case when row_number() over (partition by universe_id, rebalance_date order by variance, asset) = 1
              then 1.0::double else 0.0::double end as low_risk
  from at_end window g as (partition by universe_id, rebalance_date)),
model_weights as (
  select universe_id, rebalance_date, asset, 'equal_weight' as model, equal_weight as weight from wide_weights
  union all select universe_id, rebalance_date, asset, 'price_weight', price_weight from wide_weights
  union all select universe_id, rebalance_date, asset, 'inverse_variance', inverse_variance from wide_weights
  union all select universe_id, rebalance_date, asset, 'low_risk', low_risk from wide_weights)"""

PERIODS_SQL = """
period_map as (
  select * from (
    select universe_id, month, month_end as period_end,
           lag(month_end) over (partition by universe_id order by month) as rebalance_date from month_ends)
  where rebalance_date is not null),
period_returns as (
  select r.universe_id, rebalance_date, period_end, asset, product(1 + ret) - 1 as ret
  from returns r join period_map p
    on p.universe_id = r.universe_id and p.month = date_trunc('month', r.session)
  group by all)"""


def results_sql(weights: str = "model_weights", cost: str = "5.0") -> str:
    """SQL of the period results of a weight history; ``cost`` may name a column of a grid."""
    return f"""
held as (
  select w.universe_id, w.model, w.rebalance_date, w.asset, w.weight, p.period_end, p.ret
  from {weights} w join period_returns p using (universe_id, rebalance_date, asset)),
drift as (
  select *, weight * (1 + ret) / sum(weight * (1 + ret)) over (partition by universe_id, model, rebalance_date)
           as drifted_weight from held),
model_dates as (
  select universe_id, model, rebalance_date,
         lag(rebalance_date) over (partition by universe_id, model order by rebalance_date) as previous_date
  from (select distinct universe_id, model, rebalance_date from held)),
traded as (
  select d.universe_id, d.model, d.rebalance_date,
         case when any_value(d.previous_date) is null then 1.0::double
              else 0.5 * sum(abs(h.weight - coalesce(b.drifted_weight, 0))) end as turnover
  from model_dates d join held h using (universe_id, model, rebalance_date)
  left join drift b on b.universe_id = d.universe_id and b.model = d.model
       and b.rebalance_date = d.previous_date and b.asset = h.asset
  group by d.universe_id, d.model, d.rebalance_date),
gross as (
  select universe_id, model, rebalance_date, period_end, sum(weight * ret) as gross_return from held group by all),
results as (
  select universe_id, model, rebalance_date, period_end, gross_return, turnover,
         turnover * {cost} / 10000 as transaction_cost, gross_return - turnover * {cost} / 10000 as net_return
  from gross join traded using (universe_id, model, rebalance_date))"""


RULE_SQL = f"{DAILY_SQL}, {RULE_WEIGHTS_SQL}, {PERIODS_SQL}"
RULE_RESULTS_SQL = f"{RULE_SQL}, {results_sql()}"

# Body of a period-metric summary over (keys..., order, ret); wealth starts at 1.
def summary_sql(source: str, keys: str, order: str, ret: str, periods_per_year: int = 12, extra: str = "") -> str:
    p = periods_per_year
    return f"""
wealth_path as (
  select *, product(1 + {ret}) over (partition by {keys} order by {order} rows unbounded preceding) as wealth
  from {source}),
drawdown_path as (
  select *, wealth / greatest(max(wealth) over (partition by {keys} order by {order} rows unbounded preceding), 1) - 1
           as drawdown from wealth_path),
summary as (
  select {keys}, count({ret}) as periods, product(1 + {ret}) - 1 as total_return,
         case when product(1 + {ret}) > 0 then pow(product(1 + {ret}), {p}.0 / count({ret})) - 1 end
           as annualized_return,
         stddev_samp({ret}) * sqrt({p}) as annualized_volatility,
         case when stddev_samp({ret}) > 0 then avg({ret}) / stddev_samp({ret}) * sqrt({p}) end as sharpe,
         case when avg(pow(least({ret}, 0), 2)) > 0
              then avg({ret}) * {p} / (sqrt(avg(pow(least({ret}, 0), 2))) * sqrt({p})) end as sortino,
         min(drawdown) as max_drawdown{extra}
  from drawdown_path group by {keys})"""


SUMMARY_COLUMNS = ["total_return", "annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown"]
SUMMARY_SELECT = "periods, " + ", ".join(r(c, 6) for c in SUMMARY_COLUMNS)
