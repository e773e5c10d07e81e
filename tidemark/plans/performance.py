"""Queries on performance metrics, portfolio comparison and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics, periods, portfolios, regimes, returns
from tidemark.plans.catalog import register
from tidemark.plans.common import (
    DAILY_SQL,
    RULE_RESULTS_SQL,
    RULE_SQL,
    SUMMARY_COLUMNS,
    SUMMARY_SELECT,
    closes,
    daily,
    r,
    results_sql,
    rounded,
    rule_inputs,
    rule_results,
    summary_sql,
)
from tidemark.plans.market_features import ASSETS
from tidemark.sources import harness

_KEYS = "universe_id, model"


@register(
    "backtest_summary",
    f"""with {RULE_RESULTS_SQL},
    {summary_sql("results", _KEYS, "period_end", "net_return", extra=", avg(turnover) as average_turnover")}
    select universe_id, model, {SUMMARY_SELECT}, {r("average_turnover", 6)} from summary""",
)
def backtest_summary(spark, sf):
    summary = metrics.backtest_summary(rule_results(spark, sf))
    return rounded(summary, 6, *SUMMARY_COLUMNS, "average_turnover")


@register(
    "nation_asset_performance",
    f"""with {harness.NATION_PRICES_SQL}, {harness.RETURNS_SQL},
    {summary_sql("returns", "universe_id, asset", "session", "ret")}
    select universe_id, asset, {SUMMARY_SELECT} from summary""",
)
def nation_asset_performance(spark, sf):
    rets = returns.return_matrix(harness.nation_prices(spark, sf))
    return rounded(metrics.series_summary(rets, ["universe_id", "asset"], "session", "ret"), 6, *SUMMARY_COLUMNS)


# Research convention over (keys, session, ret): wealth starts at the first return.
def research_sql(source: str, keys: str) -> str:
    return f"""
rwealth as (
  select *, product(1 + ret) over (partition by {keys} order by session rows unbounded preceding) as wealth from {source}),
rpath as (
  select *, wealth / max(wealth) over (partition by {keys} order by session rows unbounded preceding) - 1 as drawdown
  from rwealth),
research as (
  select {keys}, count(ret) as sessions,
    case when product(1 + ret) <= 0 then -1 else pow(product(1 + ret), 252.0 / count(ret)) - 1 end as annualized_return,
    stddev_samp(ret) * sqrt(252) as annualized_volatility,
    case when stddev_samp(ret) <= 0 then 0 else avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) end as sharpe,
    case when avg(pow(least(ret, 0), 2)) <= 0 then 0
         else avg(ret) * 252 / (sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252)) end as sortino,
    min(drawdown) as max_drawdown
  from rpath group by {keys})"""


_RESEARCH = ["annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown"]

PORTFOLIO_DAILY_SQL = f"""{DAILY_SQL}, {harness.WEIGHTS_SQL},
portfolio_daily as (
  select portfolio_id, universe_id, session, sum(weight * ret) as ret from returns join weights using (asset) group by all)"""


def portfolio_daily(spark, sf):
    return portfolios.portfolio_returns(daily(spark, sf), portfolios.normalize_weights(harness.weights(spark, sf)))


@register(
    "research_metrics",
    f"""with {PORTFOLIO_DAILY_SQL}, {research_sql("portfolio_daily", "portfolio_id, universe_id")}
    select portfolio_id, universe_id, sessions, {", ".join(r(c, 6) for c in _RESEARCH)} from research""",
)
def research_metrics(spark, sf):
    rows = metrics.research_summary(portfolio_daily(spark, sf), ["portfolio_id", "universe_id"], "session", "ret")
    return rounded(rows, 6, *_RESEARCH)


def rolling_sql(source: str, keys: str) -> str:
    part = f"partition by {keys} order by session"
    return f"""
rolling as (
  select {keys},
    case when count(ret) over (w rows between 19 preceding and current row) = 20
         then product(1 + ret) over (w rows between 19 preceding and current row) - 1 end as r20,
    case when count(ret) over (w rows between 59 preceding and current row) = 60
         then product(1 + ret) over (w rows between 59 preceding and current row) - 1 end as r60
  from {source}),
worst as (
  select {keys}, min(r20) as worst_rolling_20d_return, min(r60) as worst_rolling_60d_return from rolling
  group by {keys})""".replace("(w rows", f"({part} rows")


_WORST = ["worst_rolling_20d_return", "worst_rolling_60d_return"]


@register(
    "worst_rolling_return",
    f"""with {PORTFOLIO_DAILY_SQL}, {rolling_sql("portfolio_daily", "portfolio_id, universe_id")}
    select portfolio_id, universe_id, {", ".join(r(c, 6) for c in _WORST)} from worst""",
)
def worst_rolling_return(spark, sf):
    rows = metrics.worst_rolling_return(portfolio_daily(spark, sf), ["portfolio_id", "universe_id"], "session", "ret")
    return rounded(rows, 6, *_WORST)


@register(
    "concentration",
    f"""with {harness.WEIGHTS_SQL}
    select portfolio_id, {r("sum(weight * weight)", 8, "concentration")},
           {r("1 / sum(weight * weight)", 6, "effective_positions")}
    from weights group by portfolio_id""",
)
def concentration(spark, sf):
    rows = portfolios.concentration(harness.weights(spark, sf))
    return rounded(rounded(rows, 8, "concentration"), 6, "effective_positions")


# The optimizer book of a portfolio: inverse variance over the whole history, alike for every portfolio.
OPTIMIZER_SQL = """
inverse as (select asset, (1 / var_samp(ret)) as w from returns group by asset),
optimizer as (
  select p.portfolio_id, asset, w / sum(w) over (partition by portfolio_id) as weight
  from inverse cross join (select distinct portfolio_id from weights) p),
paired as (
  select portfolio_id, asset, coalesce(a.weight, 0) as personal, coalesce(b.weight, 0) as optimizer
  from weights a full join optimizer b using (portfolio_id, asset))"""


def optimizer_book(rets, personal):
    inverse = rets.groupBy("asset").agg(F.try_divide(F.lit(1.0), F.var_samp("ret")).alias("weight"))
    slots = personal.select("portfolio_id").distinct().withColumn("asset", F.explode(F.array(*[F.lit(a) for a in ASSETS])))
    return slots.join(inverse, "asset").select("portfolio_id", "asset", "weight")


@register(
    "compare_weights",
    f"""with {DAILY_SQL}, {harness.WEIGHTS_SQL}, {OPTIMIZER_SQL}
    select portfolio_id, {r("sum(least(personal, optimizer))", 8, "portfolio_overlap")},
           {r("sum(abs(personal - optimizer))", 8, "weight_difference")},
           {r("0.5 * sum(abs(personal - optimizer))", 8, "turnover")}
    from paired group by portfolio_id""",
)
def compare_weights(spark, sf):
    personal = harness.weights(spark, sf)
    rows = portfolios.compare_weights(personal, optimizer_book(daily(spark, sf), personal))
    return rounded(rows, 8, "portfolio_overlap", "weight_difference", "turnover")


@register(
    "tracking_error",
    f"""with {PORTFOLIO_DAILY_SQL}, {OPTIMIZER_SQL},
    other as (select portfolio_id, session, sum(weight * ret) as ret from returns join optimizer using (asset) group by all)
    select portfolio_id, universe_id, {r("stddev_samp(a.ret - b.ret) * sqrt(252)", 6, "tracking_error")}
    from portfolio_daily a join other b using (portfolio_id, session) group by all""",
)
def tracking_error(spark, sf):
    rets = daily(spark, sf)
    personal = harness.weights(spark, sf)
    own = portfolios.portfolio_returns(rets, portfolios.normalize_weights(personal))
    other = portfolios.portfolio_returns(rets, portfolios.normalize_weights(optimizer_book(rets, personal)))
    return rounded(portfolios.tracking_error(own, other, ["portfolio_id", "universe_id"]), 6, "tracking_error")


_BENCH = [
    "personal_volatility", "personal_max_drawdown", "optimizer_volatility", "optimizer_max_drawdown",
    "equal_weight_volatility", "benchmark_volatility", "personal_concentration", "personal_effective_positions",
    "optimizer_concentration", "optimizer_effective_positions", "tracking_error", "portfolio_overlap",
    "weight_difference", "turnover",
]


@register(
    "benchmark_summary",
    f"""with {DAILY_SQL}, {harness.WEIGHTS_SQL}, {OPTIMIZER_SQL},
    books as (
      select portfolio_id, 'personal' as book, asset, personal as weight from paired
      union all select portfolio_id, 'optimizer', asset, optimizer from paired
      union all select portfolio_id, 'equal_weight', asset, 1.0::double / count(*) over (partition by portfolio_id)
                from optimizer),
    book_daily as (
      select portfolio_id, book, universe_id, session, sum(weight * ret) as ret
      from returns join books using (asset) group by all),
    {research_sql("book_daily", "portfolio_id, book, universe_id")},
    wide as (
      select portfolio_id,
        max(case when book = 'personal' then annualized_volatility end) as personal_volatility,
        max(case when book = 'personal' then max_drawdown end) as personal_max_drawdown,
        max(case when book = 'optimizer' then annualized_volatility end) as optimizer_volatility,
        max(case when book = 'optimizer' then max_drawdown end) as optimizer_max_drawdown,
        max(case when book = 'equal_weight' then annualized_volatility end) as equal_weight_volatility
      from research group by portfolio_id),
    shape as (
      select portfolio_id, sum(personal * personal) as personal_concentration,
        1 / sum(personal * personal) as personal_effective_positions,
        sum(optimizer * optimizer) as optimizer_concentration,
        1 / sum(optimizer * optimizer) as optimizer_effective_positions,
        sum(least(personal, optimizer)) as portfolio_overlap,
        sum(abs(personal - optimizer)) as weight_difference, 0.5 * sum(abs(personal - optimizer)) as turnover
      from paired group by portfolio_id),
    te as (
      select a.portfolio_id, stddev_samp(a.ret - b.ret) * sqrt(252) as tracking_error
      from book_daily a join book_daily b on a.portfolio_id = b.portfolio_id and a.session = b.session
           and a.book = 'personal' and b.book = 'optimizer' group by a.portfolio_id),
    bench as (select stddev_samp(ret) * sqrt(252) as benchmark_volatility from returns where asset = 'BUILDING')
    select portfolio_id, {", ".join(r(c, 6) for c in _BENCH)}
    from wide join shape using (portfolio_id) join te using (portfolio_id) cross join bench""",
)
def benchmark_summary(spark, sf):
    rets = daily(spark, sf)
    personal = harness.weights(spark, sf)
    rows = portfolios.benchmark_summary(rets, personal, optimizer_book(rets, personal), "BUILDING")
    return rounded(rows, 6, *_BENCH).select("portfolio_id", *_BENCH)


_ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
_ALPHAS_SQL = "alphas as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha)"
_BLENDS_SQL = f"""{_ALPHAS_SQL},
mixed as (select portfolio_id, alpha, asset, (1 - alpha) * personal + alpha * optimizer as w from paired, alphas),
blends as (select portfolio_id, alpha, asset, w / sum(w) over (partition by portfolio_id, alpha) as weight from mixed)"""

_TABLE = [
    "annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown",
    "worst_rolling_20d_return", "worst_rolling_60d_return", "tracking_error_vs_personal",
    "tracking_error_vs_optimizer", "concentration", "effective_positions", "turnover_from_personal",
    "largest_absolute_risk_contribution", "personal_blend_weight", "annualized_return_change_vs_personal",
    "volatility_change_vs_personal", "max_drawdown_change_vs_personal", "concentration_change_vs_personal",
]

_BLEND_TABLE_SQL = f"""with {DAILY_SQL}, {harness.WEIGHTS_SQL}, {OPTIMIZER_SQL}, {_BLENDS_SQL},
blend_daily as (
  select portfolio_id, alpha, session, sum(weight * ret) as ret from returns join blends using (asset) group by all),
{research_sql("blend_daily", "portfolio_id, alpha")}, {rolling_sql("blend_daily", "portfolio_id, alpha")},
errors as (
  select d.portfolio_id, d.alpha, stddev_samp(d.ret - a.ret) * sqrt(252) as tracking_error_vs_personal,
         stddev_samp(d.ret - b.ret) * sqrt(252) as tracking_error_vs_optimizer
  from blend_daily d
  join blend_daily a on a.portfolio_id = d.portfolio_id and a.session = d.session and a.alpha = 0
  join blend_daily b on b.portfolio_id = d.portfolio_id and b.session = d.session and b.alpha = 1
  group by d.portfolio_id, d.alpha),
shape as (
  select x.portfolio_id, x.alpha, sum(x.weight * x.weight) as concentration,
         1 / sum(x.weight * x.weight) as effective_positions, 0.5 * sum(abs(x.weight - o.weight)) as turnover_from_personal
  from blends x join blends o on o.portfolio_id = x.portfolio_id and o.asset = x.asset and o.alpha = 0
  group by x.portfolio_id, x.alpha),
cov as (
  select x.asset as i, y.asset as j, covar_samp(x.ret, y.ret) * 252 as cov
  from returns x join returns y using (session) group by all),
exposure as (
  select b.portfolio_id, b.alpha, i as asset, sum(cov * weight) as e from blends b join cov on j = b.asset group by all),
shares as (
  select portfolio_id, alpha, weight * e / sum(weight * e) over (partition by portfolio_id, alpha) as share
  from exposure join blends using (portfolio_id, alpha, asset)),
largest as (
  select portfolio_id, alpha, max(abs(share)) as largest_absolute_risk_contribution from shares group by all),
full_table as (
  select * from research join worst using (portfolio_id, alpha) join errors using (portfolio_id, alpha)
  join shape using (portfolio_id, alpha) join largest using (portfolio_id, alpha)),
blend_table as (
  select t.*, 1 - t.alpha as personal_blend_weight,
    t.annualized_return - o.annualized_return as annualized_return_change_vs_personal,
    t.annualized_volatility - o.annualized_volatility as volatility_change_vs_personal,
    t.max_drawdown - o.max_drawdown as max_drawdown_change_vs_personal,
    t.concentration - o.concentration as concentration_change_vs_personal,
    t.annualized_volatility < o.annualized_volatility as lower_volatility_than_personal,
    t.max_drawdown > o.max_drawdown as shallower_drawdown_than_personal,
    t.concentration < o.concentration as lower_concentration_than_personal
  from full_table t join full_table o on o.portfolio_id = t.portfolio_id and o.alpha = 0)"""

_FLAGS = ["lower_volatility_than_personal", "shallower_drawdown_than_personal", "lower_concentration_than_personal"]


@register(
    "blend_table",
    f"""{_BLEND_TABLE_SQL}
    select portfolio_id, alpha, sessions, {", ".join(_FLAGS)}, {", ".join(r(c, 6) for c in _TABLE)} from blend_table""",
)
def blend_table(spark, sf):
    rets = daily(spark, sf)
    personal = harness.weights(spark, sf)
    rows = portfolios.blend_table(rets, personal, optimizer_book(rets, personal), _ALPHAS)
    return rounded(rows, 6, *_TABLE).select("portfolio_id", "alpha", "sessions", *_FLAGS, *_TABLE)


@register(
    "best_blends",
    f"""{_BLEND_TABLE_SQL}
    select portfolio_id, arg_min(alpha, (-max_drawdown, alpha)) as best_drawdown,
           arg_min(alpha, (annualized_volatility, alpha)) as lowest_volatility,
           arg_min(alpha, (concentration, alpha)) as lowest_concentration
    from blend_table group by portfolio_id""",
)
def best_blends(spark, sf):
    rets = daily(spark, sf)
    personal = harness.weights(spark, sf)
    return portfolios.best_blends(portfolios.blend_table(rets, personal, optimizer_book(rets, personal), _ALPHAS))


_FREEZE, _EVALUATE = "2001-03-30", "2001-09-28"
_FORWARD_SQL = f"""with {DAILY_SQL}, {harness.WEIGHTS_SQL}, {OPTIMIZER_SQL}, {_BLENDS_SQL},
complete as (
  select * from (select *, count(close) over (partition by universe_id, session) as present from prices)
  where present = (select count(distinct asset) from prices) and session <= date '{_EVALUATE}'),
kept as (
  select * from complete where session >= (select max(session) from complete where session <= date '{_FREEZE}')),
forward as (
  select * from (
    select universe_id, session, asset,
           close / lag(close) over (partition by universe_id, asset order by session) - 1 as ret from kept)
  where session > date '{_FREEZE}'),
blend_daily as (
  select portfolio_id, alpha, session, sum(weight * ret) as ret from forward join blends using (asset) group by all)"""

_FORWARD = [
    "cumulative_return", "realized_annualized_volatility", "max_drawdown", "best_day", "worst_day",
    "positive_session_rate", "cumulative_excess_return_vs_personal",
]


@register(
    "forward_blend_table",
    f"""{_FORWARD_SQL}, {research_sql("blend_daily", "portfolio_id, alpha")},
    facts as (
      select portfolio_id, alpha, count(ret) as observed_sessions, product(1 + ret) - 1 as cumulative_return,
             stddev_samp(ret) * sqrt(252) as realized_annualized_volatility, max(ret) as best_day, min(ret) as worst_day,
             avg((ret > 0)::double) as positive_session_rate from blend_daily group by all),
    joined as (
      select f.*, max_drawdown, f.cumulative_return - o.cumulative_return as cumulative_excess_return_vs_personal
      from facts f join research using (portfolio_id, alpha)
      join facts o on o.portfolio_id = f.portfolio_id and o.alpha = 0)
    select portfolio_id, alpha, observed_sessions, {", ".join(r(c, 6) for c in _FORWARD)},
           case when observed_sessions < 20 then 'PROVISIONAL' else 'FORMAL' end as status
    from joined""",
)
def forward_blend_table(spark, sf):
    forward = returns.forward_price_returns(closes(spark, sf), _FREEZE, _EVALUATE)
    personal = harness.weights(spark, sf)
    rows = portfolios.forward_blend_table(forward, personal, optimizer_book(daily(spark, sf), personal), _ALPHAS)
    return rounded(rows, 6, *_FORWARD)


@register(
    "forward_blend_daily",
    f"""{_FORWARD_SQL}
    select portfolio_id, session, {", ".join(
        f"round(max(case when alpha = {a} then ret end), 8) + 0.0::double as optimizer_{int(a * 100):03d}" for a in _ALPHAS)}
    from blend_daily group by portfolio_id, session""",
)
def forward_blend_daily(spark, sf):
    forward = returns.forward_price_returns(closes(spark, sf), _FREEZE, _EVALUATE)
    personal = harness.weights(spark, sf)
    rows = portfolios.forward_blend_daily(forward, personal, optimizer_book(daily(spark, sf), personal), _ALPHAS)
    return rounded(rows, 8, *[c for c in rows.columns if c.startswith("optimizer_")])


REGIMES = {
    "early": ("1995-01-01", "1997-12-31"),
    "middle": ("1998-01-01", "1999-12-31"),
    "late": ("2000-01-01", "2001-12-31"),
    "full": ("1995-01-01", "2001-12-31"),
}
_REGIMES_SQL = "regimes(regime, lo, hi) as (values " + ", ".join(
    f"('{n}', date '{lo}', date '{hi}')" for n, (lo, hi) in REGIMES.items()
) + ")"
_REGIME_SUMMARY = f"""with {RULE_RESULTS_SQL}, {_REGIMES_SQL},
tagged as (select regime, results.* from results join regimes on period_end between lo and hi),
{summary_sql("tagged", "regime, universe_id, model", "period_end", "net_return")}"""


@register("custom_regimes", f"{_REGIME_SUMMARY} select regime, universe_id, model, {SUMMARY_SELECT} from summary")
def custom_regimes(spark, sf):
    return rounded(regimes.custom_regimes(rule_results(spark, sf), REGIMES), 6, *SUMMARY_COLUMNS)


@register(
    "rank_by_regime",
    f"""{_REGIME_SUMMARY}
    select regime, universe_id, model, {r("sharpe", 6)},
           rank() over (partition by regime, universe_id order by sharpe desc nulls last) as sharpe_rank,
           rank() over (partition by regime, universe_id order by annualized_volatility nulls last) as volatility_rank
    from summary""",
)
def rank_by_regime(spark, sf):
    summary = regimes.custom_regimes(rule_results(spark, sf), REGIMES)
    ranked = regimes.rank_by_regime(summary, "sharpe").withColumn("sharpe_rank", F.col("rank").cast("long"))
    both = regimes.rank_by_regime(ranked, "annualized_volatility").withColumn("volatility_rank", F.col("rank").cast("long"))
    return rounded(both, 6, "sharpe").select(
        "regime", "universe_id", "model", "sharpe", "sharpe_rank", "volatility_rank"
    )


@register(
    "mean_rank_by_regime",
    f"""{_REGIME_SUMMARY},
    ranked as (
      select *, rank() over (partition by regime, universe_id order by sharpe desc nulls last) as rk from summary)
    select universe_id, model, {r("avg(rk)", 6, "mean_rank")}, count(rk) as regimes from ranked group by all""",
)
def mean_rank_by_regime(spark, sf):
    ranked = regimes.rank_by_regime(regimes.custom_regimes(rule_results(spark, sf), REGIMES))
    return rounded(regimes.mean_rank(ranked), 6, "mean_rank")


@register(
    "blend_grid_report",
    f"""with {RULE_SQL}, shares as (select unnest([0.25, 0.5, 0.75])::double as share),
    blended as (
      select universe_id, printf('blend_%.2f', share) as model, rebalance_date, asset,
             (1 - share) * equal_weight + share * inverse_variance as weight from wide_weights, shares
      union all select universe_id, model, rebalance_date, asset, weight from model_weights
                where model in ('equal_weight', 'inverse_variance')),
    {results_sql("blended")}, costs as (select unnest([0.0, 5.0, 10.0, 25.0])::double as cost_bps), {_REGIMES_SQL},
    tagged as (
      select regime, cost_bps, universe_id, model, period_end, turnover,
             gross_return - turnover * cost_bps / 10000 as net_return
      from results cross join costs join regimes on period_end between lo and hi),
    {summary_sql("tagged", "regime, cost_bps, universe_id, model", "period_end", "net_return")}
    select regime, cost_bps, universe_id, model, {SUMMARY_SELECT},
           rank() over (partition by regime, cost_bps, universe_id order by sharpe desc nulls last) as rank
    from summary""",
)
def blend_grid_report(spark, sf):
    weights, realized = rule_inputs(spark, sf)
    blends = periods.blend_weight_history(weights, "equal_weight", "inverse_variance", [0.25, 0.5, 0.75])
    both = blends.unionByName(weights.filter(F.col("model").isin("equal_weight", "inverse_variance")))
    grid = periods.strategy_period_results(both, realized, [0.0, 5.0, 10.0, 25.0])
    summary = regimes.custom_regimes(grid, REGIMES, ["cost_bps"])
    ranked = regimes.rank_by_regime(summary, "sharpe", ["cost_bps"]).withColumn("rank", F.col("rank").cast("long"))
    return rounded(ranked, 6, *SUMMARY_COLUMNS)
