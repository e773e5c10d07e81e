"""Queries on trailing features and the regime feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import covariance, market_features, periods
from tidemark.plans.catalog import register
from tidemark.plans.common import DAILY_SQL, daily, r, rounded
from tidemark.session import cut_lineage

ASSETS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ROLES = {"equity": "AUTOMOBILE", "bond": "BUILDING", "gold": "FURNITURE", "growth": "HOUSEHOLD", "dividend": "MACHINERY"}
_CELLS = ["return_21d", "return_63d", "return_126d", "vol_21d", "vol_63d", "drawdown_126d"]


def _frame(n: int) -> str:
    return f"over (partition by universe_id, asset order by session rows between {n - 1} preceding and current row)"


TRAILING_SQL = f"""
wealth as (
  select *, product(1 + ret) over (partition by universe_id, asset order by session rows unbounded preceding) as wealth,
         count(ret) over (partition by universe_id, asset order by session rows unbounded preceding) as history
  from returns),
trail as (
  select universe_id, session, asset, history,
    {", ".join(f"case when history >= {n} then product(1 + ret) {_frame(n)} - 1 end as return_{n}d" for n in (21, 63, 126))},
    {", ".join(f"case when history >= {n} then stddev_samp(ret) {_frame(n)} * sqrt(252) end as vol_{n}d" for n in (21, 63))},
    case when history >= 126 then wealth / max(wealth) {_frame(126)} - 1 end as drawdown_126d
  from wealth)"""

_PAIR_SQL = """
pairs as (
  select universe_id, session, asset_i, asset_j, case when count(*) over w = 63 then corr(x, y) over w end as corr
  from (select a.universe_id, a.session, a.asset as asset_i, b.asset as asset_j, a.ret as x, b.ret as y
        from returns a join returns b using (universe_id, session) where a.asset < b.asset)
  window w as (partition by universe_id, asset_i, asset_j order by session rows between 62 preceding and current row))"""


def _pair_sql(a: str, b: str) -> str:
    low, high = sorted((ROLES[a], ROLES[b]))
    return f"max(case when asset_i = '{low}' and asset_j = '{high}' then corr end)"


FEATURES_SQL = f"""{TRAILING_SQL}, {_PAIR_SQL},
feature_dates as (
  select universe_id, max(session) as session from returns group by universe_id, date_trunc('month', session)),
asset_wide as (
  select universe_id, session as rebalance_date,
    {", ".join(f"max(case when asset = '{a}' then {c} end) as {a}_{c}" for c in _CELLS for a in ASSETS)},
    {", ".join(f"stddev_pop(return_{n}d) as cross_asset_return_dispersion_{n}d" for n in (21, 63, 126))},
    {", ".join(f"stddev_pop(vol_{n}d) as cross_asset_vol_dispersion_{n}d" for n in (21, 63))}
  from trail join feature_dates using (universe_id, session) where history >= 126 group by all),
corr_wide as (
  select universe_id, session as rebalance_date, avg(corr) as average_pairwise_corr_63d,
    {", ".join(f"{_pair_sql(a, b)} as {n}_63d" for n, (a, b) in market_features.CORRELATION_PAIRS.items())}
  from pairs join feature_dates using (universe_id, session) group by all),
features as (
  select *, {", ".join(
      f"{ROLES[a]}_return_63d - {ROLES[b]}_return_63d as {n}_63d"
      for n, (a, b) in market_features.MOMENTUM_SPREADS.items())}
  from asset_wide join corr_wide using (universe_id, rebalance_date))"""

FEATURES = (
    [f"{a}_{c}" for c in _CELLS for a in ASSETS]
    + [f"cross_asset_return_dispersion_{n}d" for n in (21, 63, 126)]
    + [f"cross_asset_vol_dispersion_{n}d" for n in (21, 63)]
    + ["average_pairwise_corr_63d"]
    + [f"{n}_63d" for n in market_features.CORRELATION_PAIRS]
    + [f"{n}_63d" for n in market_features.MOMENTUM_SPREADS]
)


def feature_matrix(spark, sf, rets=None):
    rets = cut_lineage(daily(spark, sf)) if rets is None else rets
    dates = periods.month_end_dates(rets).withColumnRenamed("month_end", "rebalance_date")
    return market_features.regime_features(rets, dates, ASSETS, ROLES)


@register(
    "trailing_features",
    f"""with {DAILY_SQL}, {TRAILING_SQL}
    select universe_id, session, asset, history, {", ".join(r(c, 9) for c in _CELLS)} from trail""",
)
def trailing_features(spark, sf):
    return rounded(market_features.trailing_features(daily(spark, sf)), 9, *_CELLS)


@register(
    "pair_correlation",
    f"""with {DAILY_SQL}, {_PAIR_SQL}
    select universe_id, session, asset_i, asset_j, {r("corr", 6)} from pairs""",
)
def pair_correlation(spark, sf):
    return rounded(covariance.trailing_pair_correlation(daily(spark, sf), 63), 6, "corr")


@register(
    "average_pairwise_correlation",
    f"""with {DAILY_SQL}, {_PAIR_SQL}
    select universe_id, session, {r("avg(corr)", 6, "average_corr")} from pairs group by universe_id, session""",
)
def average_pairwise_correlation(spark, sf):
    pairs = covariance.trailing_pair_correlation(daily(spark, sf), 63)
    return rounded(covariance.average_pairwise(pairs), 6, "average_corr")


@register(
    "regime_features",
    f"""with {DAILY_SQL}, {FEATURES_SQL}
    select universe_id, rebalance_date, {", ".join(r(c, 9) for c in FEATURES)} from features""",
)
def regime_features(spark, sf):
    return rounded(feature_matrix(spark, sf), 9, *FEATURES)


@register(
    "feature_describe",
    f"""with {DAILY_SQL}, {FEATURES_SQL},
    long as (unpivot (select {", ".join(FEATURES)} from features) on {", ".join(FEATURES)} into name feature value value)
    select feature, (select count(*) from features) as rows, (select count(*) from features) - count(value) as nulls,
           {r("avg(value)", 6, "mean")}, {r("stddev_samp(value)", 6, "std")}, {r("min(value)", 6, "min")},
           {r("max(value)", 6, "max")}
    from long group by feature""",
)
def feature_describe(spark, sf):
    rows = market_features.feature_describe(feature_matrix(spark, sf), ["universe_id", "rebalance_date"], FEATURES)
    return rounded(rows, 6, "mean", "std", "min", "max")
