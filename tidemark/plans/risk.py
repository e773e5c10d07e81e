"""Queries on covariance, risk shares, forecasts and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import covariance, ensemble, forecast, portfolios, risk
from tidemark.plans.catalog import register
from tidemark.plans.common import DAILY_SQL, RULE_SQL, daily, r, rounded, rule_inputs
from tidemark.sources import harness

_COV_SQL = """
cov as (
  select x.universe_id, x.asset as asset_i, y.asset as asset_j, covar_samp(x.ret, y.ret) * 252 as cov
  from returns x join returns y using (universe_id, session) group by all)"""

# Shrinkage towards mu I from centred second and fourth moments.
SHRUNK_SQL = """
centred as (select *, ret - avg(ret) over (partition by universe_id, asset) as z from returns),
pairs as (
  select x.universe_id, x.asset as asset_i, y.asset as asset_j, avg(x.z * y.z) as s,
         avg(x.z * x.z * y.z * y.z) as q, count(*) as n
  from centred x join centred y using (universe_id, session) group by all),
scale as (
  select universe_id, sqrt(count(*)) as p, max(n) as n, sum(case when asset_i = asset_j then s else 0 end) as tr,
         sum(s * s) as squares, sum(q - s * s) as noise from pairs group by universe_id),
intensity as (
  select universe_id, tr / p as mu, (squares - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p as d,
         noise / (p * n) as b0 from scale),
shrink as (
  select universe_id, mu, case when least(b0, d) = 0 then 0 else least(b0, d) / d end as shrinkage from intensity),
shrunk as (
  select universe_id, asset_i, asset_j, shrinkage,
         ((1 - shrinkage) * s + case when asset_i = asset_j then shrinkage * mu else 0 end) * 252 as cov
  from pairs join shrink using (universe_id))"""


@register(
    "sample_covariance",
    f"with {DAILY_SQL}, {_COV_SQL} select universe_id, asset_i, asset_j, {r('cov', 8)} from cov",
)
def sample_covariance(spark, sf):
    return rounded(covariance.sample_covariance(daily(spark, sf)), 8, "cov")


@register(
    "ledoit_wolf",
    f"""with {DAILY_SQL}, {SHRUNK_SQL}
    select universe_id, asset_i, asset_j, {r("cov", 8)}, {r("shrinkage", 6)} from shrunk""",
)
def ledoit_wolf(spark, sf):
    return rounded(rounded(covariance.ledoit_wolf(daily(spark, sf)), 8, "cov"), 6, "shrinkage")


@register(
    "expanding_ledoit_wolf",
    f"""with {DAILY_SQL},
    month_ends as (select universe_id, max(session) as as_of from returns group by universe_id, date_trunc('month', session)),
    history as (
      select e.as_of, r.*, count(*) over (partition by e.universe_id, e.as_of, r.asset) as seen
      from returns r join month_ends e on e.universe_id = r.universe_id and r.session <= e.as_of),
    centred as (
      select *, ret - avg(ret) over (partition by universe_id, as_of, asset) as z from history where seen >= 126),
    pairs as (
      select x.universe_id, x.as_of, x.asset as asset_i, y.asset as asset_j, avg(x.z * y.z) as s,
             avg(x.z * x.z * y.z * y.z) as q, count(*) as n
      from centred x join centred y using (universe_id, as_of, session) group by all),
    scale as (
      select universe_id, as_of, sqrt(count(*)) as p, max(n) as n, sum(case when asset_i = asset_j then s else 0 end) as tr,
             sum(s * s) as squares, sum(q - s * s) as noise from pairs group by universe_id, as_of),
    intensity as (
      select universe_id, as_of, tr / p as mu, (squares - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p as d,
             noise / (p * n) as b0 from scale),
    shrink as (select *, case when least(b0, d) = 0 then 0 else least(b0, d) / d end as shrinkage from intensity)
    select universe_id, as_of, asset_i, asset_j, {r("shrinkage", 6)},
           round(((1 - shrinkage) * s + case when asset_i = asset_j then shrinkage * mu else 0 end) * 252, 8)
             + 0.0::double as cov
    from pairs join shrink using (universe_id, as_of)""",
)
def expanding_ledoit_wolf(spark, sf):
    sums = covariance.expanding_pair_sums(daily(spark, sf), 126)
    return rounded(rounded(covariance.shrunk_from_sums(sums), 8, "cov"), 6, "shrinkage")


@register(
    "cov_to_corr",
    f"""with {DAILY_SQL}, {_COV_SQL},
    d as (select universe_id, asset_i as asset, sqrt(cov) as sd from cov where asset_i = asset_j)
    select c.universe_id, asset_i, asset_j, round(greatest(-1, least(1, cov / (a.sd * b.sd))), 8) + 0.0::double as corr
    from cov c join d a on a.universe_id = c.universe_id and a.asset = asset_i
    join d b on b.universe_id = c.universe_id and b.asset = asset_j""",
)
def cov_to_corr(spark, sf):
    return rounded(covariance.correlation(covariance.sample_covariance(daily(spark, sf))), 8, "corr")


@register(
    "covariance_distance",
    f"""with {DAILY_SQL}, {_COV_SQL}, {SHRUNK_SQL}
    select universe_id, count(distinct asset_i) as assets, {r("max(shrinkage)", 6, "shrinkage")},
           {r("sqrt(sum(pow(s.cov - c.cov, 2)))", 8, "frobenius_distance")},
           {r("sqrt(sum(pow(c.cov, 2)))", 8, "sample_norm")}
    from shrunk s join cov c using (universe_id, asset_i, asset_j) group by universe_id""",
)
def covariance_distance(spark, sf):
    rows = covariance.covariance_distance(daily(spark, sf))
    return rounded(rounded(rows, 6, "shrinkage"), 8, "frobenius_distance", "sample_norm")


@register("covariance_spectrum")
def covariance_spectrum(spark, sf):
    """Eigenvalues need a solver; the rows carry both estimators side by side."""
    rets = daily(spark, sf)
    sums = covariance.pair_sums(rets)
    sample = covariance.spectrum(covariance.sample_from_sums(sums)).withColumn("estimator", F.lit("sample"))
    shrunk = covariance.spectrum(covariance.shrunk_from_sums(sums).drop("shrinkage")).withColumn(
        "estimator", F.lit("shrunk")
    )
    rows = sample.unionByName(shrunk)
    return rounded(rows, 6, "smallest_eigenvalue", "largest_eigenvalue", "condition_number")


@register(
    "portfolio_variance",
    f"""with {DAILY_SQL}, {_COV_SQL}, {harness.WEIGHTS_SQL}
    select a.portfolio_id, c.universe_id, {r("sum(a.weight * b.weight * cov)", 8, "variance")},
           {r("sqrt(sum(a.weight * b.weight * cov))", 8, "volatility")}
    from cov c join weights a on a.asset = asset_i join weights b on b.asset = asset_j and a.portfolio_id = b.portfolio_id
    group by all""",
)
def portfolio_variance(spark, sf):
    weights = portfolios.normalize_weights(harness.weights(spark, sf))
    return rounded(
        risk.portfolio_variance(weights, covariance.sample_covariance(daily(spark, sf))), 8, "variance", "volatility"
    )


_CONTRIBUTIONS_SQL = f"""with {DAILY_SQL}, {SHRUNK_SQL}, {harness.WEIGHTS_SQL},
e as (
  select b.portfolio_id, universe_id, asset_i as asset, sum(cov * weight) as exposure,
         max(case when asset_i = asset_j then cov end) as own
  from shrunk join weights b on b.asset = asset_j group by all),
c as (
  select *, sum(weight * exposure) over (partition by portfolio_id, universe_id) as variance
  from e join weights using (portfolio_id, asset)),
contributions as (
  select portfolio_id, universe_id, asset, weight, sqrt(own) as asset_volatility,
         exposure / sqrt(variance) as marginal_risk, weight * exposure / sqrt(variance) as component_risk,
         weight * exposure / variance as risk_share from c)"""

_CONTRIBUTIONS = ["weight", "asset_volatility", "marginal_risk", "component_risk", "risk_share"]


def _contributions(spark, sf):
    weights = portfolios.normalize_weights(harness.weights(spark, sf))
    return risk.risk_contributions(weights, covariance.ledoit_wolf(daily(spark, sf)))


@register(
    "risk_contributions",
    f"{_CONTRIBUTIONS_SQL} select portfolio_id, universe_id, asset, {', '.join(r(c, 8) for c in _CONTRIBUTIONS)} from contributions",
)
def risk_contributions(spark, sf):
    return rounded(_contributions(spark, sf), 8, *_CONTRIBUTIONS)


@register(
    "risk_concentration",
    f"""{_CONTRIBUTIONS_SQL}
    select portfolio_id, {r("sum(risk_share * risk_share)", 8, "risk_concentration")},
           {r("1 / sum(risk_share * risk_share)", 6, "effective_risk_positions")}
    from contributions group by portfolio_id""",
)
def risk_concentration(spark, sf):
    rows = risk.risk_concentration(_contributions(spark, sf))
    return rounded(rounded(rows, 8, "risk_concentration"), 6, "effective_risk_positions")


@register(
    "sample_risk_contribution",
    f"""with {DAILY_SQL}, {_COV_SQL}, {harness.WEIGHTS_SQL},
    e as (
      select b.portfolio_id, universe_id, asset_i as asset, sum(cov * weight) as exposure
      from cov join weights b on b.asset = asset_j group by all),
    v as (
      select *, sum(weight * exposure) over (partition by portfolio_id) as variance
      from e join weights using (portfolio_id, asset))
    select portfolio_id, asset,
           round(case when variance > 0 then weight * exposure / variance else 0 end, 8) + 0.0::double as risk_share
    from v""",
)
def sample_risk_contribution(spark, sf):
    weights = portfolios.normalize_weights(harness.weights(spark, sf))
    rows = risk.risk_contributions(weights, covariance.sample_covariance(daily(spark, sf)))
    return rounded(rows, 8, "risk_share").select("portfolio_id", "asset", "risk_share")


_FORECAST = ["geometric", "arithmetic", "ewma", "blended", "robust", "estimator_dispersion"]
_FORECAST_SQL = f"""
ordered as (
  select *, row_number() over (partition by universe_id, asset order by session) as t,
         count(*) over (partition by universe_id, asset) as n from returns),
parts as (
  select universe_id, max(session) as session, asset, count(*) as observations,
         pow(product(1 + ret), 252.0 / count(*)) - 1 as geometric, avg(ret) * 252 as arithmetic,
         sum(case when t = 1 then pow(125.0 / 127.0, n - 1) else 2.0 / 127.0 * pow(125.0 / 127.0, n - t) end * ret) * 252
           as ewma
  from ordered group by universe_id, asset),
forecast as (
  select *, (geometric + arithmetic + ewma) / 3 as blended,
         (geometric + arithmetic) / 2 * 0.8 + ewma * 0.2 as robust,
         sqrt((pow(geometric - (geometric + arithmetic + ewma) / 3, 2)
             + pow(arithmetic - (geometric + arithmetic + ewma) / 3, 2)
             + pow(ewma - (geometric + arithmetic + ewma) / 3, 2)) / 3) as estimator_dispersion from parts)"""


@register(
    "expected_returns",
    f"""with {DAILY_SQL}, {_FORECAST_SQL}
    select universe_id, session, asset, observations, {", ".join(r(c, 6) for c in _FORECAST)} from forecast""",
)
def expected_returns(spark, sf):
    return rounded(forecast.latest_expected_returns(daily(spark, sf)), 6, *_FORECAST)


def _solver_free(spark, sf):
    weights, _ = rule_inputs(spark, sf)
    return weights.withColumnRenamed("rebalance_date", "as_of")


@register(
    "consensus_weights",
    f"""with {RULE_SQL}
    select universe_id, rebalance_date as as_of, asset,
           round(avg(weight), 8) + 0.0::double as weight,
           round(sum(weight * case model when 'equal_weight' then 1 when 'inverse_variance' then 2 when 'price_weight' then 1
                     else 0 end) / 4, 8) + 0.0::double as weighted
    from model_weights group by all""",
)
def consensus_weights(spark, sf):
    weights = _solver_free(spark, sf)
    keys = ["universe_id", "as_of", "asset"]
    equal = ensemble.consensus_weights(weights)
    importance = {"equal_weight": 1.0, "inverse_variance": 2.0, "price_weight": 1.0, "low_risk": 0.0}
    weighted = ensemble.consensus_weights(weights, importance).withColumnRenamed("weight", "weighted")
    return rounded(equal.join(weighted, keys), 8, "weight", "weighted")


_DISAGREE = ["mean_weight", "allocation_std", "allocation_range", "disagreement_score", "overall_disagreement"]


@register(
    "allocation_disagreement",
    f"""with {RULE_SQL},
    d as (
      select universe_id, rebalance_date as as_of, asset, avg(weight) as mean_weight, stddev_pop(weight) as allocation_std,
             max(weight) - min(weight) as allocation_range,
             case when avg(weight) <> 0 then (max(weight) - min(weight)) / avg(weight) else 0 end as disagreement_score
      from model_weights group by all),
    o as (select *, avg(allocation_std) over (partition by universe_id, as_of) as overall_disagreement from d)
    select universe_id, as_of, asset, {", ".join(r(c, 8) for c in _DISAGREE)},
           case when round(disagreement_score, 8) <= 0.5 then 'HIGH' when round(disagreement_score, 8) <= 1.0 then 'MEDIUM'
                else 'LOW' end as agreement
    from o""",
)
def allocation_disagreement(spark, sf):
    rows = rounded(ensemble.allocation_disagreement(_solver_free(spark, sf)), 8, *_DISAGREE)
    return rows.withColumn("agreement", ensemble.agreement_label(F.col("disagreement_score")))
