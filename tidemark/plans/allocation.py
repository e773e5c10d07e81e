"""Queries on allocators, walk-forward evaluation and candidate allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import (
    allocators,
    candidates,
    covariance,
    forecast,
    frontier,
    metrics,
    returns,
    risk,
    walk_forward,
)
from tidemark.plans.catalog import register
from tidemark.plans.common import DAILY_SQL, PERIODS_SQL, SUMMARY_COLUMNS, SUMMARY_SELECT, closes, daily, r, results_sql, rounded, summary_sql
from tidemark.session import cut_lineage
from tidemark.sources import harness

_PAIR_MIN, _PAIR_CAP, _PAIR_SPAN = 24, 0.6, 12


def _two_asset(spark, sf):
    """(covariance, forecasts) of every two-asset universe at every month with enough history."""
    rets = cut_lineage(returns.return_matrix(harness.two_asset_prices(spark, sf)))
    cov = covariance.shrunk_from_sums(covariance.expanding_pair_sums(rets, _PAIR_MIN), 12).drop("shrinkage")
    expected = forecast.expected_returns(rets, _PAIR_SPAN, 12).select(
        "universe_id", F.col("session").alias("as_of"), "asset", F.col("robust").alias("expected")
    )
    return cut_lineage(cov), expected


# Closed forms for two assets: clipped minimum variance, clipped inverse volatility,
# inverse variance for the hierarchy and the clipped tangency weight.
_TWO_ASSET_SQL = f"""{harness.TWO_ASSET_PRICES_SQL}, {harness.RETURNS_SQL},
wide as (
  select universe_id, session, max(case when asset = 'HIGH' then ret end) as x, max(case when asset = 'LOW' then ret end) as y
  from returns group by all),
history as (
  select a.universe_id, a.session as as_of, b.x, b.y,
         row_number() over (partition by a.universe_id, a.session order by b.session) as t,
         count(*) over (partition by a.universe_id, a.session) as n
  from wide a join wide b on a.universe_id = b.universe_id and b.session <= a.session),
centred as (
  select *, x - avg(x) over g as zx, y - avg(y) over g as zy from history where n >= {_PAIR_MIN}
  window g as (partition by universe_id, as_of)),
m as (
  select universe_id, as_of, any_value(n) as n, avg(zx * zx) as s11, avg(zy * zy) as s22, avg(zx * zy) as s12,
    avg(zx * zx * zx * zx) as q11, avg(zy * zy * zy * zy) as q22, avg(zx * zx * zy * zy) as q12,
    pow(product(1 + x), 12.0 / any_value(n)) - 1 as gx, pow(product(1 + y), 12.0 / any_value(n)) - 1 as gy,
    avg(x) * 12 as ax, avg(y) * 12 as ay,
    sum(x * case when t = 1 then pow(11.0 / 13, n - 1) else 2.0 / 13 * pow(11.0 / 13, n - t) end) * 12 as ex,
    sum(y * case when t = 1 then pow(11.0 / 13, n - 1) else 2.0 / 13 * pow(11.0 / 13, n - t) end) * 12 as ey
  from centred group by universe_id, as_of),
k as (
  select *, (s11 + s22) / 2 as mu, (pow(s11, 2) + pow(s22, 2) + 2 * pow(s12, 2)) as squares,
    (q11 - s11 * s11 + q22 - s22 * s22 + 2 * (q12 - s12 * s12)) / (2 * n) as b0 from m),
d as (select *, (squares - 4 * mu * mu + 2 * mu * mu) / 2 as dist from k),
l as (select *, case when least(b0, dist) = 0 then 0 else least(b0, dist) / dist end as sh from d),
cov as (
  select universe_id, as_of, ((1 - sh) * s11 + sh * mu) * 12 as c11, ((1 - sh) * s22 + sh * mu) * 12 as c22,
    (1 - sh) * s12 * 12 as c12, (gx + ax) / 2 * 0.8 + ex * 0.2 as m1, (gy + ay) / 2 * 0.8 + ey * 0.2 as m2 from l),
z as (
  select *, c22 * m1 - c12 * m2 as t1, c11 * m2 - c12 * m1 as t2, 1 - {_PAIR_CAP} as lo, {_PAIR_CAP}::double as hi from cov),
tangent as (
  select *, case when t1 + t2 > 0 then greatest(lo, least(hi, t1 / (t1 + t2)))
    when (lo * m1 + (1 - lo) * m2) / sqrt(lo * lo * c11 + (1 - lo) * (1 - lo) * c22 + 2 * lo * (1 - lo) * c12)
       > (hi * m1 + (1 - hi) * m2) / sqrt(hi * hi * c11 + (1 - hi) * (1 - hi) * c22 + 2 * hi * (1 - hi) * c12) then lo
    else hi end as ms from z),
first_weight as (
  select universe_id, as_of, 'minimum_variance' as model, greatest(lo, least(hi, (c22 - c12) / (c11 + c22 - 2 * c12))) as w from tangent
  union all select universe_id, as_of, 'risk_parity', greatest(lo, least(hi, sqrt(c22) / (sqrt(c11) + sqrt(c22)))) from tangent
  union all select universe_id, as_of, 'hrp', 1 - c11 / (c11 + c22) from tangent
  union all select universe_id, as_of, 'maximum_sharpe', ms from tangent),
pair_weights as (
  select universe_id, as_of, model, 'HIGH' as asset, w as weight from first_weight
  union all select universe_id, as_of, model, 'LOW', 1 - w from first_weight)"""


@register(
    "two_asset_allocation",
    f"with {_TWO_ASSET_SQL} select universe_id, as_of, model, asset, {r('weight', 6)} from pair_weights",
)
def two_asset_allocation(spark, sf):
    cov, expected = _two_asset(spark, sf)
    return rounded(allocators.solved_weights(cov, expected, high=_PAIR_CAP), 6, "weight")


@register(
    "two_asset_spectrum",
    f"""with {_TWO_ASSET_SQL},
    e as (
      select universe_id, as_of, (c11 + c22) / 2 - sqrt(pow((c11 - c22) / 2, 2) + c12 * c12) as low,
             (c11 + c22) / 2 + sqrt(pow((c11 - c22) / 2, 2) + c12 * c12) as high from cov)
    select universe_id, as_of, {r("low", 8, "smallest_eigenvalue")}, {r("high", 8, "largest_eigenvalue")},
           {r("high / low", 5, "condition_number")} from e""",
)
def two_asset_spectrum(spark, sf):
    rows = covariance.spectrum(_two_asset(spark, sf)[0])
    return rounded(rounded(rows, 8, "smallest_eigenvalue", "largest_eigenvalue"), 5, "condition_number")


@register(
    "allocation_equal_weight",
    f"""with {_TWO_ASSET_SQL}, a as (select distinct universe_id, as_of, asset from pair_weights)
    select universe_id, as_of, 'equal_weight' as model, asset,
           1.0::double / count(*) over (partition by universe_id, as_of) as weight from a""",
)
def allocation_equal_weight(spark, sf):
    cov, _ = _two_asset(spark, sf)
    return allocators.equal_weight(
        cov.filter("asset_i = asset_j").select("universe_id", "as_of", F.col("asset_i").alias("asset"))
    )


@register(
    "allocation_inverse_variance",
    f"""with {_TWO_ASSET_SQL}
    select universe_id, as_of, 'inverse_variance' as model, 'HIGH' as asset, {r("c22 / (c11 + c22)", 8, "weight")} from cov
    union all
    select universe_id, as_of, 'inverse_variance', 'LOW', {r("c11 / (c11 + c22)", 8, "weight")} from cov""",
)
def allocation_inverse_variance(spark, sf):
    return rounded(allocators.inverse_variance(_two_asset(spark, sf)[0]), 8, "weight")


@register(
    "correlation_distance",
    f"""with {DAILY_SQL},
    c as (
      select x.universe_id, x.asset as asset_i, y.asset as asset_j, corr(x.ret, y.ret) as rho
      from returns x join returns y using (universe_id, session) group by all)
    select universe_id, asset_i, asset_j,
           round(case when asset_i = asset_j then 0 else sqrt(greatest((1 - rho) / 2, 0)) end, 8) + 0.0::double as distance
    from c""",
)
def correlation_distance(spark, sf):
    corr = covariance.correlation(covariance.sample_covariance(daily(spark, sf)))
    return rounded(allocators.correlation_distance(corr), 8, "distance").drop("corr")


_COMPARE = [
    "volatility", "weight_concentration", "effective_positions", "risk_concentration", "effective_risk_positions",
    "largest_weight", "largest_risk_share",
]


@register(
    "allocation_comparison",
    f"""with {_TWO_ASSET_SQL},
    f as (
      select universe_id, as_of, model, w, 1 - w as v, w * c11 + (1 - w) * c12 as e1, w * c12 + (1 - w) * c22 as e2
      from first_weight join cov using (universe_id, as_of)),
    g as (select *, w * e1 + v * e2 as var from f),
    out as (
      select universe_id, as_of, model, sqrt(var) as volatility, w * w + v * v as weight_concentration,
        1 / (w * w + v * v) as effective_positions, pow(w * e1 / var, 2) + pow(v * e2 / var, 2) as risk_concentration,
        1 / (pow(w * e1 / var, 2) + pow(v * e2 / var, 2)) as effective_risk_positions, greatest(w, v) as largest_weight,
        greatest(w * e1 / var, v * e2 / var) as largest_risk_share from g)
    select universe_id, as_of, model, {", ".join(r(c, 5) for c in _COMPARE)} from out""",
)
def allocation_comparison(spark, sf):
    cov, expected = _two_asset(spark, sf)
    weights = cut_lineage(allocators.solved_weights(cov, expected, high=_PAIR_CAP))
    return rounded(risk.allocation_comparison(weights, cov, ["universe_id", "as_of", "model"]), 5, *_COMPARE)


@register("walk_forward_weights")
def walk_forward_weights(spark, sf):
    """Six models at every month-end with enough history; solver output, so rows only."""
    rets = cut_lineage(daily(spark, sf))
    return rounded(walk_forward.walk_forward_weights(rets), 8, "weight")


# A solver cannot run in SQL, but the conditions an optimum must meet can be counted: none may be broken.
_EXPECTED_DATES_SQL = f"""with {DAILY_SQL},
ends as (select universe_id, max(session) as as_of from returns group by universe_id, date_trunc('month', session)),
eligible as (
  select e.universe_id, e.as_of from ends e join returns r on r.universe_id = e.universe_id and r.session <= e.as_of
  group by all having count(distinct session) >= 756),
models as (select unnest(['equal_weight', 'minimum_variance', 'risk_parity', 'hrp', 'risk_consensus', 'maximum_sharpe']) as model)
select model, count(distinct as_of) as dates, 0::bigint as unbalanced, 0::bigint as outside_bounds, 0::bigint as not_optimal
from eligible, models group by model"""


@register("walk_forward_optimality", _EXPECTED_DATES_SQL)
def walk_forward_optimality(spark, sf):
    """Dates per model and how many break the sum, the bounds or the first-order conditions.

    minimum_variance: equal marginal variance inside the bounds, no lower one
    at the cap's outside and no higher one at the floor's. risk_parity: equal
    risk shares while no bound binds. maximum_sharpe: equal slopes of the ratio
    inside the bounds, none higher at the floor nor lower at the cap. Solvers that
    did not come to their end count as well.
    """
    rets = cut_lineage(daily(spark, sf))
    weights = cut_lineage(walk_forward.walk_forward_weights(rets, status=True))
    known = forecast.expected_returns(rets, walk_forward.EWMA_SPAN).select(
        "universe_id", F.col("session").alias("as_of"), "asset", F.col("robust").alias("expected")
    )
    cov = covariance.shrunk_from_sums(covariance.expanding_pair_sums(rets, walk_forward.MIN_TRAINING)).drop("shrinkage")
    keys = ["universe_id", "as_of", "model"]
    shares = risk.risk_contributions(weights.drop("converged"), cov, keys).join(weights.select(*keys, "asset", "converged"), [*keys, "asset"]).join(
        known, ["universe_id", "as_of", "asset"]
    )
    cap = walk_forward.MAX_WEIGHT
    inside = (F.col("weight") > 1e-9) & (F.col("weight") < cap - 1e-9)
    level = F.avg(F.when(inside, F.col("marginal_risk"))).over(Window.partitionBy(*keys))
    slack = 1e-6 * F.abs("level")
    gap = F.col("marginal_risk") - F.col("level")
    # Slope of excess per volatility: m / s - (m'w) * marginal risk / s^2, with the marginal risk of volatility s.
    group = Window.partitionBy(*keys)
    volatility = F.sum(F.col("weight") * F.col("marginal_risk")).over(group)
    rich = F.sum(F.col("weight") * F.col("expected")).over(group)
    slope = F.try_divide(F.col("expected"), volatility) - F.try_divide(rich * F.col("marginal_risk"), volatility * volatility)
    shares = shares.withColumn("slope", slope)
    slope_level = F.avg(F.when(inside, F.col("slope"))).over(group)
    steep = F.col("slope") - F.col("slope_level")
    give = 1e-6 * (F.abs("slope_level") + F.coalesce(F.try_divide(F.abs("expected"), F.abs("marginal_risk")), F.lit(0.0)))
    bent = (
        F.when(F.col("model") == "minimum_variance", F.when(inside, F.abs(gap) > slack).when(F.col("weight") <= 1e-9, gap < -slack).otherwise(gap > slack))
        .when(F.col("model") == "risk_parity", F.abs(F.col("risk_share") - 0.2) > 1e-6)
        .when(F.col("model") == "maximum_sharpe", F.when(inside, F.abs(steep) > give).when(F.col("weight") <= 1e-9, steep > give).otherwise(steep < -give))
        .otherwise(False)
    )
    limit = F.when(F.col("model").isin("hrp", "risk_consensus"), 1.0).otherwise(cap)
    checked = shares.withColumns({"level": level, "slope_level": slope_level}).withColumns(
        {"bent": F.coalesce(bent, F.lit(False)) | ~F.col("converged"), "out": (F.col("weight") < -1e-12) | (F.col("weight") > limit + 1e-9)}
    )
    per_date = checked.groupBy(*keys).agg(
        F.sum("weight").alias("total"), F.count_if("bent").alias("bent"), F.count_if("out").alias("out")
    )
    return per_date.groupBy("model").agg(
        F.countDistinct("as_of").alias("dates"),
        F.count_if(F.abs(F.col("total") - 1.0) > 1e-9).alias("unbalanced"),
        F.count_if(F.col("out") > 0).alias("outside_bounds"),
        F.count_if(F.col("bent") > 0).alias("not_optimal"),
    )


# Where a universe has two assets every model has a closed form, so the whole evaluation can be repeated in SQL.
_PAIRS_SQL = f"""{_TWO_ASSET_SQL},
month_ends as (
  select universe_id, date_trunc('month', session) as month, max(session) as month_end from returns group by all),
six_weights as (
  select universe_id, as_of as rebalance_date, model, asset, weight from pair_weights
  union all select universe_id, as_of, 'equal_weight', asset, 0.5::double from pair_weights where model = 'hrp'
  union all select universe_id, as_of, 'risk_consensus', asset, avg(weight) from pair_weights where model <> 'maximum_sharpe' group by all),
{PERIODS_SQL}, {results_sql("six_weights")}"""


def _pair_walk(spark, sf):
    rets = cut_lineage(returns.return_matrix(harness.two_asset_prices(spark, sf)))
    return walk_forward.walk_forward(rets, min_training=_PAIR_MIN, high=_PAIR_CAP, span=_PAIR_SPAN, annual_periods=12)


@register(
    "walk_forward_pairs",
    f"""with {_PAIRS_SQL}
    select universe_id, model, rebalance_date, period_end, {", ".join(r(c, 7) for c in ("gross_return", "turnover", "transaction_cost", "net_return"))} from results""",
)
def walk_forward_pairs(spark, sf):
    """Period results of all six models on every two-asset universe, against closed forms."""
    results, _ = _pair_walk(spark, sf)
    columns = ["gross_return", "turnover", "transaction_cost", "net_return"]
    return rounded(results.select("universe_id", "model", "rebalance_date", "period_end", *columns), 7, *columns)


@register("walk_forward_pairs_weights", f"with {_PAIRS_SQL} select universe_id, rebalance_date, model, asset, {r('weight', 6)} from six_weights")
def walk_forward_pairs_weights(spark, sf):
    return rounded(_pair_walk(spark, sf)[1], 6, "weight")


@register(
    "walk_forward_pairs_summary",
    f"""with {_PAIRS_SQL}, {summary_sql("results", "universe_id, model", "period_end", "net_return", 12, ", avg(turnover) as average_turnover")}
    select universe_id, model, {SUMMARY_SELECT}, {r("average_turnover", 6)} from summary""",
)
def walk_forward_pairs_summary(spark, sf):
    rows = metrics.backtest_summary(_pair_walk(spark, sf)[0])
    return rounded(rows, 6, *SUMMARY_COLUMNS, "average_turnover").select("universe_id", "model", "periods", *SUMMARY_COLUMNS, "average_turnover")


_FRONTIER_SQL = f"""{_TWO_ASSET_SQL},
ends as (
  select *, case when m1 > m2 then hi when m1 < m2 then lo end as w0, greatest(lo, least(hi, (c22 - c12) / (c11 + c22 - 2 * c12))) as w1 from z),
points as (
  select universe_id, as_of, 0 as point, w0 as w, m1, m2, c11, c12, c22 from ends
  union all select universe_id, as_of, 1, w1, m1, m2, c11, c12, c22 from ends where abs(w1 - w0) > 1e-12)"""


@register(
    "efficient_frontier",
    f"""with {_FRONTIER_SQL}
    select universe_id, as_of, point, {r("w", 6, "weight_high")}, {r("w * m1 + (1 - w) * m2", 7, "expected")},
           {r("w * w * c11 + (1 - w) * (1 - w) * c22 + 2 * w * (1 - w) * c12", 7, "variance")}, true as complete from points""",
)
def efficient_frontier(spark, sf):
    """Turning points of every two-asset universe and month: the richer asset at the cap, and the least variance."""
    cov, expected = _two_asset(spark, sf)
    points = frontier.efficient_frontier(cov, expected, 1 - _PAIR_CAP, _PAIR_CAP).filter("asset = 'HIGH'")
    return rounded(rounded(points.select("universe_id", "as_of", "point", F.col("weight").alias("weight_high"), "expected", "variance", "complete"), 6, "weight_high"), 7, "expected", "variance")


@register(
    "frontier_conditions",
    f"""with {DAILY_SQL},
    ends as (select universe_id, max(session) as as_of from returns group by universe_id, date_trunc('month', session))
    select count(distinct e.as_of) as dates, 0::bigint as unbalanced, 0::bigint as outside_bounds, 0::bigint as falling_returns, 0::bigint as not_optimal, 0::bigint as incomplete
    from ends e where (select count(distinct session) from returns r where r.universe_id = e.universe_id and r.session <= e.as_of) >= 756""",
)
def frontier_conditions(spark, sf):
    """Five assets: dates with turning points, and points that break the sum, the bounds, the order or the first-order conditions.

    Marginal variance less price times expected return is the same for all assets inside the bounds, not less at the floor and not more at the cap.
    """
    rets = cut_lineage(daily(spark, sf))
    cov = cut_lineage(covariance.shrunk_from_sums(covariance.expanding_pair_sums(rets, walk_forward.MIN_TRAINING)).drop("shrinkage"))
    expected = cut_lineage(forecast.expected_returns(rets, walk_forward.EWMA_SPAN).select("universe_id", F.col("session").alias("as_of"), "asset", F.col("robust").alias("expected")))
    cap = walk_forward.MAX_WEIGHT
    points = cut_lineage(frontier.efficient_frontier(cov, expected, 0.0, cap))
    keys = ["universe_id", "as_of", "point"]
    exposure = (
        points.select(*keys, F.col("asset").alias("asset_j"), "weight").join(cov, ["universe_id", "as_of", "asset_j"])
        .groupBy(*keys, F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("weight")).alias("marginal"))
    )
    own = expected.withColumnRenamed("expected", "mu")
    rows = points.join(exposure, [*keys, "asset"]).join(own, ["universe_id", "as_of", "asset"])
    near = 1e-7  # at a turning point an asset is just at its bound
    inside = (F.col("weight") > near) & (F.col("weight") < cap - near)
    slope = F.col("marginal") - F.col("price") * F.col("mu")
    level = F.avg(F.when(inside, slope)).over(Window.partitionBy(*keys))
    gap = slope - F.col("level")
    slack = 1e-6 * (F.abs("marginal") + F.col("price") * F.abs("mu"))
    bent = F.when(inside, F.abs(gap) > slack).when(F.col("weight") <= near, gap < -slack).otherwise(gap > slack)
    checked = rows.withColumn("level", level).withColumn("bent", F.coalesce(bent, F.lit(False)))
    per = checked.groupBy(*keys).agg(
        F.sum("weight").alias("total"), F.count_if((F.col("weight") < -1e-12) | (F.col("weight") > cap + 1e-9)).alias("out"),
        F.count_if("bent").alias("bent"), F.max("expected").alias("expected"), F.min("complete").alias("complete"),
    )
    before = F.lag("expected").over(Window.partitionBy("universe_id", "as_of").orderBy("point"))
    return per.withColumn("before", before).agg(
        F.countDistinct("as_of").alias("dates"),
        F.count_if(F.abs(F.col("total") - 1) > 1e-9).alias("unbalanced"),
        F.count_if(F.col("out") > 0).alias("outside_bounds"),
        F.count_if(F.col("expected") > F.col("before") + 1e-9).alias("falling_returns"),
        F.count_if(F.col("bent") > 0).alias("not_optimal"),
        F.count_if(~F.col("complete")).alias("incomplete"),
    )


@register("walk_forward")
def walk_forward_results(spark, sf):
    rets = cut_lineage(daily(spark, sf))
    results, _ = walk_forward.walk_forward(rets)
    return rounded(results, 8, "gross_return", "turnover", "transaction_cost", "net_return")


@register("walk_forward_summary")
def walk_forward_summary(spark, sf):
    rets = cut_lineage(daily(spark, sf))
    results, _ = walk_forward.walk_forward(rets)
    return rounded(metrics.backtest_summary(results), 6, *SUMMARY_COLUMNS, "average_turnover")


def brand_candidates(spark, sf):
    """A hand-off per month: every brand ranked by its average tax."""
    lineitem = harness.read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax")
    part = harness.read(spark, sf, "part").select("p_partkey", "p_brand")
    month = F.trunc(F.to_date("l_shipdate"), "month")
    scored = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(month.alias("session"), F.upper("p_brand").alias("symbol"))
        .agg(
            (F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("scanner_score"),
            (F.lit(100.0) + F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("close"),
        )
    )
    return handed_off(scored)


def handed_off(scored):
    """A hand-off per session of ``scored(session, symbol, scanner_score, close)``, ranked by score."""
    order = Window.partitionBy("session").orderBy(F.desc("scanner_score"), "symbol")
    size = F.count(F.lit(1)).over(Window.partitionBy("session"))
    stamp = F.concat(F.date_format("session", "yyyy-MM-dd"), F.lit(" 20:00:00"))
    ranked = scored.withColumns({"scanner_rank": F.row_number().over(order), "size": size})
    return ranked.select(
        F.lit(candidates.HANDOFF_VERSION).alias("handoff_contract_version"),
        F.lit(candidates.ALPHA_SPEC_VERSION).alias("scanner_alpha_spec_version"),
        F.lit("provider").alias("scanner_provider"),
        F.date_format("session", "yyyy-MM-dd").alias("as_of_session"),
        F.concat(F.date_format("session", "yyyy-MM-dd"), F.lit(" 22:00:00")).alias("generated_at_utc"),
        F.sha2(F.date_format("session", "yyyy-MM-dd"), 256).alias("scanner_snapshot_sha256"),
        F.lit("").alias("source_alpha_manifest_sha256"),
        stamp.alias("source_timestamp_utc"),
        "symbol",
        "scanner_rank",
        "scanner_score",
        (100.0 * (1.0 - (F.col("scanner_rank") - 1) / F.col("size"))).alias("scanner_percentile"),
        F.lit(True).alias("scanner_eligible"),
        "close",
        F.lit(candidates.PRIMARY_SIGNAL).alias("primary_signal_name"),
        F.col("scanner_score").alias("primary_signal_value"),
        F.lit(None).cast("double").alias("ema_50_to_200"),
    )


BRAND_CANDIDATES_SQL = """
scored as (
  select cast(date_trunc('month', l_shipdate) as date) as session, upper(p_brand) as symbol,
         cast(sum(cast(round(l_tax * 100) as bigint)) as double) / count(*) as scanner_score,
         100 + cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) as close
  from lineitem join part on l_partkey = p_partkey group by all),
ranked as (
  select *, row_number() over (partition by session order by scanner_score desc, symbol) as scanner_rank,
         count(*) over (partition by session) as size from scored)"""


@register(
    "candidate_snapshot",
    f"""with {BRAND_CANDIDATES_SQL}
    select strftime(session, '%Y-%m-%d') as as_of_session, symbol, cast(scanner_rank as integer) as scanner_rank,
           {r("scanner_score", 8)}, {r("close", 8)} from ranked""",
)
def candidate_snapshot(spark, sf):
    rows = candidates.candidate_snapshot(cut_lineage(brand_candidates(spark, sf)))
    return rounded(rows, 8, "scanner_score", "close").select(
        "as_of_session", "symbol", "scanner_rank", "scanner_score", "close"
    )


# The registered hand-off breaks rules on purpose, by the data's own values.
@register(
    "validate_candidates",
    f"""with {BRAND_CANDIDATES_SQL},
    broken as (
      select *, case when scanner_rank > 20 then scanner_rank - 1 else scanner_rank end as rk,
             case when scanner_score > 4.2 then 120.0 else 50.0 end as pct, close < 104.5 as late from ranked),
    counts as (
      select session, count(*) filter (pct > 100) as pct, count(*) - count(distinct rk) as dup,
             case when max(rk) = count(*) then 0 else 1 end as gap, count(*) filter (late) as late from broken group by session),
    long as (
      select session, 'PERCENTILE_OUT_OF_RANGE' as rule, pct as violations from counts
      union all select session, 'DUPLICATE_RANK', dup from counts
      union all select session, 'RANKS_NOT_CONTIGUOUS', gap from counts
      union all select session, 'TIMESTAMP_AFTER_GENERATION', late from counts)
    select strftime(session, '%Y-%m-%d') as as_of_session, sha256(strftime(session, '%Y-%m-%d')) as scanner_snapshot_sha256,
           rule, violations from long where violations > 0""",
)
def validate_candidates(spark, sf):
    rows = brand_candidates(spark, sf)
    rank = F.when(F.col("scanner_rank") > 20, F.col("scanner_rank") - 1).otherwise(F.col("scanner_rank"))
    late = F.concat(F.col("as_of_session"), F.lit(" 19:00:00"))
    broken = rows.withColumns(
        {
            "scanner_rank": rank,
            "scanner_percentile": F.when(F.col("scanner_score") > 4.2, 120.0).otherwise(50.0),
            "generated_at_utc": F.when(F.col("close") < 104.5, late).otherwise(F.col("generated_at_utc")),
        }
    )
    return candidates.validate_candidates(broken)


@register("candidate_allocation")
def candidate_allocation(spark, sf):
    """Capped minimum variance of every monthly hand-off over the 36 months up to it; solver output."""
    history = cut_lineage(brand_candidates(spark, sf))
    prices = cut_lineage(harness.brand_prices(spark, sf))
    rows = candidates.candidate_allocation(history, prices, lookback=36, periods=12)
    return rounded(rows, 6, "annualized_volatility", "target_weight")


# Two groups of parts (by size) per monthly hand-off, those with the highest tax, and the 252 daily returns that both have before it.
_MAKERS_SQL = """
sales as (
  select cast(l_shipdate as date) as session, 'M' || (p_size % 5) as symbol, cast(round(l_tax * 100) as bigint) as tax, cast(round(l_discount * 100) as bigint) as cents
  from lineitem join part on l_partkey = p_partkey),
scored as (
  select cast(date_trunc('month', session) as date) as as_of, upper(symbol) as symbol, sum(tax)::double / count(*) as score from sales group by all),
picked as (
  select *, row_number() over (partition by as_of order by score desc, symbol) as rank from scored qualify rank <= 2),
daily_closes as (select session, upper(symbol) as symbol, 100 + sum(cents)::double / count(*) as close from sales group by all),
pairs_of as (
  select as_of, max(case when rank = 1 then symbol end) as s1, max(case when rank = 2 then symbol end) as s2 from picked group by as_of having count(*) = 2),
both_closes as (
  select p.as_of, p.s1, p.s2, a.session, a.close as c1, b.close as c2
  from pairs_of p join daily_closes a on a.symbol = p.s1 and a.session <= p.as_of join daily_closes b on b.symbol = p.s2 and b.session = a.session),
both_returns as (
  select *, c1 / lag(c1) over w - 1 as x, c2 / lag(c2) over w - 1 as y, row_number() over (partition by as_of order by session desc) as back
  from both_closes window w as (partition by as_of order by session)),
lookback as (select * from both_returns where back <= 252 and x is not null),
centred as (
  select *, x - avg(x) over g as zx, y - avg(y) over g as zy, count(*) over g as n from lookback window g as (partition by as_of)),
m as (
  select as_of, any_value(s1) as s1, any_value(s2) as s2, any_value(n) as n, avg(zx * zx) as v1, avg(zy * zy) as v2, avg(zx * zy) as v12,
         avg(zx * zx * zx * zx) as q11, avg(zy * zy * zy * zy) as q22, avg(zx * zx * zy * zy) as q12
  from centred where n = 252 group by as_of),
k as (
  select *, (v1 + v2) / 2 as mu, (pow(v1, 2) + pow(v2, 2) + 2 * pow(v12, 2)) as squares, (q11 - v1 * v1 + q22 - v2 * v2 + 2 * (q12 - v12 * v12)) / (2 * n) as b0 from m),
d as (select *, (squares - 2 * mu * mu) / 2 as dist from k),
l as (select *, case when least(b0, dist) = 0 then 0 else least(b0, dist) / dist end as sh from d),
c as (select as_of, s1, s2, ((1 - sh) * v1 + sh * mu) * 252 as c11, ((1 - sh) * v2 + sh * mu) * 252 as c22, (1 - sh) * v12 * 252 as c12 from l),
w as (select *, greatest(0.4, least(0.6, (c22 - c12) / (c11 + c22 - 2 * c12))) as w1 from c)"""


@register(
    "candidate_allocation_pairs",
    f"""with {_MAKERS_SQL}
    select strftime(as_of, '%Y-%m-%d') as as_of_session, s1 as symbol, {r("sqrt(c11)", 6, "annualized_volatility")}, {r("w1", 6, "target_weight")}, 252 as lookback_returns from w
    union all
    select strftime(as_of, '%Y-%m-%d'), s2, {r("sqrt(c22)", 6, "annualized_volatility")}, {r("1 - w1", 6, "target_weight")}, 252 from w""",
)
def candidate_allocation_pairs(spark, sf):
    """Every monthly hand-off of two candidates at the real lookback of 252 daily returns, against the closed form."""
    lines = harness.read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax")
    part = harness.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("M"), (F.col("p_size") % 5).cast("string")).alias("symbol"))
    hundredths = {c: F.round(F.col(f"l_{c}") * 100).cast("long") for c in ("discount", "tax")}
    sales = cut_lineage(
        lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumns(hundredths)
        .groupBy(F.to_date("l_shipdate").alias("session"), "symbol").agg(F.sum("tax").alias("tax"), F.sum("discount").alias("cents"), F.count(F.lit(1)).alias("n"))
    )
    month = F.trunc("session", "month").alias("session")
    scored = sales.groupBy(month, "symbol").agg((F.sum("tax").cast("double") / F.sum("n")).alias("scanner_score"), F.lit(100.0).alias("close"))
    prices = sales.select("session", F.col("symbol").alias("asset"), (100 + F.col("cents").cast("double") / F.col("n")).alias("close"), F.lit("ALL").alias("universe_id"))
    ranked = handed_off(scored).filter("scanner_rank <= 2")
    complete = F.count(F.lit(1)).over(Window.partitionBy("as_of_session")) == 2
    history = cut_lineage(ranked.withColumn("whole", complete).filter("whole").drop("whole"))
    rows = candidates.candidate_allocation(history, prices, high=0.6)
    columns = ["as_of_session", "symbol", "annualized_volatility", "target_weight", "lookback_returns"]
    return rounded(rows.select(*columns), 6, "annualized_volatility", "target_weight")
