"""Queries on ridge forecasts, model selection and its diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import metrics, periods, ridge, selection
from tidemark.plans.catalog import register
from tidemark.plans.common import (
    SUMMARY_COLUMNS,
    SUMMARY_SELECT,
    r,
    results_sql,
    rounded,
    rule_tables,
    summary_sql,
)
from tidemark.plans.labels import LEARNING_SQL, learning_table
from tidemark.plans.market_features import FEATURES, feature_matrix
from tidemark.session import cut_lineage

CANDIDATES = ["inverse_variance", "low_risk", "price_weight"]
SETS = {
    "momentum": ["AUTOMOBILE_return_63d", "average_pairwise_corr_63d"],
    "dispersion": ["BUILDING_return_63d", "cross_asset_return_dispersion_63d"],
}


def _targets(models=CANDIDATES):
    return [f"{m}_excess_vs_equal_weight" for m in models]


def forecasts(design, features, purged=True, models=CANDIDATES):
    """Long forecasts per candidate with the model name in place of the target column."""
    rows = ridge.predictions(design, features, _targets(models), purged=purged)
    return rows.withColumn("model", F.regexp_replace("target", "_excess_vs_equal_weight$", "")).drop("target")


# Two standardised features make the penalised normal equations a 2 x 2 system.
def forecast_sql(name: str, features: list[str], purged: bool = True, models=CANDIDATES) -> str:
    a, b = features
    past = "t.horizon_end < d.rebalance_date" if purged else "t.rebalance_date < d.rebalance_date"
    targets = " union all ".join(
        f"select universe_id, rebalance_date, horizon_end, '{m}' as model, {a} as x1, {b} as x2, "
        f"{m}_excess_vs_equal_weight as y from learning"
        for m in models
    )
    return f"""
{name}_long as ({targets}),
{name}_fit as (
  select d.universe_id, d.rebalance_date, d.model, any_value(d.x1) as x1, any_value(d.x2) as x2, any_value(d.y) as actual,
         count(*) as n, avg(t.x1) as m1, avg(t.x2) as m2, avg(t.y) as my, stddev_pop(t.x1) as s1, stddev_pop(t.x2) as s2,
         covar_pop(t.x1, t.x2) / (stddev_pop(t.x1) * stddev_pop(t.x2)) as rho,
         covar_pop(t.x1, t.y) / stddev_pop(t.x1) as c1, covar_pop(t.x2, t.y) / stddev_pop(t.x2) as c2
  from {name}_long d join {name}_long t on t.universe_id = d.universe_id and t.model = d.model and {past}
  group by d.universe_id, d.rebalance_date, d.model having count(*) >= 36),
{name}_forecast as (
  select universe_id, rebalance_date, model, n as training_labels, actual,
         my + ((n + 10) * n * c1 - n * rho * n * c2) / (pow(n + 10, 2) - pow(n * rho, 2)) * (x1 - m1) / s1
            + ((n + 10) * n * c2 - n * rho * n * c1) / (pow(n + 10, 2) - pow(n * rho, 2)) * (x2 - m2) / s2 as predicted
  from {name}_fit)"""


def select_sql(forecast: str, name: str, extra: str = "") -> str:
    keys = f"universe_id, rebalance_date{extra}"
    return f"""
{name}_best as (
  select {keys}, arg_max(model, predicted) as top, max(predicted) as p, arg_max(actual, predicted) as a
  from {forecast} group by {keys}),
{name} as (
  select {", ".join("b." + k.strip() for k in keys.split(","))}, case when p > 0 then top else 'equal_weight' end as selected_model,
         case when p > 0 then p else 0 end as selected_predicted_excess,
         case when p > 0 then a else 0 end as selected_realized_excess,
         l.equal_weight_forward_return, l.best_model as actual_best_model,
         l.equal_weight_forward_return + case when p > 0 then a else 0 end as selected_forward_return
  from {name}_best b join learning l using (universe_id, rebalance_date))"""


_FORECAST = f"with {LEARNING_SQL}, {forecast_sql('f', SETS['momentum'])}"
_SELECTED = f"{_FORECAST}, {select_sql('f_forecast', 'selected')}"


def _forecast(spark, sf, results=None, rets=None):
    design = learning_table(spark, sf, results, rets)
    return design, cut_lineage(forecasts(design, SETS["momentum"]))


def _selected(spark, sf, results=None, rets=None):
    design, rows = _forecast(spark, sf, results, rets)
    return rows, selection.select_models(rows, design, CANDIDATES)


@register(
    "ridge_walk_forward",
    f"""with {LEARNING_SQL}, {forecast_sql("f", SETS["momentum"], purged=False)}
    select universe_id, rebalance_date, model, training_labels, {r("predicted", 8)}, {r("actual", 8)} from f_forecast""",
)
def ridge_walk_forward(spark, sf):
    return rounded(forecasts(learning_table(spark, sf), SETS["momentum"], purged=False), 8, "predicted", "actual")


@register(
    "ridge_purged",
    f"""{_FORECAST}
    select universe_id, rebalance_date, model, training_labels, {r("predicted", 8)}, {r("actual", 8)} from f_forecast""",
)
def ridge_purged(spark, sf):
    return rounded(_forecast(spark, sf)[1], 8, "predicted", "actual")


@register("ridge_purged_all_features")
def ridge_purged_all_features(spark, sf):
    """The same purged fit on the whole feature matrix; no closed form, so no SQL."""
    return rounded(forecasts(learning_table(spark, sf), FEATURES), 8, "predicted", "actual")


_GATE = ["inverse_variance"]


@register(
    "binary_gate",
    f"""with {LEARNING_SQL}, {forecast_sql("f", SETS["momentum"], models=_GATE)}, {select_sql("f_forecast", "gate")}
    select universe_id, rebalance_date, selected_model, {r("selected_predicted_excess", 8)},
           {r("selected_realized_excess", 8)} from gate""",
)
def binary_gate(spark, sf):
    design = learning_table(spark, sf)
    rows = selection.select_models(forecasts(design, SETS["momentum"], models=_GATE), design, _GATE)
    columns = ["selected_predicted_excess", "selected_realized_excess"]
    return rounded(rows, 8, *columns).select("universe_id", "rebalance_date", "selected_model", *columns)


_SELECTION = [
    "selected_predicted_excess", "selected_realized_excess", "selected_forward_return", "equal_weight_forward_return",
]


@register(
    "model_selection",
    f"""{_SELECTED}
    select universe_id, rebalance_date, selected_model, actual_best_model, {", ".join(r(c, 8) for c in _SELECTION)}
    from selected""",
)
def model_selection(spark, sf):
    return rounded(_selected(spark, sf)[1], 8, *_SELECTION)


_PREDICTION = ["mae", "rmse", "correlation", "directional_accuracy"]
_PREDICTION_SQL = """count(*) as observations, avg(abs(predicted - actual)) as mae,
    sqrt(avg(pow(predicted - actual, 2))) as rmse, corr(predicted, actual) as correlation,
    avg((sign(predicted) = sign(actual))::double) as directional_accuracy"""


@register(
    "prediction_metrics",
    f"""{_FORECAST}, m as (select universe_id, model, {_PREDICTION_SQL} from f_forecast group by universe_id, model)
    select universe_id, model, observations, {", ".join(r(c, 6) for c in _PREDICTION)} from m""",
)
def prediction_metrics(spark, sf):
    rows = selection.prediction_metrics(_forecast(spark, sf)[1], ["universe_id", "model"])
    return rounded(rows, 6, *_PREDICTION)


def ic_sql(source: str, keys: str, name: str) -> str:
    return f"""
{name}_ranked as (
  select *, rank() over (partition by {keys} order by predicted) + (count(*) over (partition by {keys}, predicted) - 1) / 2.0 as rp,
         rank() over (partition by {keys} order by actual) + (count(*) over (partition by {keys}, actual) - 1) / 2.0 as ra
  from {source}),
{name} as (select {keys}, corr(predicted, actual) as pearson_ic, corr(rp, ra) as spearman_ic from {name}_ranked group by {keys})"""


@register(
    "information_coefficients",
    f"""{_FORECAST}, {ic_sql("f_forecast", "universe_id, model", "ic")}
    select universe_id, model, {r("pearson_ic", 6)}, {r("spearman_ic", 6)} from ic""",
)
def information_coefficients(spark, sf):
    rows = selection.information_coefficients(_forecast(spark, sf)[1], ["universe_id", "model"])
    return rounded(rows, 6, "pearson_ic", "spearman_ic")


_CALIBRATION = ["mean_predicted_excess", "mean_realized_excess", "positive_realized_rate"]


@register(
    "calibration_buckets",
    f"""{_FORECAST},
    k as (
      select *, row_number() over (partition by universe_id, model order by predicted, rebalance_date) as rk,
             count(*) over (partition by universe_id, model) as n from f_forecast),
    b as (select *, greatest(1, cast(ceil((rk - 1) * 4 / (n - 1)) as integer)) as bucket from k)
    select universe_id, model, bucket, count(*) as observations, {r("avg(predicted)", 8, "mean_predicted_excess")},
           {r("avg(actual)", 8, "mean_realized_excess")}, {r("avg((actual > 0)::double)", 8, "positive_realized_rate")}
    from b group by universe_id, model, bucket""",
)
def calibration_buckets(spark, sf):
    return rounded(selection.calibration_buckets(_forecast(spark, sf)[1], ["universe_id", "model"]), 8, *_CALIBRATION)


@register(
    "sign_diagnostics",
    f"""{_FORECAST},
    s as (select *, case when predicted > 0 then 'predicted_positive' else 'predicted_nonpositive' end as signal from f_forecast)
    select universe_id, model, signal, count(*) as observations, {r("avg(actual)", 8, "mean_realized_excess")},
           {r("median(actual)", 8, "median_realized_excess")},
           {r("avg((actual > 0)::double)", 8, "positive_realized_rate")}
    from s group by universe_id, model, signal""",
)
def sign_diagnostics(spark, sf):
    rows = selection.sign_diagnostics(_forecast(spark, sf)[1], ["universe_id", "model"])
    return rounded(rows, 8, "mean_realized_excess", "median_realized_excess", "positive_realized_rate")


_METRICS = [
    "selection_accuracy", "positive_excess_rate", "active_positive_rate", "average_selected_excess",
    "proxy_total_return", "equal_weight_total_return", "proxy_excess_growth",
]


@register(
    "selection_metrics",
    f"""{_SELECTED}
    select universe_id, count(*) as periods, {r("avg((selected_model = actual_best_model)::double)", 8, "selection_accuracy")},
      {r("avg((selected_realized_excess > 0)::double)", 8, "positive_excess_rate")},
      {r("avg(case when selected_model <> 'equal_weight' then (selected_realized_excess > 0)::double end)", 8, "active_positive_rate")},
      {r("avg(selected_realized_excess)", 8, "average_selected_excess")},
      {r("product(1 + selected_forward_return) - 1", 8, "proxy_total_return")},
      {r("product(1 + equal_weight_forward_return) - 1", 8, "equal_weight_total_return")},
      {r("product(1 + selected_forward_return) / product(1 + equal_weight_forward_return) - 1", 8, "proxy_excess_growth")}
    from selected group by universe_id""",
)
def selection_metrics(spark, sf):
    return rounded(selection.selection_metrics(_selected(spark, sf)[1]), 8, *_METRICS)


@register(
    "strategy_benchmarks",
    f"""{_SELECTED},
    statics as (
      select universe_id, rebalance_date, f.model as strategy, s.equal_weight_forward_return + f.actual as ret
      from f_forecast f join selected s using (universe_id, rebalance_date)
      union all select universe_id, rebalance_date, 'equal_weight', equal_weight_forward_return from selected),
    every as (
      select * from statics
      union all select universe_id, rebalance_date, 'selector_proxy', selected_forward_return from selected
      union all select universe_id, rebalance_date, 'oracle_best', max(ret) from statics group by all),
    {summary_sql("every", "universe_id, strategy", "rebalance_date", "ret")}
    select universe_id, strategy, {SUMMARY_SELECT} from summary""",
)
def strategy_benchmarks(spark, sf):
    rows, chosen = _selected(spark, sf)
    return rounded(selection.strategy_benchmarks(cut_lineage(chosen), rows), 6, *SUMMARY_COLUMNS)


@register(
    "confusion_table",
    f"""{_SELECTED}
    select coalesce(actual_best_model, 'All') as actual_best_model, coalesce(selected_model, 'All') as selected_model,
           count(*) as n from selected group by cube (actual_best_model, selected_model)""",
)
def confusion_table(spark, sf):
    return selection.confusion_table(_selected(spark, sf)[1])


_SETS_SQL = f"""with {LEARNING_SQL}, {", ".join(forecast_sql(n, cols) for n, cols in SETS.items())},
all_forecasts as ({" union all ".join(f"select '{n}' as feature_set, * from {n}_forecast" for n in SETS)})"""


def _set_forecasts(spark, sf):
    design = learning_table(spark, sf)
    parts = [forecasts(design, cols).withColumn("feature_set", F.lit(n)) for n, cols in SETS.items()]
    return design, cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))


_DIAGNOSTICS = [
    "mae", "rmse", "directional_accuracy", "pearson_ic", "spearman_ic", "mean_realized_excess_when_positive",
    "positive_prediction_win_rate",
]


@register(
    "feature_set_diagnostics",
    f"""{_SETS_SQL}, {ic_sql("all_forecasts", "feature_set, universe_id, model", "ic")},
    m as (
      select feature_set, universe_id, model, {_PREDICTION_SQL}, count(*) filter (predicted > 0) as predicted_positive_count,
             avg(actual) filter (predicted > 0) as mean_realized_excess_when_positive,
             avg((actual > 0)::double) filter (predicted > 0) as positive_prediction_win_rate
      from all_forecasts group by feature_set, universe_id, model)
    select feature_set, universe_id, model, observations, predicted_positive_count, {", ".join(r(c, 6) for c in _DIAGNOSTICS)}
    from m join ic using (feature_set, universe_id, model)""",
)
def feature_set_diagnostics(spark, sf):
    rows = selection.feature_set_diagnostics(_set_forecasts(spark, sf)[1], ["feature_set", "universe_id", "model"])
    return rounded(rows, 6, *_DIAGNOSTICS)


_SUMMARY = [
    "selection_accuracy", "active_rate", "active_win_rate", "mean_active_excess", "mean_selected_excess",
    "median_selected_excess",
]


@register(
    "selector_summary",
    f"""{_SETS_SQL}, {select_sql("all_forecasts", "chosen", ", feature_set")}
    select feature_set, universe_id, count(*) as oos_predictions, min(rebalance_date) as first_prediction,
      max(rebalance_date) as last_prediction, {r("avg((selected_model = actual_best_model)::double)", 8, "selection_accuracy")},
      {r("avg((selected_model <> 'equal_weight')::double)", 8, "active_rate")},
      {r("avg((selected_realized_excess > 0)::double) filter (selected_model <> 'equal_weight')", 8, "active_win_rate")},
      {r("avg(selected_realized_excess) filter (selected_model <> 'equal_weight')", 8, "mean_active_excess")},
      {r("avg(selected_realized_excess)", 8, "mean_selected_excess")},
      {r("median(selected_realized_excess)", 8, "median_selected_excess")}
    from chosen group by feature_set, universe_id""",
)
def selector_summary(spark, sf):
    design, rows = _set_forecasts(spark, sf)
    keys = ["universe_id", "rebalance_date", "feature_set"]
    chosen = selection.select_models(rows, design, CANDIDATES, keys=keys)
    return rounded(selection.selector_summary(chosen, ["feature_set", "universe_id"]), 8, *_SUMMARY)


@register(
    "selection_frequency",
    f"""{_SELECTED},
    names as (select unnest(['equal_weight', 'inverse_variance', 'low_risk', 'price_weight', 'unused']) as model)
    select u.universe_id, n.model, count(s.selected_model) as selections
    from (select distinct universe_id from selected) u cross join names n
    left join selected s on s.universe_id = u.universe_id and s.selected_model = n.model group by all""",
)
def selection_frequency(spark, sf):
    return selection.selection_frequency(_selected(spark, sf)[1], ["equal_weight", *CANDIDATES, "unused"])


_PHASES_SQL = f"""{_SELECTED},
numbered as (select *, row_number() over (partition by universe_id order by rebalance_date) as row from selected),
decisions as (
  select universe_id, p.phase, rebalance_date as decision_date, selected_model
  from numbered, (values (0), (1), (2)) p(phase) where row > phase and (row - 1 - phase) % 3 = 0),
dated as (
  select *, row_number() over (partition by universe_id order by rebalance_date) as no
  from (select distinct universe_id, rebalance_date from results)),
slots as (
  select d.*, x.rebalance_date, row_number() over (partition by d.universe_id, d.phase, d.decision_date order by x.no) as k
  from decisions d join dated x on x.universe_id = d.universe_id and x.rebalance_date >= d.decision_date),
assignments as (
  select * from (
    select *, count(*) over (partition by universe_id, phase, decision_date) as n from slots where k <= 3) where n = 3),
phase_weights as (
  select universe_id, 'selector#' || phase as model, rebalance_date, asset, weight
  from assignments a join model_weights w using (universe_id, rebalance_date) where w.model = a.selected_model
  union all
  select universe_id, w.model || '#' || phase, rebalance_date, asset, weight
  from assignments a join model_weights w using (universe_id, rebalance_date)
  where w.model in ('equal_weight', 'inverse_variance'))"""

# The phase CTEs repeat the names of the result CTEs, so they get their own set.
_PHASE_RESULTS_SQL = results_sql("phase_weights")
for _name in ("held", "drift", "model_dates", "traded", "gross", "results"):
    for _before, _after in ((f"\n{_name} as", f"\nphase_{_name} as"), (f"from {_name}", f"from phase_{_name}"), (f"join {_name}", f"join phase_{_name}")):
        _PHASE_RESULTS_SQL = _PHASE_RESULTS_SQL.replace(_before, _after)
_PHASED = f"""{_PHASES_SQL}, {_PHASE_RESULTS_SQL},
phased as (
  select * replace (split_part(model, '#', 1) as model), cast(split_part(model, '#', 2) as integer) as phase
  from phase_results)"""


def _assignments(spark, sf):
    rets, weights, realized = rule_tables(spark, sf)
    results = periods.strategy_period_results(weights, realized)
    chosen = cut_lineage(_selected(spark, sf, results, rets)[1])
    parts = [selection.phase_schedule(chosen, p) for p in range(selection.HOLD)]
    decisions = reduce(lambda a, b: a.unionByName(b), parts)
    dates = weights.join(realized.select("universe_id", "rebalance_date").distinct(), ["universe_id", "rebalance_date"])
    return selection.assign_models(decisions, dates), weights, realized


@register(
    "assign_models",
    f"{_PHASES_SQL} select universe_id, phase, decision_date, rebalance_date, selected_model from assignments",
)
def assign_models(spark, sf):
    return _assignments(spark, sf)[0]


@register(
    "selector_weight_history",
    f"""{_PHASES_SQL}
    select universe_id, rebalance_date, cast(split_part(model, '#', 2) as integer) as phase,
           split_part(model, '#', 1) as model, asset, {r("weight", 8)} from phase_weights""",
)
def selector_weight_history(spark, sf):
    assigned, weights, _ = _assignments(spark, sf)
    rows = selection.selector_weight_history(cut_lineage(assigned), weights, ["equal_weight", "inverse_variance"])
    return rounded(rows, 8, "weight")


def _phase_results(spark, sf, costs=5.0):
    assigned, weights, realized = _assignments(spark, sf)
    assigned = cut_lineage(assigned)
    history = cut_lineage(selection.selector_weight_history(assigned, weights, ["equal_weight", "inverse_variance"]))
    return assigned, selection.phase_results(history, realized, costs)


@register(
    "phase_cost_grid",
    f"""{_PHASED}, costs as (select unnest([0.0, 5.0, 10.0, 25.0])::double as cost_bps),
    grid as (
      select phase, cost_bps, universe_id, model, period_end, turnover,
             gross_return - turnover * cost_bps / 10000 as net_return from phased, costs),
    {summary_sql("grid", "phase, cost_bps, universe_id, model", "period_end", "net_return",
                 extra=", avg(turnover) as average_turnover")}
    select phase, cost_bps, universe_id, model, {SUMMARY_SELECT}, {r("average_turnover", 6)} from summary""",
)
def phase_cost_grid(spark, sf):
    _, results = _phase_results(spark, sf, [0.0, 5.0, 10.0, 25.0])
    summary = metrics.backtest_summary(results, ["phase", "cost_bps", "universe_id", "model"])
    return rounded(summary, 6, *SUMMARY_COLUMNS, "average_turnover")


QUARTERLY_SQL = f"""{_PHASED},
quarterly as (
  select universe_id, phase, decision_date,
    {", ".join(f"product(case when model = '{m}' then 1 + net_return else 1 end) - 1 as {m}"
               for m in ("selector", "equal_weight", "inverse_variance"))}
  from phased join (select universe_id, phase, decision_date, rebalance_date from assignments)
       using (universe_id, phase, rebalance_date) group by all),
excess as (
  select *, selector - equal_weight as excess_vs_equal_weight, selector - inverse_variance as excess_vs_inverse_variance
  from quarterly)"""
_QUARTERLY = ["selector", "equal_weight", "inverse_variance", "excess_vs_equal_weight", "excess_vs_inverse_variance"]


def quarterly(spark, sf):
    assigned, results = _phase_results(spark, sf)
    return selection.quarterly_compound(results, assigned, _QUARTERLY[:3], ["equal_weight", "inverse_variance"])


@register(
    "quarterly_compound",
    f"{QUARTERLY_SQL} select universe_id, phase, decision_date, {', '.join(r(c, 8) for c in _QUARTERLY)} from excess",
)
def quarterly_compound(spark, sf):
    return rounded(quarterly(spark, sf), 8, *_QUARTERLY)


@register(
    "contribution_concentration",
    f"""{QUARTERLY_SQL},
    best as (
      select universe_id, phase, sum(e) as best from (
        select universe_id, phase, excess_vs_equal_weight as e,
               row_number() over (partition by universe_id, phase order by excess_vs_equal_weight desc) as k
        from excess where excess_vs_equal_weight > 0) where k <= 3 group by all)
    select universe_id, phase, count(*) as periods,
           round(case when sum(excess_vs_equal_weight) > 0 then any_value(best) / sum(excess_vs_equal_weight) end, 6)
             + 0.0::double as top_share
    from excess left join best using (universe_id, phase) group by universe_id, phase""",
)
def contribution_concentration(spark, sf):
    rows = selection.contribution_concentration(quarterly(spark, sf), ["universe_id", "phase"], "excess_vs_equal_weight")
    return rounded(rows, 6, "top_share")


_EQUIVALENCE_SQL = f"""{_SETS_SQL}, {select_sql("all_forecasts", "chosen", ", feature_set")},
equivalence as (
  select universe_id, rebalance_date, a.selected_model, b.selected_model as other_model,
         a.selected_model = b.selected_model as same
  from chosen a join chosen b using (universe_id, rebalance_date)
  where a.feature_set = 'momentum' and b.feature_set = 'dispersion')"""


def _equivalence(spark, sf):
    design, rows = _set_forecasts(spark, sf)
    keys = ["universe_id", "rebalance_date", "feature_set"]
    chosen = cut_lineage(selection.select_models(rows, design, CANDIDATES, keys=keys))
    return selection.decision_equivalence(chosen.filter("feature_set = 'momentum'"), chosen.filter("feature_set = 'dispersion'"))


@register(
    "decision_equivalence",
    f"{_EQUIVALENCE_SQL} select universe_id, rebalance_date, selected_model, other_model, same from equivalence",
)
def decision_equivalence(spark, sf):
    return _equivalence(spark, sf)


@register(
    "yearly_agreement",
    f"""{_EQUIVALENCE_SQL}
    select universe_id, cast(year(rebalance_date) as integer) as year, count(*) as decisions,
           count(*) filter (not same) as different, {r("avg(same::double)", 8, "agreement")} from equivalence group by all""",
)
def yearly_agreement(spark, sf):
    return rounded(selection.yearly_agreement(_equivalence(spark, sf)), 8, "agreement")


@register(
    "score_signal",
    f"""{_FORECAST},
    last_fit as (
      select universe_id, model, max_by(n, rebalance_date) as n, max_by(my, rebalance_date) as intercept,
        max_by(m1, rebalance_date) as m1, max_by(m2, rebalance_date) as m2, max_by(s1, rebalance_date) as s1,
        max_by(s2, rebalance_date) as s2, max_by(rho, rebalance_date) as rho, max_by(c1, rebalance_date) as c1,
        max_by(c2, rebalance_date) as c2 from f_fit where rebalance_date <= date '2000-12-31' group by universe_id, model),
    frozen as (
      select *, ((n + 10) * n * c1 - n * rho * n * c2) / (pow(n + 10, 2) - pow(n * rho, 2)) as b1,
             ((n + 10) * n * c2 - n * rho * n * c1) / (pow(n + 10, 2) - pow(n * rho, 2)) as b2 from last_fit),
    scored as (
      select f.universe_id, f.rebalance_date, z.model,
             intercept + b1 * ({SETS["momentum"][0]} - m1) / s1 + b2 * ({SETS["momentum"][1]} - m2) / s2 as score
      from features f join frozen z using (universe_id))
    select universe_id, rebalance_date, model, {r("score", 8)},
           case when score > 0 then model else 'equal_weight' end as state,
           rebalance_date > date '2000-12-31' as forward_only from scored""",
)
def score_signal(spark, sf):
    design = learning_table(spark, sf)
    features = SETS["momentum"]
    coefficients = cut_lineage(ridge.frozen_coefficients(design, features, _targets(), frozen_through="2000-12-31"))
    scored = ridge.score_signal(feature_matrix(spark, sf), coefficients, features, "2000-12-31")
    rows = scored.withColumn("model", F.regexp_replace("target", "_excess_vs_equal_weight$", ""))
    state = F.when(F.col("score") > 0, F.col("model")).otherwise("equal_weight")
    return rounded(rows.withColumn("state", state), 8, "score").select(
        "universe_id", "rebalance_date", "model", "score", "state", "forward_only"
    )
