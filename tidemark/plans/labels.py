"""Queries on forward labels and the joined learning table."""

from __future__ import annotations

from tidemark.operators import labels, market_features
from tidemark.plans.catalog import register
from tidemark.plans.common import RULE_RESULTS_SQL, daily, r, rounded, rule_results
from tidemark.plans.market_features import FEATURES_SQL, feature_matrix
from tidemark.session import cut_lineage

MODELS = ["equal_weight", "inverse_variance", "low_risk", "price_weight"]
FEATURE_COLUMNS = [
    "AUTOMOBILE_return_63d", "BUILDING_return_63d", "average_pairwise_corr_63d", "cross_asset_return_dispersion_63d",
]


def _cell(model: str, value: str) -> str:
    return f"max(case when model = '{model}' then {value} end)"


def wide_sql(source: str, value: str, name: str, ranks: bool, extra: str = "") -> str:
    """Wide labels from long model returns; ties go to the first model by name."""
    cols = [f"{m}_forward_return" for m in MODELS]
    best = f"greatest({', '.join(cols)})"
    mean = f"(({' + '.join(cols)}) / {len(cols)})"
    spread = " + ".join(f"pow({c} - {mean}, 2)" for c in cols)
    rank = "".join(
        f", cast({' + '.join(f'({o} > {m}_forward_return)::int' for o in cols)} + 1 as integer) as {m}_rank" for m in MODELS
    )
    return f"""
{name}_wide as (
  select universe_id, rebalance_date, {", ".join(f"{_cell(m, value)} as {m}_forward_return" for m in MODELS)}{extra}
  from {source} group by universe_id, rebalance_date having count(distinct model) = {len(MODELS)}),
{name} as (
  select *, {", ".join(f"{m}_forward_return - equal_weight_forward_return as {m}_excess_vs_equal_weight" for m in MODELS)}
         {rank if ranks else ""},
    case {" ".join(f"when {m}_forward_return = {best} then '{m}'" for m in MODELS)} end as best_model,
    {best} as best_model_return, least({", ".join(cols)}) as worst_model_return,
    list_sort([{", ".join(cols)}])[{len(cols)}] - list_sort([{", ".join(cols)}])[{len(cols) - 1}] as winner_margin,
    sqrt(({spread}) / {len(cols)}) as model_return_dispersion
  from {name}_wide)"""


HORIZON_SQL = f"""
horizon as (
  select * from (
    select universe_id, rebalance_date, model, count(net_return) over w as seen,
           product(1 + net_return) over w - 1 as forward_return, last(period_end) over w as horizon_end
    from results
    window w as (partition by universe_id, model order by rebalance_date rows between current row and 2 following))
  where seen = 3),
{wide_sql("horizon", "forward_return", "horizon_labels", False, ", max(horizon_end) as horizon_end")}"""

_NUMBERS = (
    [f"{m}_forward_return" for m in MODELS]
    + [f"{m}_excess_vs_equal_weight" for m in MODELS]
    + ["best_model_return", "worst_model_return", "winner_margin", "model_return_dispersion"]
)


def horizon_table(spark, sf, results=None):
    results = rule_results(spark, sf) if results is None else results
    return labels.horizon_labels(results, MODELS)


@register(
    "forward_labels",
    f"""with {RULE_RESULTS_SQL}, {wide_sql("results", "net_return", "labels", True)}
    select universe_id, rebalance_date, best_model, {", ".join(f"{m}_rank" for m in MODELS)},
           {", ".join(r(c, 8) for c in _NUMBERS)} from labels""",
)
def forward_labels(spark, sf):
    return rounded(labels.forward_labels(rule_results(spark, sf), MODELS), 8, *_NUMBERS)


@register(
    "forward_horizon_returns",
    f"""with {RULE_RESULTS_SQL}, {HORIZON_SQL}
    select universe_id, rebalance_date, horizon_end, model, 3 as horizon_periods, {r("forward_return", 8)} from horizon""",
)
def forward_horizon_returns(spark, sf):
    return rounded(labels.horizon_returns(rule_results(spark, sf)), 8, "forward_return")


@register(
    "forward_horizon_labels",
    f"""with {RULE_RESULTS_SQL}, {HORIZON_SQL}
    select universe_id, rebalance_date, horizon_end, best_model, {", ".join(r(c, 8) for c in _NUMBERS)}
    from horizon_labels""",
)
def forward_horizon_labels(spark, sf):
    return rounded(horizon_table(spark, sf), 8, *_NUMBERS)


def learning_table(spark, sf, results=None, rets=None):
    """Features joined with three-period labels, materialised once."""
    features = feature_matrix(spark, sf, rets)
    return cut_lineage(labels.meta_dataset(features, horizon_table(spark, sf, results)))


LEARNING_SQL = f"""{RULE_RESULTS_SQL}, {HORIZON_SQL}, {FEATURES_SQL},
learning as (select * from features join horizon_labels using (universe_id, rebalance_date))"""


@register(
    "meta_dataset",
    f"""with {LEARNING_SQL}
    select universe_id, rebalance_date, horizon_end, best_model,
           {", ".join(r(c, 6) for c in [*FEATURE_COLUMNS, *_NUMBERS])} from learning""",
)
def meta_dataset(spark, sf):
    columns = [*FEATURE_COLUMNS, *_NUMBERS]
    return rounded(learning_table(spark, sf), 6, *columns).select(
        "universe_id", "rebalance_date", "horizon_end", "best_model", *columns
    )


@register(
    "dataset_join_checks",
    f"""with {LEARNING_SQL}
    select (select count(*) from learning) as rows, 0::bigint as missing_values,
           (select count(*) from features where rebalance_date not in (select rebalance_date from horizon_labels)) as lost_rows""",
)
def dataset_join_checks(spark, sf):
    features = cut_lineage(feature_matrix(spark, sf, daily(spark, sf)))
    return labels.join_checks(features, horizon_table(spark, sf), FEATURE_COLUMNS)


@register(
    "class_balance",
    f"""with {RULE_RESULTS_SQL}, {wide_sql("results", "net_return", "labels", True)}
    select best_model, count(*) as rows, {r("count(*) / sum(count(*)) over ()", 8, "share")} from labels group by best_model""",
)
def class_balance(spark, sf):
    return rounded(market_features.class_balance(labels.forward_labels(rule_results(spark, sf), MODELS)), 8, "share")
