"""Queries on paired bootstrap comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import bootstrap
from tidemark.plans.catalog import register
from tidemark.plans.common import RULE_RESULTS_SQL, r, rounded, rule_results
from tidemark.plans.selection import QUARTERLY_SQL, quarterly
from tidemark.session import cut_lineage

ITERATIONS, QUARTER_DRAWS = 5000, 10000


def _pairs(spark, sf):
    results = cut_lineage(rule_results(spark, sf))
    bench = results.filter("model = 'equal_weight'").select(
        "universe_id", "rebalance_date", F.col("net_return").alias("benchmark")
    )
    return (
        results.filter("model <> 'equal_weight'")
        .join(bench, ["universe_id", "rebalance_date"])
        .select("universe_id", "model", "rebalance_date", F.col("net_return").alias("challenger"), "benchmark")
    )


_PAIRS_SQL = """
pairs as (
  select a.universe_id, a.model, row_number() over (partition by a.universe_id, a.model order by a.rebalance_date) - 1 as pos,
         count(*) over (partition by a.universe_id, a.model) as n, a.net_return as challenger, b.net_return as benchmark
  from results a join results b on a.universe_id = b.universe_id and a.rebalance_date = b.rebalance_date
       and b.model = 'equal_weight' where a.model <> 'equal_weight')"""


def _draw_sql(block: str, seed: str = "'42'") -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', iteration, {block}, {seed})), 1, 8) as bigint)"


def _samples_sql(block_length: int, name: str = "samples", iterations: int = ITERATIONS) -> str:
    side = {}
    for s in ("challenger", "benchmark"):
        side[s] = f"""
         case when product(1 + {s}) > 0 then pow(product(1 + {s}), 12.0 / any_value(n)) - 1 end as {s}_annualized_return,
         case when stddev_samp({s}) > 0 then avg({s}) / stddev_samp({s}) * sqrt(12) end as {s}_sharpe,
         min(w_{s} / greatest(p_{s}, 1) - 1) as {s}_low"""
    return f"""
{name}_placed as (
  select z.universe_id, z.model, iteration, slot, z.n,
         ({_draw_sql(f"slot // {block_length}")} % z.n + slot % {block_length}) % z.n as pos
  from (select distinct universe_id, model, n from pairs) z, range({iterations}) i(iteration), unnest(range(z.n)) s(slot)),
{name}_values as (
  select d.universe_id, d.model, iteration, slot, d.n, challenger, benchmark
  from {name}_placed d join pairs p on p.universe_id = d.universe_id and p.model = d.model and p.pos = d.pos),
{name}_wealth as (
  select *, product(1 + challenger) over w as w_challenger, product(1 + benchmark) over w as w_benchmark from {name}_values
  window w as (partition by universe_id, model, iteration order by slot rows unbounded preceding)),
{name}_peaks as (
  select *, max(w_challenger) over w as p_challenger, max(w_benchmark) over w as p_benchmark from {name}_wealth
  window w as (partition by universe_id, model, iteration order by slot rows unbounded preceding)),
{name} as (
  select *, least(challenger_low, 0) as challenger_max_drawdown, least(benchmark_low, 0) as benchmark_max_drawdown,
         challenger_annualized_return - benchmark_annualized_return as annualized_return_difference,
         challenger_sharpe - benchmark_sharpe as sharpe_difference,
         least(challenger_low, 0) - least(benchmark_low, 0) as drawdown_improvement
  from (select universe_id, model, iteration, any_value(n) as n, {side["challenger"]}, {side["benchmark"]}
        from {name}_peaks group by universe_id, model, iteration))"""


_SAMPLE = [
    "challenger_annualized_return", "benchmark_annualized_return", "annualized_return_difference", "challenger_sharpe",
    "benchmark_sharpe", "sharpe_difference", "challenger_max_drawdown", "benchmark_max_drawdown", "drawdown_improvement",
]


@register(
    "block_bootstrap_samples",
    f"""with {RULE_RESULTS_SQL}, {_PAIRS_SQL}, {_samples_sql(6)}
    select universe_id, model, iteration, n, {", ".join(r(c, 6) for c in _SAMPLE)} from samples""",
)
def block_bootstrap_samples(spark, sf):
    samples = bootstrap.block_bootstrap(
        _pairs(spark, sf), ["universe_id", "model"], "rebalance_date", ITERATIONS, 6, 12, 42
    )
    return rounded(samples.withColumn("iteration", F.col("iteration").cast("long")), 6, *_SAMPLE)


_SUMMARY = [
    "mean_sharpe_difference", "median_sharpe_difference", "sharpe_difference_ci_low", "sharpe_difference_ci_high",
    "probability_sharpe_improvement", "mean_return_difference", "return_difference_ci_low", "return_difference_ci_high",
    "probability_return_improvement", "mean_drawdown_improvement", "probability_drawdown_improvement",
]


def _summary_sql(name: str) -> str:
    return f"""
  select universe_id, model, max(n) as observations, count(*) as bootstrap_samples,
    avg(sharpe_difference) as mean_sharpe_difference, median(sharpe_difference) as median_sharpe_difference,
    quantile_cont(sharpe_difference, 0.025) as sharpe_difference_ci_low,
    quantile_cont(sharpe_difference, 0.975) as sharpe_difference_ci_high,
    avg(coalesce(sharpe_difference > 0, false)::double) as probability_sharpe_improvement,
    avg(annualized_return_difference) as mean_return_difference,
    quantile_cont(annualized_return_difference, 0.025) as return_difference_ci_low,
    quantile_cont(annualized_return_difference, 0.975) as return_difference_ci_high,
    avg(coalesce(annualized_return_difference > 0, false)::double) as probability_return_improvement,
    avg(drawdown_improvement) as mean_drawdown_improvement,
    avg(coalesce(drawdown_improvement > 0, false)::double) as probability_drawdown_improvement
  from {name} group by universe_id, model"""


_LENGTHS = [3, 6, 12]


@register(
    "block_bootstrap_report",
    f"""with {RULE_RESULTS_SQL}, {_PAIRS_SQL}, {", ".join(_samples_sql(b, f"s{b}") for b in _LENGTHS)},
    report as ({" union all ".join(f"select {b} as block_length, * from ({_summary_sql(f's{b}')})" for b in _LENGTHS)})
    select block_length, universe_id, model, observations, bootstrap_samples, {", ".join(r(c, 6) for c in _SUMMARY)}
    from report""",
)
def block_bootstrap_report(spark, sf):
    pairs = cut_lineage(_pairs(spark, sf))
    parts = []
    for length in _LENGTHS:
        samples = bootstrap.block_bootstrap(pairs, ["universe_id", "model"], "rebalance_date", ITERATIONS, length, 12, 42)
        parts.append(bootstrap.bootstrap_summary(samples, ["universe_id", "model"]).withColumn("block_length", F.lit(length)))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 6, *_SUMMARY)


_BENCHMARKS = ["equal_weight", "inverse_variance"]


def _iid_sql() -> str:
    cols = ["selector", *_BENCHMARKS]
    per_draw = ", ".join(
        f"""avg({c}) as {c}_mean, case when product(1 + {c}) > 0 then pow(product(1 + {c}), 4.0 / any_value(n)) - 1 end as {c}_ann,
        case when stddev_samp({c}) > 0 then avg({c}) / stddev_samp({c}) * 2 end as {c}_sharpe"""
        for c in cols
    )
    out = ", ".join(
        f"""avg(coalesce(selector_ann > {b}_ann, false)::double) as p_return_above_{b},
        avg(coalesce(selector_sharpe > {b}_sharpe, false)::double) as p_sharpe_above_{b},
        quantile_cont(selector_mean - {b}_mean, 0.025) as excess_{b}_ci_low,
        quantile_cont(selector_mean - {b}_mean, 0.975) as excess_{b}_ci_high"""
        for b in _BENCHMARKS
    )
    return f"""
ordered as (
  select *, row_number() over (partition by universe_id, phase order by decision_date) - 1 as pos,
         count(*) over (partition by universe_id, phase) as n from excess),
placed as (
  select z.universe_id, z.phase, iteration, slot, {_draw_sql("slot", "42 + phase")} % z.n as pos
  from (select distinct universe_id, phase, n from ordered) z, range({QUARTER_DRAWS}) i(iteration), unnest(range(z.n)) s(slot)),
draws as (
  select universe_id, phase, iteration, any_value(n) as n, {per_draw}
  from placed join ordered using (universe_id, phase, pos) group by all),
iid as (select universe_id, phase, max(n) as quarters, count(*) as draws, {out} from draws group by all)"""


_IID = [f"{p}_{b}{s}" for b in _BENCHMARKS for p, s in (("p_return_above", ""), ("p_sharpe_above", ""), ("excess", "_ci_low"), ("excess", "_ci_high"))]


@register(
    "iid_bootstrap",
    f"""{QUARTERLY_SQL}, {_iid_sql()}
    select universe_id, phase, quarters, draws, {", ".join(r(c, 6) for c in _IID)} from iid""",
)
def iid_bootstrap(spark, sf):
    rows = bootstrap.iid_bootstrap(
        quarterly(spark, sf), ["universe_id", "phase"], "decision_date", "selector", _BENCHMARKS, QUARTER_DRAWS,
        F.lit(42) + F.col("phase"),
    )
    return rounded(rows, 6, *_IID)
