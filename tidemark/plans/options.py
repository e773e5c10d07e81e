"""Queries on option contracts, features and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import options as opt
from tidemark.operators import option_features, option_quality
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.session import cut_lineage
from tidemark.sources import harness_options
from tidemark.sources.harness import read

CONTRACTS_SQL = harness_options.CONTRACTS_SQL

# Nested steps keep each expression readable; names follow the Spark columns.
PREPARED_SQL = f"""{CONTRACTS_SQL},
valued as (
  select *, case put_call when 'CALL' then greatest(spot - strike, 0) else greatest(strike - spot, 0) end as intrinsic,
    case put_call when 'CALL' then (spot - strike) / spot * 100 else (strike - spot) / spot * 100 end as moneyness,
    case when (bid + ask) / 2 > 0 then (ask - bid) / ((bid + ask) / 2) * 100 end as spread from contracts),
checked as (
  select *, mark - intrinsic as extrinsic, abs(moneyness) <= 2.0 as is_atm, expiration_dte = 0 as is_zero_dte,
    concat_ws('|', case when not bid > 0 then 'bid' end, case when not ask >= bid then 'ask' end,
      case when not (mark >= bid and mark <= ask) then 'mark' end,
      case when not coalesce(spread <= 25, false) then 'spread' end,
      case when not quote_age_minutes between 0 and 30 then 'quote_age' end, case when expiration_dte < 1 then 'dte' end,
      case when not volatility > 0 then 'volatility' end, case when not delta between -1 and 1 then 'delta' end,
      case when not gamma >= 0 then 'gamma' end, case when not vega >= 0 then 'vega' end) as reasons
  from valued),
prepared as (
  select *, reasons = '' as eligible,
    case when expiration_dte between 1 and 7 then 'dte_1_7' when expiration_dte between 8 and 30 then 'dte_8_30'
         when expiration_dte between 31 and 90 then 'dte_31_90' when expiration_dte between 91 and 365 then 'dte_91_365'
         when expiration_dte >= 366 then 'dte_366_plus' end as bucket from checked)"""

_TIE = ["volatility"]


def prepared(spark, sf):
    spots = option_features.spot_map(harness_options.quotes(spark, sf))
    return option_features.prepare_contracts(harness_options.contracts(spark, sf), spots)


@register(
    "spot_map",
    f"""with {CONTRACTS_SQL}
    select run_id, upper(p_brand) as underlying_symbol, round(spot, 6) + 0.0::double as spot
    from spots cross join (select unnest(['A', 'N', 'R']) as run_id)""",
)
def spot_map(spark, sf):
    return rounded(option_features.spot_map(harness_options.quotes(spark, sf)), 6, "spot")


_VALUES = ["intrinsic", "extrinsic", "moneyness", "spread"]


@register(
    "prepare_contracts",
    f"""with {PREPARED_SQL}
    select run_id, underlying_symbol, put_call, {r("strike", 2)}, expiration_dte, contract_index,
           {", ".join(r(c, 9) for c in _VALUES)}, is_atm, is_zero_dte, eligible, reasons from prepared""",
)
def prepare_contracts(spark, sf):
    rows = prepared(spark, sf).select(
        "run_id", "underlying_symbol", "put_call", "strike", F.col("expiration_dte").cast("int").alias("expiration_dte"),
        "contract_index", F.col("canonical_intrinsic_value").alias("intrinsic"),
        F.col("canonical_extrinsic_value").alias("extrinsic"), F.col("signed_moneyness_pct").alias("moneyness"),
        F.col("relative_spread_pct").alias("spread"), "is_atm", "is_zero_dte", F.col("eligible_contract").alias("eligible"),
        F.col("ineligibility_reasons").alias("reasons"),
    )
    return rounded(rounded(rows, 9, *_VALUES), 2, "strike")


@register(
    "contract_buckets",
    f"""with {PREPARED_SQL}
    select run_id, case when moneyness <= -10 then 'deep_otm' when moneyness < -2 then 'otm' when moneyness <= 2 then 'atm'
                when moneyness < 10 then 'itm' else 'deep_itm' end as moneyness_bucket,
      case when expiration_dte <= 0 then '0_dte' when expiration_dte <= 7 then '1_7' when expiration_dte <= 30 then '8_30'
           when expiration_dte <= 90 then '31_90' when expiration_dte <= 365 then '91_365' else '366_plus' end as dte_bucket,
      count(*) as contracts, {r("min(extrinsic)", 6, "lowest_extrinsic")}, {r("max(intrinsic)", 6, "highest_intrinsic")}
    from prepared group by all""",
)
def contract_buckets(spark, sf):
    rows = prepared(spark, sf).groupBy(
        "run_id",
        opt.moneyness_bucket(F.col("signed_moneyness_pct")).alias("moneyness_bucket"),
        opt.dte_bucket(F.col("expiration_dte")).alias("dte_bucket"),
    ).agg(
        F.count(F.lit(1)).alias("contracts"),
        F.min("canonical_extrinsic_value").alias("lowest_extrinsic"),
        F.max("canonical_intrinsic_value").alias("highest_intrinsic"),
    )
    return rounded(rows, 6, "lowest_extrinsic", "highest_intrinsic")


@register(
    "quote_age_minutes",
    """select o_orderpriority, round(min(age), 4) + 0.0::double as youngest, round(max(age), 4) + 0.0::double as oldest
       from (select o_orderpriority, (epoch(timestamp '2002-01-01') - epoch(o_orderdate)) / 60.0::double as age from orders)
       group by all""",
)
def quote_age_minutes(spark, sf):
    age = opt.quote_age_minutes(F.unix_timestamp("o_orderdate") * 1000, F.to_timestamp(F.lit("2002-01-01 00:00:00")))
    rows = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min(age).alias("youngest"), F.max(age).alias("oldest"))
    return rounded(rows, 4, "youngest", "oldest")


@register(
    "atm_iv_by_bucket",
    f"""with {PREPARED_SQL}
    select run_id, underlying_symbol, bucket, {r("median(volatility)", 6, "atm_iv_median")}, count(*) as contracts,
           count(distinct expiration_date) as expirations
    from prepared where eligible and is_atm and bucket is not null group by run_id, underlying_symbol, bucket""",
)
def atm_iv_by_bucket(spark, sf):
    return rounded(option_features.atm_iv_by_bucket(prepared(spark, sf)), 6, "atm_iv_median")


_SCOPED_SQL = f"""{PREPARED_SQL},
scoped as (
  select 'all' as scope, * from prepared where eligible
  union all select bucket, * from prepared where eligible and bucket is not null),
nearest as (
  select run_id, underlying_symbol, scope, expiration_date,
    arg_min(volatility, (abs(delta - 0.25), volatility)) filter (put_call = 'CALL') as call_iv,
    arg_min(volatility, (abs(delta + 0.25), volatility)) filter (put_call = 'PUT') as put_iv
  from scoped group by all),
delta_skew as (select *, put_iv - call_iv as skew from nearest where call_iv is not null and put_iv is not null),
atm_sides as (
  select run_id, underlying_symbol, scope, expiration_date, median(volatility) filter (put_call = 'CALL') as call_iv,
         median(volatility) filter (put_call = 'PUT') as put_iv from scoped where is_atm group by all),
atm_skew as (select *, put_iv - call_iv as skew from atm_sides where call_iv is not null and put_iv is not null)"""

_SKEW = ["call_iv", "put_iv", "skew"]


@register(
    "matched_delta_skew",
    f"""with {_SCOPED_SQL}
    select run_id, underlying_symbol, scope, expiration_date, {", ".join(r(c, 6) for c in _SKEW)} from delta_skew""",
)
def matched_delta_skew(spark, sf):
    return rounded(option_features.matched_delta_skew(prepared(spark, sf), _TIE), 6, *_SKEW)


@register(
    "matched_atm_skew",
    f"""with {_SCOPED_SQL}
    select run_id, underlying_symbol, scope, expiration_date, {", ".join(r(c, 6) for c in _SKEW)} from atm_skew""",
)
def matched_atm_skew(spark, sf):
    return rounded(option_features.matched_atm_skew(prepared(spark, sf)), 6, *_SKEW)


def _features_sql() -> str:
    ok, atm = "eligible", "eligible and is_atm"

    def total(side: str, column: str) -> str:
        return f"coalesce(sum({column}) filter (eligible and put_call = '{side}'), 0)"

    def ratio(column: str) -> str:
        return f"case when {total('CALL', column)} > 0 then {total('PUT', column)} / {total('CALL', column)} end"

    buckets = "".join(
        f""",
    count(*) filter ({atm} and bucket = '{b}') as atm_contract_count_{b},
    count(distinct expiration_date) filter ({atm} and bucket = '{b}') as atm_expiration_count_{b},
    median(volatility) filter ({atm} and bucket = '{b}') as atm_iv_median_{b}"""
        for b in opt.BUCKETS
    )

    def skew(source: str, overall: str, count: str, prefix: str, count_prefix: str) -> str:
        cells = [("all", overall, count)] + [(b, f"{prefix}_{b}", f"{count_prefix}_{b}") for b in opt.BUCKETS]
        body = ", ".join(
            f"median(skew) filter (scope = '{s}') as {v}, count(*) filter (scope = '{s}') as {n}" for s, v, n in cells
        )
        return f"(select run_id, underlying_symbol, {body} from {source} group by all)"

    delta = skew(
        "delta_skew", "delta_25_put_call_iv_skew_matched_median", "delta_25_expiration_pair_count",
        "delta_25_put_call_iv_skew", "delta_25_pair_count",
    )
    atm_skew = skew(
        "atm_skew", "atm_put_call_iv_skew_matched_median", "atm_expiration_pair_count", "atm_put_call_iv_skew",
        "atm_skew_pair_count",
    )
    return f"""
symbol_base as (
  select run_id, underlying_symbol, max(spot) as spot, count(*) as contract_count_total,
    count(*) filter ({ok}) as contract_count_eligible, (count(*) filter ({ok}))::double / count(*) as eligible_contract_ratio,
    count(*) filter (is_zero_dte) as zero_dte_contract_count,
    (count(*) filter (is_zero_dte))::double / count(*) as zero_dte_contract_ratio,
    count(*) filter ({ok} and put_call = 'CALL') as eligible_call_count,
    count(*) filter ({ok} and put_call = 'PUT') as eligible_put_count,
    count(distinct expiration_date) filter ({ok}) as eligible_expiration_count,
    min(expiration_dte) filter ({ok})::double as eligible_dte_min, max(expiration_dte) filter ({ok})::double as eligible_dte_max,
    {ratio("oi")} as put_call_open_interest_ratio, {ratio("volume")} as put_call_volume_ratio,
    {total("CALL", "oi")} + {total("PUT", "oi")} as open_interest_total,
    {total("CALL", "volume")} + {total("PUT", "volume")} as option_volume_total,
    count(*) filter ({atm}) as atm_contract_count, count(distinct expiration_date) filter ({atm}) as atm_expiration_count,
    median(spread) filter ({ok}) as relative_spread_pct_median, median(spread) filter ({atm}) as atm_relative_spread_pct_median,
    median(volatility) filter ({ok}) as iv_median, median(volatility) filter ({atm}) as atm_iv_median,
    median(volatility) filter ({atm} and put_call = 'CALL') as atm_call_iv_median,
    median(volatility) filter ({atm} and put_call = 'PUT') as atm_put_iv_median,
    median(abs(delta)) filter ({ok}) as abs_delta_median, median(gamma) filter ({ok}) as gamma_median,
    median(theta) filter ({ok}) as theta_median, median(vega) filter ({ok}) as vega_median,
    median(extrinsic) filter ({ok}) as canonical_extrinsic_value_median,
    median(quote_age_minutes) filter ({ok}) as quote_age_minutes_median{buckets}
  from prepared group by run_id, underlying_symbol),
symbol_joined as (
  select * from symbol_base left join {delta} d using (run_id, underlying_symbol)
  left join {atm_skew} a using (run_id, underlying_symbol)),
symbol_features as (
  select * replace ({", ".join(f"coalesce({c}, 0) as {c}" for c in PAIR_COUNTS)}),
         atm_iv_median_dte_91_365 - atm_iv_median_dte_8_30 as atm_iv_term_spread_91_365_minus_8_30 from symbol_joined)"""


PAIR_COUNTS = (
    ["delta_25_expiration_pair_count", "atm_expiration_pair_count"]
    + [f"delta_25_pair_count_{b}" for b in opt.BUCKETS]
    + [f"atm_skew_pair_count_{b}" for b in opt.BUCKETS]
)
COUNTS = (
    ["contract_count_total", "contract_count_eligible", "zero_dte_contract_count", "eligible_call_count",
     "eligible_put_count", "eligible_expiration_count", "atm_contract_count", "atm_expiration_count"]
    + [f"{k}_{b}" for b in opt.BUCKETS for k in ("atm_contract_count", "atm_expiration_count")]
    + PAIR_COUNTS
)
NUMBERS = ["spot", "eligible_contract_ratio", "zero_dte_contract_ratio", "eligible_dte_min", "eligible_dte_max",
           *option_quality.MODEL_FEATURES]
FEATURES_SQL = f"{_SCOPED_SQL}, {_features_sql()}"


def features(spark, sf):
    return option_features.symbol_option_features(cut_lineage(option_features.feature_inputs(prepared(spark, sf))), _TIE)


@register(
    "symbol_option_features",
    f"""with {FEATURES_SQL}
    select run_id, underlying_symbol, {", ".join(COUNTS)}, {", ".join(r(c, 6) for c in NUMBERS)} from symbol_features""",
)
def symbol_option_features(spark, sf):
    return rounded(features(spark, sf), 6, *NUMBERS).select("run_id", "underlying_symbol", *COUNTS, *NUMBERS)


@register(
    "iv_term_spread",
    f"""with {FEATURES_SQL}
    select run_id, underlying_symbol, {r("atm_iv_median_dte_8_30", 6)}, {r("atm_iv_median_dte_91_365", 6)},
           {r("atm_iv_term_spread_91_365_minus_8_30", 6)} from symbol_features""",
)
def iv_term_spread(spark, sf):
    keep = ["atm_iv_median_dte_8_30", "atm_iv_median_dte_91_365", "atm_iv_term_spread_91_365_minus_8_30"]
    return rounded(features(spark, sf), 6, *keep).select("run_id", "underlying_symbol", *keep)


@register(
    "eligibility_summary",
    f"""with {PREPARED_SQL},
    reasons as (
      select run_id, underlying_symbol, reason, count(*) as n
      from (select run_id, underlying_symbol, unnest(string_split(reasons, '|')) as reason from prepared where not eligible)
      group by all),
    packed as (
      select run_id, underlying_symbol, '{{' || string_agg('"' || reason || '":' || n, ',' order by reason) || '}}' as body
      from reasons group by all)
    select run_id, underlying_symbol, count(*) as contract_count_total, count(*) filter (eligible) as contract_count_eligible,
      round((count(*) filter (eligible))::double / count(*), 8) + 0.0::double as eligible_contract_ratio,
      count(*) filter (not eligible) as ineligible_contract_count,
      coalesce(any_value(body), '{{}}') as ineligibility_reason_counts
    from prepared left join packed using (run_id, underlying_symbol) group by run_id, underlying_symbol""",
)
def eligibility_summary(spark, sf):
    return rounded(option_features.eligibility_summary(prepared(spark, sf)), 8, "eligible_contract_ratio")


_GRADED_SQL = """
graded as (
  select *, case when eligible_contract_ratio >= 0.8 and contract_count_eligible >= 100 and eligible_expiration_count >= 10 then 'PASS'
      when eligible_contract_ratio >= 0.5 and contract_count_eligible >= 50 and eligible_expiration_count >= 5 then 'CAUTION'
      else 'SUPPRESS' end as quality_symbol_status
  from symbol_features),
reasoned as (
  select *, case quality_symbol_status when 'PASS' then ''
    when 'CAUTION' then concat_ws('|',
      case when eligible_contract_ratio < 0.8 then 'eligible_contract_ratio_below_pass' end,
      case when contract_count_eligible < 100 then 'eligible_contract_count_below_pass' end,
      case when eligible_expiration_count < 10 then 'eligible_expiration_count_below_pass' end)
    else concat_ws('|',
      case when eligible_contract_ratio < 0.5 then 'eligible_contract_ratio_below_caution' end,
      case when contract_count_eligible < 50 then 'eligible_contract_count_below_caution' end,
      case when eligible_expiration_count < 5 then 'eligible_expiration_count_below_caution' end) end as quality_symbol_reasons
  from graded)"""


@register(
    "symbol_quality",
    f"""with {FEATURES_SQL}, {_GRADED_SQL}
    select run_id, underlying_symbol, quality_symbol_status, quality_symbol_reasons from reasoned""",
)
def symbol_quality(spark, sf):
    return option_quality.symbol_quality(features(spark, sf)).select(
        "run_id", "underlying_symbol", "quality_symbol_status", "quality_symbol_reasons"
    )


def _usable_sql(feature: str) -> str:
    if feature == option_quality.TERM_FEATURE:
        return "least(" + ", ".join(option_quality.TERM_SUPPORT) + f") >= {option_quality.MIN_ATM_CONTRACTS}"
    if feature in option_quality.FEATURE_RULES:
        column, minimum, _ = option_quality.FEATURE_RULES[feature]
        return f"{column} >= {minimum}"
    return "true"


def _masked_sql(feature: str) -> str:
    alive = f"quality_symbol_status <> 'SUPPRESS' and {_usable_sql(feature)}"
    return f"round(case when {alive} then {feature} end, 6) + 0.0::double as {feature}"


@register(
    "feature_support_mask",
    f"""with {FEATURES_SQL}, {_GRADED_SQL}
    select run_id, underlying_symbol, quality_symbol_status, '1.0.0' as quality_policy_version,
           {", ".join(_masked_sql(f) for f in option_quality.MODEL_FEATURES)} from reasoned""",
)
def feature_support_mask(spark, sf):
    masked = option_quality.feature_support_mask(features(spark, sf))
    return rounded(masked, 6, *option_quality.MODEL_FEATURES).select(
        "run_id", "underlying_symbol", "quality_symbol_status", "quality_policy_version", *option_quality.MODEL_FEATURES
    )


def _quality_sql() -> str:
    parts = []
    for f in option_quality.MODEL_FEATURES:
        if f == option_quality.TERM_FEATURE:
            count, minimum, code = f"least({', '.join(option_quality.TERM_SUPPORT)})", option_quality.MIN_ATM_CONTRACTS, "TERM_STRUCTURE_COMPONENT_SUPPORT"
            column, lacking = "|".join(option_quality.TERM_SUPPORT), "insufficient_term_structure_support"
        elif f in option_quality.FEATURE_RULES:
            column, minimum, code = option_quality.FEATURE_RULES[f]
            count, lacking = column, "insufficient_feature_support"
        else:
            count, minimum, code, column, lacking = "null", "null", "SYMBOL_QUALITY_ONLY", None, ""
        named = f"'{column}'" if column else "null::varchar"
        parts.append(
            f"""select run_id, underlying_symbol, '{f}' as feature_name, quality_symbol_status as s, quality_symbol_reasons as why,
            {_usable_sql(f)} as ok, '{code}' as code, {named} as col, ({count})::double as n, ({minimum})::integer as m,
            '{lacking}' as lacking from reasoned"""
        )
    return f"""
rules as ({" union all ".join(parts)})
select run_id, underlying_symbol, feature_name, s <> 'SUPPRESS' and ok as usable,
  case when s = 'SUPPRESS' or not ok then 'SUPPRESS' else s end as quality_status,
  case when s = 'SUPPRESS' then 'SYMBOL_QUALITY' else code end as rule_code,
  case when s <> 'SUPPRESS' then col end as support_column, case when s <> 'SUPPRESS' then n end as support_count,
  case when s <> 'SUPPRESS' then m end as minimum_support,
  case when s = 'SUPPRESS' then why when not ok then lacking else '' end as reason from rules"""


@register("feature_quality", f"with {FEATURES_SQL}, {_GRADED_SQL}, {_quality_sql()}")
def feature_quality(spark, sf):
    return option_quality.feature_quality(features(spark, sf))
