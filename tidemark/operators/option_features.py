"""Contracts of a capture run: preparation, per-symbol features and eligibility.

Groups are (run, symbol) or finer. Counts, sums and nearest-delta choices are
plain aggregates with map-side combining; medians go through ``quantiles``, so
one symbol may hold most of a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import options as opt
from tidemark.operators import quantiles
from tidemark.session import cut_lineage

KEYS = ["run_id", "underlying_symbol"]
SCHEMA_VERSION = "1.2.0"
TARGET_DELTA = 0.25
NUMERIC = (
    "strike", "expiration_dte", "bid", "ask", "mark", "volatility", "delta", "gamma", "theta", "vega", "openInterest",
    "totalVolume",
)


def price_column(quotes: DataFrame) -> str:
    """The first supported price column that exists in the table; a choice by schema, not by row."""
    for name in opt.PRICE_COLUMNS:
        if name in quotes.columns:
            return name
    raise ValueError(f"no spot price column; expected one of {opt.PRICE_COLUMNS}")


def spot_map(quotes: DataFrame, order: str = "quote_row") -> DataFrame:
    """Positive spot per run and symbol; the last of duplicate symbols by ``order`` wins."""
    symbol = F.upper(F.trim("symbol"))
    price = F.expr(f"try_cast(`{price_column(quotes)}` as double)")
    rows = quotes.select("run_id", symbol.alias("underlying_symbol"), price.alias("spot"), F.col(order).alias("at"))
    return (
        rows.filter((F.col("spot") > 0) & (F.col("underlying_symbol") != ""))
        .groupBy("run_id", "underlying_symbol")
        .agg(F.max_by("spot", "at").alias("spot"))
    )


def duplicate_quote_symbols(quotes: DataFrame) -> DataFrame:
    """Symbols quoted more than once in a run; strict callers refuse the run."""
    return (
        quotes.groupBy("run_id", F.upper(F.trim("symbol")).alias("symbol"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def _once(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with the named columns worked out before any later filter or expression.

    The planner writes the expression of a column out wherever it is used; a chain of checks then becomes
    one function too long to be compiled. What a generator gives is not written out again.
    """
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.inline(F.array(F.struct(*names)))).select(*rows.columns)


def prepare_contracts(contracts: DataFrame, spots: DataFrame, **policy) -> DataFrame:
    """Spot, value split, moneyness, spread, age and the twelve eligibility checks per contract.

    The spot table has one row per run and symbol and the join key is that pair;
    whether it is broadcast is left to the measured size at run time.
    """
    upper = {c: F.upper(F.trim(c)) for c in ("underlying_symbol", "put_call")}
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in NUMERIC}
    rows = _once(contracts.withColumns(upper | numbers), [*upper, *numbers]).join(spots, KEYS, "left")
    if "quote_age_minutes" not in rows.columns:
        rows = rows.withColumn(
            "quote_age_minutes",
            opt.quote_age_minutes(F.col("quoteTimeInLong"), F.to_timestamp("raw_captured_at_utc")),
        )
    side, spot, strike = F.col("put_call"), F.col("spot"), F.col("strike")
    rows = rows.withColumn("canonical_intrinsic_value", opt.intrinsic_value(side, spot, strike)).withColumns(
        {
            "canonical_extrinsic_value": opt.extrinsic_value(F.col("mark"), F.col("canonical_intrinsic_value")),
            "signed_moneyness_pct": opt.signed_moneyness_pct(side, spot, strike),
            "relative_spread_pct": opt.relative_spread_pct(F.col("bid"), F.col("ask")),
        }
    )
    rows = _once(rows, ["signed_moneyness_pct", "relative_spread_pct"])
    checks = opt.eligibility(**policy)
    flagged = rows.withColumn("abs_moneyness_pct", F.abs("signed_moneyness_pct")).withColumns(
        {
            "is_atm": F.coalesce(F.col("abs_moneyness_pct") <= opt.ATM_PCT, F.lit(False)),
            "is_zero_dte": F.coalesce(F.col("expiration_dte") == 0, F.lit(False)),
            **checks,
        }
    )
    names = list(checks)
    return flagged.withColumns(
        {"eligible_contract": opt.all_pass(names), "ineligibility_reasons": opt.failed_names(names)}
    )


def feature_inputs(prepared: DataFrame, tie_break: tuple[str, ...] = ("contract_index",)) -> DataFrame:
    """The columns that feature building reads; worth selecting before materialising a run."""
    names = [
        *KEYS, "put_call", "expiration_dte", "expiration_date", "spot", "volatility", "delta", "gamma", "theta", "vega",
        "openInterest", "totalVolume", "relative_spread_pct", "canonical_extrinsic_value", "quote_age_minutes", "is_atm",
        "is_zero_dte", "eligible_contract", *tie_break,
    ]
    return prepared.select(*dict.fromkeys(names))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def _counts(prepared: DataFrame) -> DataFrame:
    """Counts, ratios and totals in two levels: per expiration, then per symbol.

    Distinct expirations become a count of first-level rows, so no row is
    expanded per distinct set, and a symbol with most of the rows is reduced to
    its expirations before the second shuffle.
    """
    ok, atm = F.col("eligible_contract"), F.col("eligible_contract") & F.col("is_atm")
    call, put = ok & (F.col("put_call") == "CALL"), ok & (F.col("put_call") == "PUT")
    bucket = opt.feature_bucket(F.col("expiration_dte"))
    counts = {"n": F.lit(True), "ok": ok, "zero": F.col("is_zero_dte"), "call": call, "put": put, "atm": atm}
    counts |= {f"atm_{name}": atm & (bucket == name) for name in opt.BUCKETS}
    sums = {f"{side}_{c}": F.when(test, F.col(c)) for side, test in (("call", call), ("put", put)) for c in ("openInterest", "totalVolume")}
    per_expiration = prepared.groupBy(*KEYS, "expiration_date").agg(
        *[F.count_if(test).alias(name) for name, test in counts.items()],
        *[F.sum(value).alias(name) for name, value in sums.items()],
        F.min(F.when(ok, F.col("expiration_dte"))).alias("dte_min"),
        F.max(F.when(ok, F.col("expiration_dte"))).alias("dte_max"),
        F.max("spot").alias("spot"),
    )

    def expirations(name: str) -> Column:
        return F.count_if((F.col(name) > 0) & F.col("expiration_date").isNotNull())

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0))

    def ratio(column: str) -> Column:
        return _ratio(total(f"put_{column}"), total(f"call_{column}"))

    out = [
        F.sum("n").alias("contract_count_total"),
        F.sum("ok").alias("contract_count_eligible"),
        F.try_divide(F.sum("ok"), F.sum("n")).alias("eligible_contract_ratio"),
        F.sum("zero").alias("zero_dte_contract_count"),
        F.try_divide(F.sum("zero"), F.sum("n")).alias("zero_dte_contract_ratio"),
        F.sum("call").alias("eligible_call_count"),
        F.sum("put").alias("eligible_put_count"),
        expirations("ok").alias("eligible_expiration_count"),
        F.min("dte_min").alias("eligible_dte_min"),
        F.max("dte_max").alias("eligible_dte_max"),
        ratio("openInterest").alias("put_call_open_interest_ratio"),
        ratio("totalVolume").alias("put_call_volume_ratio"),
        (total("call_openInterest") + total("put_openInterest")).alias("open_interest_total"),
        (total("call_totalVolume") + total("put_totalVolume")).alias("option_volume_total"),
        F.max("spot").alias("spot"),
        F.sum("atm").alias("atm_contract_count"),
        expirations("atm").alias("atm_expiration_count"),
    ]
    for name in opt.BUCKETS:
        out += [
            F.sum(f"atm_{name}").alias(f"atm_contract_count_{name}"),
            expirations(f"atm_{name}").alias(f"atm_expiration_count_{name}"),
        ]
    return per_expiration.groupBy(*KEYS).agg(*out)


def atm_iv_by_bucket(prepared: DataFrame) -> DataFrame:
    """Median volatility, contracts and expirations of at-the-money contracts per bucket, long."""
    atm = prepared.filter("eligible_contract and is_atm").withColumn("bucket", opt.feature_bucket(F.col("expiration_dte")))
    keys = [*KEYS, "bucket"]
    # Medians, counts and groups read the few columns of these rows, so contracts are prepared once.
    rows = cut_lineage(atm.filter("bucket is not null").select(*keys, "expiration_date", "volatility"), "atm")
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contracts"), F.countDistinct("expiration_date").alias("expirations")
    )
    return quantiles.grouped_medians(rows, keys, {"atm_iv_median": F.col("volatility")}).join(counts, keys)


def _medians(prepared: DataFrame) -> DataFrame:
    atm = F.col("is_atm")
    bucket = opt.feature_bucket(F.col("expiration_dte"))
    volatility = F.col("volatility")
    values = {
        "relative_spread_pct_median": F.col("relative_spread_pct"),
        "atm_relative_spread_pct_median": F.when(atm, F.col("relative_spread_pct")),
        "iv_median": volatility,
        "atm_iv_median": F.when(atm, volatility),
        "atm_call_iv_median": F.when(atm & (F.col("put_call") == "CALL"), volatility),
        "atm_put_iv_median": F.when(atm & (F.col("put_call") == "PUT"), volatility),
        "abs_delta_median": F.abs("delta"),
        "gamma_median": F.col("gamma"),
        "theta_median": F.col("theta"),
        "vega_median": F.col("vega"),
        "canonical_extrinsic_value_median": F.col("canonical_extrinsic_value"),
        "quote_age_minutes_median": F.col("quote_age_minutes"),
    }
    values |= {f"atm_iv_median_{name}": F.when(atm & (bucket == name), volatility) for name in opt.BUCKETS}
    return quantiles.grouped_medians(prepared.filter("eligible_contract"), KEYS, values)


def _scoped(prepared: DataFrame) -> DataFrame:
    """Eligible contracts once for all maturities and once for their bucket."""
    bucket = opt.feature_bucket(F.col("expiration_dte"))
    scopes = F.array_compact(F.array(F.lit("all"), bucket))
    return prepared.filter("eligible_contract and expiration_date is not null").withColumn("scope", F.explode(scopes))


def matched_delta_skew(prepared: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """Per expiration: volatility of the put nearest -0.25 less that of the call nearest +0.25.

    The nearest contract is an aggregate (minimum by distance, then by the
    tie-break columns), so contracts of an expiration are never sorted in a task.
    """
    order = tie_break or ["contract_index"]

    def nearest(side: str, target: float) -> Column:
        hit = (F.col("put_call") == side) & F.col("volatility").isNotNull() & F.col("delta").isNotNull()
        rank = F.struct(F.abs(F.col("delta") - target).alias("distance"), *order)
        return F.min_by("volatility", F.when(hit, rank))

    return (
        _scoped(prepared)
        .groupBy(*KEYS, "scope", "expiration_date")
        .agg(nearest("CALL", TARGET_DELTA).alias("call_iv"), nearest("PUT", -TARGET_DELTA).alias("put_iv"))
        .filter("call_iv is not null and put_iv is not null")
        .withColumn("skew", F.col("put_iv") - F.col("call_iv"))
    )


def matched_atm_skew(prepared: DataFrame) -> DataFrame:
    """Per expiration: median put volatility less median call volatility, at the money."""
    keys = [*KEYS, "scope", "expiration_date"]
    sides = {
        f"{side.lower()}_iv": F.when(F.col("put_call") == side, F.col("volatility")) for side in ("CALL", "PUT")
    }
    return (
        quantiles.grouped_medians(_scoped(prepared).filter("is_atm"), keys, sides)
        .filter("call_iv is not null and put_iv is not null")
        .withColumn("skew", F.col("put_iv") - F.col("call_iv"))
    )


def _skew_columns(skews: DataFrame, overall: str, overall_count: str, prefix: str, count_prefix: str) -> DataFrame:
    out = []
    for scope, value, count in [
        ("all", overall, overall_count),
        *[(b, f"{prefix}_{b}", f"{count_prefix}_{b}") for b in opt.BUCKETS],
    ]:
        hit = F.col("scope") == scope
        out += [F.percentile(F.when(hit, F.col("skew")), 0.5).alias(value), F.count_if(hit).alias(count)]
    return skews.groupBy(*KEYS).agg(*out)


def symbol_option_features(
    prepared: DataFrame, tie_break: list[str] | None = None
) -> DataFrame:
    """One feature row per run and symbol: counts, ratios, medians, bucket volatilities, skews and term spread."""
    delta = _skew_columns(
        matched_delta_skew(prepared, tie_break), "delta_25_put_call_iv_skew_matched_median",
        "delta_25_expiration_pair_count", "delta_25_put_call_iv_skew", "delta_25_pair_count",
    )
    atm = _skew_columns(
        matched_atm_skew(prepared), "atm_put_call_iv_skew_matched_median", "atm_expiration_pair_count",
        "atm_put_call_iv_skew", "atm_skew_pair_count",
    )
    joined = reduce(lambda a, b: a.join(b, KEYS, "left"), [_counts(prepared), _medians(prepared), delta, atm])
    pair_counts = [c for c in [*delta.columns, *atm.columns] if "pair_count" in c]
    spread = F.col("atm_iv_median_dte_91_365") - F.col("atm_iv_median_dte_8_30")
    return (
        joined.na.fill(0, pair_counts)
        .withColumn("atm_iv_term_spread_91_365_minus_8_30", spread)
        .withColumn("feature_schema_version", F.lit(SCHEMA_VERSION))
    )


def eligibility_summary(prepared: DataFrame) -> DataFrame:
    """Counts per symbol and the failed checks as sorted JSON text."""
    n, ok = F.count(F.lit(1)), F.count_if("eligible_contract")
    failed = [(c, F.count_if(~F.col(f"eligibility__{c}"))) for c in sorted(opt.CHECKS)]
    body = F.concat_ws(",", *[F.when(v > 0, F.concat(F.lit(f'"{c}":'), v.cast("string"))) for c, v in failed])
    return prepared.groupBy(*KEYS).agg(
        n.alias("contract_count_total"),
        ok.alias("contract_count_eligible"),
        F.try_divide(ok, n).alias("eligible_contract_ratio"),
        (n - ok).alias("ineligible_contract_count"),
        F.concat(F.lit("{"), body, F.lit("}")).alias("ineligibility_reason_counts"),
    )
