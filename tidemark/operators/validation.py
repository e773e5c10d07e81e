"""Semantic validation of quotes, option chains and price history.

Every rule is a counted predicate: one aggregate pass yields all counts and a
literal array of structs turns them into issue rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import options as opt

ERROR, WARNING = "ERROR", "WARNING"
# Limits of the checks and the research fields tested for being constant.
WIDE_SPREAD_PCT = 25.0
MAX_QUOTE_AGE = 30.0
FUTURE_QUOTE_MINUTES = -5.0
EXTREME_PERCENT = 1000.0
MARK_TOLERANCE, DELTA_TOLERANCE = 1e-8, 1e-6
RESEARCH_FIELDS = (
    "bid", "ask", "mark", "last", "volatility", "delta", "gamma", "theta", "vega", "rho", "openInterest", "totalVolume",
    "timeValue", "intrinsicValue", "extrinsicValue", "theoreticalOptionValue", "theoreticalVolatility",
)
OPTION_COLUMNS = (
    "underlying_symbol", "put_call", "strike", "expiration_dte", "bid", "ask", "mark", "volatility", "delta", "gamma", "vega",
)


def _issues(table: DataFrame, keys: list[str], dataset: str, rules: list[tuple[str, str, Column]], whole: list | None = None) -> DataFrame:
    """Issue rows from row predicates (with percentages) and whole-table counts (without)."""
    whole = whole or []
    counted = [F.count_if(F.coalesce(broken, F.lit(False))).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)]
    extra = [value.cast("long").alias(f"w{i}") for i, (_, _, value) in enumerate(whole)]
    sums = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counted, *extra)
    cells = [
        F.struct(
            F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(f"r{i}").alias("count"),
            F.try_divide(100.0 * F.col(f"r{i}"), F.col("rows")).alias("percentage"),
        )
        for i, (level, code, _) in enumerate(rules)
    ] + [
        F.struct(
            F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(f"w{i}").alias("count"),
            F.lit(None).cast("double").alias("percentage"),
        )
        for i, (level, code, _) in enumerate(whole)
    ]
    return (
        sums.select(*keys, F.explode(F.array(*cells)).alias("i"))
        .select(*keys, "i.level", "i.code", F.lit(dataset).alias("dataset"), "i.count", "i.percentage")
        .filter("count > 0")
    )


def _missing_columns(table: DataFrame, columns, code: str, dataset: str, keys: list[str]) -> DataFrame | None:
    gone = [c for c in columns if c not in table.columns]
    if not gone:
        return None
    return table.select(*keys).distinct().select(
        *keys, F.lit(ERROR).alias("level"), F.lit(code).alias("code"), F.lit(dataset).alias("dataset"),
        F.lit(len(gone)).cast("long").alias("count"), F.lit(None).cast("double").alias("percentage"),
    )


def validate_options(options: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Quote, greek, maturity, staleness and constant-field rules of option rows, per run."""
    keys = keys or ["run_id"]
    c = F.col
    spread = opt.relative_spread_pct(c("bid"), c("ask"))
    rules = [
        (ERROR, "NEGATIVE_OPTION_BID_ASK", (c("bid") < 0) | (c("ask") < 0)),
        (ERROR, "CROSSED_OPTION_MARKET", c("bid") > c("ask")),
        (WARNING, "OPTION_MARK_OUTSIDE_BID_ASK",
         (c("mark") < c("bid") - MARK_TOLERANCE) & c("ask").isNotNull() | (c("mark") > c("ask") + MARK_TOLERANCE) & c("bid").isNotNull()),
        (WARNING, "WIDE_OPTION_SPREAD", spread > WIDE_SPREAD_PCT),
        (WARNING, "ZERO_OPTION_BID", c("bid") == 0),
        (ERROR, "NONPOSITIVE_OPTION_IV", c("volatility") <= 0),
        (ERROR, "OPTION_DELTA_OUT_OF_RANGE", F.abs("delta") > 1.0 + DELTA_TOLERANCE),
        (ERROR, "NEGATIVE_OPTION_GAMMA", c("gamma") < 0),
        (ERROR, "NEGATIVE_OPTION_VEGA", c("vega") < 0),
        (WARNING, "ZERO_DTE_OPTIONS_PRESENT", c("expiration_dte") == 0),
        (WARNING, "STALE_OPTION_QUOTE", c("quote_age_minutes") > MAX_QUOTE_AGE),
        (WARNING, "OPTION_QUOTE_AFTER_CAPTURE", c("quote_age_minutes") < FUTURE_QUOTE_MINUTES),
    ]
    rules += [
        (WARNING, "EXTREME_OPTION_PERCENT_CHANGE", F.abs(name) > EXTREME_PERCENT)
        for name in ("percentChange", "markPercentChange")
        if name in options.columns
    ]
    rules += [
        (WARNING, "NEGATIVE_OPTION_VALUE_COMPONENT", c(name) < 0)
        for name in ("intrinsicValue", "extrinsicValue")
        if name in options.columns
    ]
    present = [f for f in RESEARCH_FIELDS if f in options.columns]
    # Constant means smallest = largest, which needs no distinct set.
    constant = sum((F.coalesce((F.min(f) == F.max(f)).cast("int"), F.lit(0)) for f in present), F.lit(0))
    out = _issues(options, keys, "option_chains", rules, [(WARNING, "CONSTANT_OPTION_RESEARCH_FIELD", constant)])
    gone = _missing_columns(options, OPTION_COLUMNS, "OPTION_REQUIRED_COLUMNS_MISSING", "option_chains", keys)
    return out if gone is None else out.unionByName(gone)


def validate_quotes(quotes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["run_id"]
    c = F.col
    rules = [
        (ERROR, "CROSSED_UNDERLYING_QUOTE", c("quote__bidPrice") > c("quote__askPrice")),
        (ERROR, "NONPOSITIVE_UNDERLYING_MARK", c("quote__mark") <= 0),
        (WARNING, "STALE_UNDERLYING_QUOTE", c("quote_age_minutes") > MAX_QUOTE_AGE),
    ]
    return _issues(quotes, keys, "quotes", rules)


def validate_price_history(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, range and zero-volume share per symbol."""
    keys = keys or ["run_id"]
    zero = F.count_if(F.col("volume") == 0)
    return history.groupBy(*keys, F.upper("symbol").alias("symbol")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("datetime_utc").alias("start_utc"),
        F.max("datetime_utc").alias("end_utc"),
        zero.alias("zero_volume_count"),
        (F.try_divide(100.0 * zero, F.count(F.lit(1)))).alias("zero_volume_pct"),
    )


# Codes of an empty dataset and the columns price history needs.
EMPTY_CODES = {"option_chains": "OPTION_DATASET_EMPTY", "quotes": "QUOTE_DATASET_EMPTY", "price_history": "PRICE_HISTORY_EMPTY"}
HISTORY_COLUMNS = ("symbol", "datetime_utc")


def empty_dataset(runs: DataFrame, table: DataFrame, dataset: str, keys: list[str] | None = None) -> DataFrame:
    """An error for every run without a row of the dataset."""
    keys = keys or ["run_id"]
    return runs.select(*keys).distinct().join(table.select(*keys), keys, "left_anti").select(
        *keys, F.lit(ERROR).alias("level"), F.lit(EMPTY_CODES[dataset]).alias("code"), F.lit(dataset).alias("dataset"),
        F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("percentage"),
    )


def price_history_columns(history: DataFrame, keys: list[str] | None = None) -> DataFrame | None:
    """The issue of a history table without symbol or time, or None."""
    return _missing_columns(
        history, HISTORY_COLUMNS, "PRICE_HISTORY_REQUIRED_COLUMNS_MISSING", "price_history", keys or ["run_id"]
    )


def option_coverage(prepared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per symbol: sides, expirations, illiquid, wide and stale contracts and counts per bucket as maps."""
    keys = keys or ["run_id", "underlying_symbol"]
    c, n = F.col, F.count(F.lit(1))

    def counts(labels, bucket: Column) -> Column:
        entries = [F.struct(F.lit(name).alias("key"), F.count_if(bucket == name).alias("value")) for name in labels]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))

    out = []
    for name, broken in {
        "zero_bid": c("bid") == 0,
        "zero_volume": c("totalVolume") == 0,
        "zero_open_interest": c("openInterest") == 0,
        "wide_spread": c("relative_spread_pct") > WIDE_SPREAD_PCT,
        "stale_quote": c("quote_age_minutes") > MAX_QUOTE_AGE,
    }.items():
        out += [F.count_if(broken).alias(f"{name}_count"), F.try_divide(100.0 * F.count_if(broken), n).alias(f"{name}_pct")]
    dte = opt.dte_bucket(c("expiration_dte"))
    money = opt.moneyness_bucket(c("signed_moneyness_pct"))
    return prepared.groupBy(*keys).agg(
        n.alias("contracts"),
        F.count_if(c("put_call") == "CALL").alias("calls"),
        F.count_if(c("put_call") == "PUT").alias("puts"),
        F.countDistinct("expiration_date").alias("expiration_count"),
        F.min("expiration_dte").alias("dte_min"),
        F.max("expiration_dte").alias("dte_max"),
        *out,
        counts(("0_dte", "1_7", "8_30", "31_90", "91_365", "366_plus"), dte).alias("contracts_by_dte_bucket"),
        counts(("deep_otm", "otm", "atm", "itm", "deep_itm"), money).alias("contracts_by_moneyness"),
    )


def validation_status(issues: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL on any error, PASS_WITH_WARNINGS on any warning; keys without issues are PASS where listed by the caller."""
    errors, warnings = F.count_if(F.col("level") == ERROR), F.count_if(F.col("level") == WARNING)
    return issues.groupBy(*keys).agg(
        errors.alias("error_count"),
        warnings.alias("warning_count"),
        F.when(errors > 0, "FAIL").when(warnings > 0, "PASS_WITH_WARNINGS").otherwise("PASS").alias("status"),
    )


def gated_runs(issues: DataFrame, runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Status of every run, PASS included; feature building keeps the runs that do not FAIL."""
    keys = keys or ["run_id"]
    return runs.select(*keys).distinct().join(validation_status(issues, keys), keys, "left").na.fill(
        {"error_count": 0, "warning_count": 0, "status": "PASS"}
    )
