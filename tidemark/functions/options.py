"""Column expressions on option contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policy limits and bucket edges.
ATM_PCT = 2.0
MAX_QUOTE_AGE_MINUTES = 30.0
MAX_RELATIVE_SPREAD_PCT = 25.0
DTE_BUCKETS = (
    ("dte_1_7", 1, 7),
    ("dte_8_30", 8, 30),
    ("dte_31_90", 31, 90),
    ("dte_91_365", 91, 365),
    ("dte_366_plus", 366, None),
)
BUCKETS = [name for name, _, _ in DTE_BUCKETS]
PRICE_COLUMNS = ("quote__mark", "quote__lastPrice", "regular__regularMarketLastPrice", "quote__closePrice")
CHECKS = ("spot", "side", "bid", "ask", "mark", "spread", "quote_age", "dte", "volatility", "delta", "gamma", "vega")


def intrinsic_value(side: Column, spot: Column, strike: Column) -> Column:
    return F.when(side == "CALL", F.greatest(spot - strike, F.lit(0.0))).when(
        side == "PUT", F.greatest(strike - spot, F.lit(0.0))
    )


def extrinsic_value(mark: Column, intrinsic: Column) -> Column:
    return mark - intrinsic


def signed_moneyness_pct(side: Column, spot: Column, strike: Column) -> Column:
    """Positive in the money for both sides, in percent of spot."""
    return F.when((side == "CALL") & (spot > 0), (spot - strike) / spot * 100.0).when(
        (side == "PUT") & (spot > 0), (strike - spot) / spot * 100.0
    )


def relative_spread_pct(bid: Column, ask: Column) -> Column:
    mid = (bid + ask) / 2.0
    return F.when(mid > 0, (ask - bid) / mid * 100.0)


def quote_age_minutes(quoted_millis: Column, captured: Column) -> Column:
    """Minutes from the quote (epoch milliseconds) to the capture (UTC timestamp)."""
    quoted = F.timestamp_millis(quoted_millis.cast("long"))
    return (F.unix_micros(captured) - F.unix_micros(quoted)) / 60_000_000.0


def moneyness_bucket(pct: Column) -> Column:
    return (
        F.when(pct <= -10.0, "deep_otm").when(pct < -2.0, "otm").when(pct <= 2.0, "atm").when(pct < 10.0, "itm")
        .when(pct.isNotNull(), "deep_itm")
    )


def dte_bucket(dte: Column) -> Column:
    """Coverage buckets, zero days apart."""
    return (
        F.when(dte <= 0, "0_dte").when(dte <= 7, "1_7").when(dte <= 30, "8_30").when(dte <= 90, "31_90")
        .when(dte <= 365, "91_365").when(dte.isNotNull(), "366_plus")
    )


def feature_bucket(dte: Column) -> Column:
    """Feature buckets; zero days belong to none."""
    out = None
    for name, low, high in DTE_BUCKETS:
        hit = dte >= low if high is None else dte.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def eligibility(
    require_positive_bid: bool = True, exclude_zero_dte: bool = True,
    max_spread: float = MAX_RELATIVE_SPREAD_PCT, max_age: float = MAX_QUOTE_AGE_MINUTES,
) -> dict[str, Column]:
    """The twelve contract checks in report order; a missing input fails its check."""
    c = F.col
    rules = {
        "spot": c("spot") > 0,
        "side": c("put_call").isin("CALL", "PUT"),
        "bid": c("bid") > 0 if require_positive_bid else c("bid") >= 0,
        "ask": c("ask") >= c("bid"),
        "mark": (c("mark") >= c("bid")) & (c("mark") <= c("ask")),
        "spread": c("relative_spread_pct") <= max_spread,
        "quote_age": c("quote_age_minutes").between(0.0, max_age),
        "dte": c("expiration_dte") >= (1 if exclude_zero_dte else 0),
        "volatility": c("volatility") > 0,
        "delta": c("delta").between(-1.0, 1.0),
        "gamma": c("gamma") >= 0,
        "vega": c("vega") >= 0,
    }
    return {f"eligibility__{name}": F.coalesce(rules[name], F.lit(False)) for name in CHECKS}


def all_pass(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) for c in columns])


def failed_names(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.when(~F.col(c), F.lit(c.removeprefix("eligibility__"))) for c in columns])
