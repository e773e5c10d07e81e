"""Quality gates on option features: symbol class, support rules and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.options import BUCKETS

KEYS = ["run_id", "underlying_symbol"]
# Thresholds of ratio, contracts and expirations, and minimum support counts.
PASS_LIMITS = (0.80, 100, 10)
CAUTION_LIMITS = (0.50, 50, 5)
MIN_PAIRS, MIN_BUCKET_PAIRS, MIN_ATM_CONTRACTS = 10, 5, 20
MEASURES = ("eligible_contract_ratio", "contract_count_eligible", "eligible_expiration_count")
REASONS = ("eligible_contract_ratio", "eligible_contract_count", "eligible_expiration_count")
TERM_FEATURE = "atm_iv_term_spread_91_365_minus_8_30"
TERM_SUPPORT = ("atm_contract_count_dte_8_30", "atm_contract_count_dte_91_365")

FEATURE_RULES = {
    "delta_25_put_call_iv_skew_matched_median": ("delta_25_expiration_pair_count", MIN_PAIRS, "OVERALL_MATCHED_PAIR_SUPPORT"),
    "atm_put_call_iv_skew_matched_median": ("atm_expiration_pair_count", MIN_PAIRS, "OVERALL_MATCHED_PAIR_SUPPORT"),
}
for _b in BUCKETS:
    FEATURE_RULES[f"delta_25_put_call_iv_skew_{_b}"] = (f"delta_25_pair_count_{_b}", MIN_BUCKET_PAIRS, "BUCKET_MATCHED_PAIR_SUPPORT")
    FEATURE_RULES[f"atm_put_call_iv_skew_{_b}"] = (f"atm_skew_pair_count_{_b}", MIN_BUCKET_PAIRS, "BUCKET_MATCHED_PAIR_SUPPORT")
    FEATURE_RULES[f"atm_iv_median_{_b}"] = (f"atm_contract_count_{_b}", MIN_ATM_CONTRACTS, "ATM_BUCKET_CONTRACT_SUPPORT")

PLAIN_FEATURES = [
    "relative_spread_pct_median", "atm_relative_spread_pct_median", "iv_median", "atm_iv_median", "atm_call_iv_median",
    "atm_put_iv_median", "put_call_open_interest_ratio", "put_call_volume_ratio", "open_interest_total",
    "option_volume_total", "abs_delta_median", "gamma_median", "theta_median", "vega_median",
    "canonical_extrinsic_value_median", "quote_age_minutes_median",
]
MODEL_FEATURES = [*PLAIN_FEATURES, *FEATURE_RULES, TERM_FEATURE]


def _above(limits):
    return [F.col(m) >= limit for m, limit in zip(MEASURES, limits)]


def symbol_quality(features: DataFrame) -> DataFrame:
    """PASS, CAUTION or SUPPRESS with the reasons joined by "|"."""
    strong, fair = _above(PASS_LIMITS), _above(CAUTION_LIMITS)
    passed, cautious = strong[0] & strong[1] & strong[2], fair[0] & fair[1] & fair[2]

    def below(tests, level):
        return F.concat_ws("|", *[F.when(~t, f"{name}_below_{level}") for t, name in zip(tests, REASONS)])

    return features.withColumns(
        {
            "quality_symbol_status": F.when(passed, "PASS").when(cautious, "CAUTION").otherwise("SUPPRESS"),
            "quality_symbol_reasons": F.when(passed, "").when(cautious, below(strong, "pass")).otherwise(
                below(fair, "caution")
            ),
        }
    )


def _support(feature: str):
    """(support count, minimum, rule code, support column text) of one feature."""
    if feature == TERM_FEATURE:
        count = F.least(*[F.col(c).cast("double") for c in TERM_SUPPORT])
        return count, MIN_ATM_CONTRACTS, "TERM_STRUCTURE_COMPONENT_SUPPORT", "|".join(TERM_SUPPORT)
    if feature in FEATURE_RULES:
        column, minimum, code = FEATURE_RULES[feature]
        return F.col(column).cast("double"), minimum, code, column
    return None


def feature_support_mask(features: DataFrame, policy_version: str = "1.0.0") -> DataFrame:
    """Feature rows with unsupported values set to NULL; a suppressed symbol loses all of them."""
    graded = symbol_quality(features)
    alive = F.col("quality_symbol_status") != "SUPPRESS"
    masked = {}
    for feature in MODEL_FEATURES:
        rule = _support(feature)
        usable = alive if rule is None else alive & (rule[0] >= rule[1])
        masked[feature] = F.when(usable, F.col(feature))
    return graded.withColumns(masked).withColumn("quality_policy_version", F.lit(policy_version))


def feature_quality(features: DataFrame) -> DataFrame:
    """Long table: one row per symbol and model feature with its rule, support and verdict.

    The rows come from a literal array of structs, an unpivot without a shuffle.
    """
    graded = symbol_quality(features)
    suppressed = F.col("quality_symbol_status") == "SUPPRESS"
    cells = []
    for feature in MODEL_FEATURES:
        rule = _support(feature)
        if rule is None:
            supported, count, minimum, code, column = F.lit(True), F.lit(None), None, "SYMBOL_QUALITY_ONLY", None
            lacking = ""
        else:
            count, minimum, code, column = rule
            supported = F.coalesce(count >= minimum, F.lit(False))
            lacking = "insufficient_term_structure_support" if feature == TERM_FEATURE else "insufficient_feature_support"
        cells.append(
            F.struct(
                F.lit(feature).alias("feature_name"),
                (~suppressed & supported).alias("usable"),
                F.when(suppressed | ~supported, "SUPPRESS").otherwise(F.col("quality_symbol_status")).alias("quality_status"),
                F.when(suppressed, "SYMBOL_QUALITY").otherwise(code).alias("rule_code"),
                F.when(~suppressed, F.lit(column).cast("string")).alias("support_column"),
                F.when(~suppressed, count.cast("double")).alias("support_count"),
                F.when(~suppressed, F.lit(minimum).cast("int")).alias("minimum_support"),
                F.when(suppressed, F.col("quality_symbol_reasons")).when(~supported, lacking).otherwise("").alias("reason"),
            )
        )
    return graded.select(*KEYS, F.explode(F.array(*cells)).alias("q")).select(*KEYS, "q.*")
