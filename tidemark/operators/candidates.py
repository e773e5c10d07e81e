"""Ranked candidate hand-offs: contract checks, one-session snapshots and their allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import allocators, covariance, returns
from tidemark.session import cut_lineage

# Column contracts of the two hand-off tables, in order.
CANDIDATE_COLUMNS = (
    "handoff_contract_version", "scanner_alpha_spec_version", "scanner_provider", "as_of_session",
    "generated_at_utc", "scanner_snapshot_sha256", "source_alpha_manifest_sha256", "source_timestamp_utc", "symbol",
    "scanner_rank", "scanner_score", "scanner_percentile", "scanner_eligible", "close", "primary_signal_name",
    "primary_signal_value", "ema_50_to_200",
)
ALLOCATION_COLUMNS = (
    "allocation_contract_version", "as_of_session", "scanner_snapshot_sha256", "source_candidate_history_sha256",
    "source_candidate_csv_sha256", "source_candidate_manifest_sha256", "symbol", "scanner_rank", "scanner_score",
    "scanner_percentile", "close", "optimizer_name", "optimizer_version", "covariance_estimator", "lookback_returns",
    "annualized_volatility", "target_weight",
)
HANDOFF_VERSION = "scanner-candidate-handoff-v1"
ALPHA_SPEC_VERSION = "scanner-alpha-v1"
ALLOCATION_VERSION = "scanner-candidate-allocation-v1"
PRIMARY_SIGNAL = "momentum_252d_ex_20d"
OPTIMIZER, OPTIMIZER_VERSION, ESTIMATOR = "minimum_variance_ledoit_wolf", "1.0.0", "ledoit_wolf"
LOOKBACK, MAX_WEIGHT = 252, 0.10
SNAPSHOT = ["as_of_session", "scanner_snapshot_sha256"]


def column_violations(frame: DataFrame, contract=CANDIDATE_COLUMNS) -> list[str]:
    """Differences between a frame's columns and an ordered contract; schema only, no job."""
    found = list(frame.columns)
    problems = [f"missing {c}" for c in contract if c not in found] + [f"extra {c}" for c in found if c not in contract]
    return problems or ([] if found == list(contract) else ["column order differs"])


def _finite(column: str) -> Column:
    number = F.expr(f"try_cast({column} as double)")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Long table of broken rules with the number of rows breaking each, per snapshot.

    Row rules are counted in one aggregate. Uniqueness and rank continuity come
    from distinct counts and extremes, so no snapshot is sorted in one task.
    """
    symbol = F.upper(F.trim("symbol"))
    rank = F.expr("try_cast(scanner_rank as double)")
    source = F.expr("try_cast(source_timestamp_utc as timestamp)")
    generated = F.expr("try_cast(generated_at_utc as timestamp)")
    row_rules = {
        "CONTRACT_VERSION": F.col("handoff_contract_version") != HANDOFF_VERSION,
        "ALPHA_SPEC_VERSION": F.col("scanner_alpha_spec_version") != ALPHA_SPEC_VERSION,
        "PRIMARY_SIGNAL": F.trim("primary_signal_name") != PRIMARY_SIGNAL,
        "EMPTY_SYMBOL": symbol.isNull() | (symbol == ""),
        "NOT_ELIGIBLE": ~F.coalesce(parse_flag("scanner_eligible"), F.lit(False)),
        "RANK_NOT_POSITIVE_INTEGER": rank.isNull() | (rank <= 0) | (rank != F.floor(rank)),
        "SCORE_NOT_FINITE": ~_finite("scanner_score"),
        "SIGNAL_NOT_FINITE": ~_finite("primary_signal_value"),
        "CLOSE_NOT_POSITIVE": ~_finite("close") | (F.expr("try_cast(close as double)") <= 0),
        "PERCENTILE_OUT_OF_RANGE": ~_finite("scanner_percentile")
        | ~F.expr("try_cast(scanner_percentile as double)").between(0.0, 100.0),
        "CONTEXT_NOT_NUMERIC": F.col("ema_50_to_200").isNotNull() & F.expr("try_cast(ema_50_to_200 as double) is null"),
        "TIMESTAMP_INVALID": source.isNull() | generated.isNull(),
        "TIMESTAMP_OUTSIDE_SESSION": source.isNotNull()
        & (F.date_format(source, "yyyy-MM-dd") != F.col("as_of_session").cast("string")),
        "TIMESTAMP_AFTER_GENERATION": source > generated,
    }
    counts = {name: F.count_if(F.coalesce(broken, F.lit(True))) for name, broken in row_rules.items()}
    counts["DUPLICATE_SYMBOL"] = F.count(symbol) - F.countDistinct(symbol)
    counts["DUPLICATE_RANK"] = F.count(rank) - F.countDistinct(rank)
    counts["RANKS_NOT_CONTIGUOUS"] = F.when(
        (F.min(rank) == 1) & (F.max(rank) == F.count(F.lit(1))) & (F.countDistinct(rank) == F.count(F.lit(1))), 0
    ).otherwise(1)
    wide = candidates.groupBy(*SNAPSHOT).agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    return wide.unpivot(SNAPSHOT, list(counts), "rule", "violations").filter("violations > 0")


def parse_flag(column: str) -> Column:
    """Booleans written as text."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text.isin("true", "1", "yes", "y", "t"), True).when(text.isin("false", "0", "no", "n", "f"), False)


def candidate_snapshot(history: DataFrame, session: str | None = None) -> DataFrame:
    """Candidates of a session with checks: a session needs one snapshot, ranks 1..n and unique symbols."""
    rows = history if session is None else history.filter(F.col("as_of_session") == session)
    upper = F.upper("symbol")
    n = F.count(F.lit(1))
    good = rows.groupBy("as_of_session").agg(
        (
            (F.countDistinct("scanner_snapshot_sha256") == 1)
            & (F.countDistinct(upper) == n)
            & (F.countDistinct("scanner_rank") == n)
            & (F.min("scanner_rank") == 1)
            & (F.max("scanner_rank") == n)
        ).alias("ok")
    )
    return rows.withColumn("symbol", upper).join(good.filter("ok").drop("ok"), "as_of_session")


def candidate_allocation(
    history: DataFrame, prices: DataFrame, lookback: int = LOOKBACK, high: float = MAX_WEIGHT, periods: int = 252,
    history_sha: str = "",
) -> DataFrame:
    """Minimum-variance weights of every session's candidates from synchronised lookback returns.

    Each session is its own universe, so all sessions are allocated at once.
    Scores and ranks are carried along and never enter the optimisation.
    """
    picked = candidate_snapshot(history)
    names = picked.select(
        F.col("as_of_session").cast("string").alias("universe_id"),
        F.to_date("as_of_session").alias("as_of"),
        F.col("symbol").alias("asset"),
    )
    own = prices.drop("universe_id").join(names, "asset").filter("session <= as_of")
    dates = names.select("universe_id", "as_of").distinct()
    rets = cut_lineage(returns.lookback_returns(own.select("universe_id", "session", "asset", "close"), dates, lookback))
    sums = cut_lineage(covariance.pair_sums(rets.filter(F.col("observations") == lookback)))
    cov = cut_lineage(covariance.shrunk_from_sums(sums, periods).drop("shrinkage").join(dates, "universe_id"))
    weights = allocators.solved_weights(cov, models=("minimum_variance",), high=high)
    own_vol = cov.filter("asset_i = asset_j").select(
        "universe_id", F.col("asset_i").alias("asset"), F.sqrt("cov").alias("annualized_volatility")
    )
    joined = (
        weights.join(own_vol, ["universe_id", "asset"])
        .withColumnsRenamed({"universe_id": "as_of_session", "asset": "symbol", "weight": "target_weight"})
        .join(picked.withColumn("as_of_session", F.col("as_of_session").cast("string")), ["as_of_session", "symbol"])
        .withColumns(
            {
                "allocation_contract_version": F.lit(ALLOCATION_VERSION),
                "source_candidate_history_sha256": F.lit(history_sha),
                "optimizer_name": F.lit(OPTIMIZER),
                "optimizer_version": F.lit(OPTIMIZER_VERSION),
                "covariance_estimator": F.lit(ESTIMATOR),
                "lookback_returns": F.lit(lookback),
            }
        )
    )
    for name in ("source_candidate_csv_sha256", "source_candidate_manifest_sha256"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(""))
    return joined.select(*ALLOCATION_COLUMNS)
