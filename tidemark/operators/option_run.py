"""One option-feature build per capture run: gate, features, quality and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history, option_features, option_quality, validation
from tidemark.session import cut_lineage


def build_option_features(contracts: DataFrame, quotes: DataFrame, tie_break: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked feature rows of the runs that pass validation, status of every run)."""
    prepared = cut_lineage(option_features.prepare_contracts(contracts, option_features.spot_map(quotes)))
    issues = validation.validate_options(prepared).unionByName(validation.validate_quotes(quotes))
    status = cut_lineage(validation.gated_runs(issues, prepared))
    accepted = prepared.join(status.filter("status <> 'FAIL'").select("run_id"), "run_id", "left_semi")
    features = cut_lineage(option_features.symbol_option_features(accepted, tie_break))
    return option_quality.feature_support_mask(features), status


def append_option_history(masked: DataFrame, captured_at: str, path: str, dry_run: bool = False) -> history.AppendReport:
    """Add the masked features of a capture to the history table, one row per history key."""
    rows = masked.withColumn("capture_timestamp_utc", F.lit(captured_at))
    return history.idempotent_append(path, rows, history.OPTION_HISTORY_KEY, dry_run=dry_run, partition_by=["run_id"])
