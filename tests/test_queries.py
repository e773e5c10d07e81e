"""Registered queries beside their SQL on the smallest tables; the whole list runs in tools/verify.py."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module  # noqa: E402
import verify  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = [
    "monthly_return_summary", "daily_returns", "nation_return_summary", "nation_asset_performance", "active_signal", "signal_date",
    "normalize_weights", "concentration", "macro_features", "asof_forward_fill", "two_asset_allocation", "normalize_quotes",
    "normalize_option_chain", "normalize_market_hours", "normalize_positions_long_only", "snapshot_totals", "prepare_contracts",
    "symbol_option_features", "feature_quality", "validate_options", "audit_dataset", "verify_hashes", "row_record_hash",
    "table_fingerprint", "classify_append", "execution_targets", "rebalance_plan", "stream_append_history", "quantile_profile_sliced",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return verify.connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert verify.compare(verify.table(df.columns, rows), verify.table(names, result.fetchall())) == "ok"


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
