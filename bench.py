"""Headline benchmark: seconds per query on one node, as a single JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = (
    "return_summary",
    "nation_return_summary",
    "period_returns",
    "strategy_cost_grid",
    "backtest_summary",
    "blend_table",
    "ledoit_wolf",
    "expanding_ledoit_wolf",
    "risk_contributions",
    "expected_returns",
    "regime_features",
    "macro_features",
    "walk_forward",
    "ridge_purged",
    "phase_cost_grid",
    "block_bootstrap_report",
    "normalize_option_chain",
    "normalize_price_history",
    "prepare_contracts",
    "symbol_option_features",
    "validate_options",
    "option_coverage",
    "quantile_profile",
    "column_profile",
    "audit_option_chain",
    "classify_append",
    "table_fingerprint",
    "rebalance_plan",
    "execution_targets",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    queries = catalog.queries()
    # One untimed query starts the JVM, the code cache and the Python workers.
    queries["return_summary"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
