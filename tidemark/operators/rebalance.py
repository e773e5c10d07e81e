"""Whole-share targets and rebalance plans for many accounts.

Plan inputs are long: ``account_id, asset, shares``, ``account_id, cash``,
``asset, price`` and ``account_id, asset, target_weight``. Windows hold the
assets of one account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import record_hash

# Contract constants, side and status names, rounding slack and default cost.
TARGET_VERSION, BUILDER_VERSION = "portfolio-target-handoff-v1", "1.2.0"
ALLOCATION_VERSION = "scanner-candidate-allocation-v1"
PRICE_FROM_ALLOCATION, PRICE_FROM_POSITION = "scanner_allocation_close", "position_snapshot"
EXECUTION_STATES = ("DRY_RUN", "PAPER")
TARGET_COLUMNS = (
    "handoff_contract_version", "target_builder_version", "as_of_session", "allocation_contract_version",
    "allocation_sha256", "allocation_manifest_sha256", "scanner_snapshot_sha256", "symbol", "scanner_rank",
    "approved_target_weight", "reference_price", "reference_price_source", "portfolio_capital", "target_dollar_value",
    "target_shares", "target_share_notional", "realized_target_weight", "weight_rounding_error", "target_status",
    "current_position", "share_delta", "trade_side", "execution_state",
)
CASH_SLACK = 1e-8
COST_BPS = 5.0
ZERO_WEIGHT = 1e-15


def _side(delta):
    return F.when(delta > 0, "BUY").when(delta < 0, "SELL").otherwise("HOLD")


def execution_targets(
    allocation: DataFrame, positions: DataFrame, capital: DataFrame, keys: list[str], state: str = "DRY_RUN"
) -> DataFrame:
    """Targets over the union of allocated and held symbols.

    ``allocation``: keys, symbol, scanner_rank, target_weight, close.
    ``positions``: keys, symbol, current_position, reference_price.
    ``capital``: keys, portfolio_capital. A symbol only held is sold out at its position price.
    """
    if state not in EXECUTION_STATES:
        raise ValueError(f"execution state must be one of {EXECUTION_STATES}")
    symbol = F.upper(F.trim("symbol"))
    left = allocation.withColumn("symbol", symbol)
    right = positions.withColumn("symbol", symbol)
    weight = F.coalesce("target_weight", F.lit(0.0))
    price = F.coalesce("close", "reference_price")
    shares = F.floor(F.try_divide(F.col("portfolio_capital") * F.col("approved_target_weight"), F.col("price"))).cast("long")
    held = F.coalesce("current_position", F.lit(0)).cast("long")
    joined = left.join(right, [*keys, "symbol"], "full").join(capital, keys)
    rows = joined.withColumns(
        {
            "approved_target_weight": weight,
            "price": price,
            "reference_price_source": F.when(F.col("close").isNotNull(), PRICE_FROM_ALLOCATION).otherwise(PRICE_FROM_POSITION),
            "current_position": held,
        }
    ).withColumn("target_shares", shares)
    notional = F.col("target_shares") * F.col("price")
    status = (
        F.when((F.col("approved_target_weight") <= ZERO_WEIGHT) & (F.col("current_position") > 0), "EXIT")
        .when(F.col("approved_target_weight") <= ZERO_WEIGHT, "ZERO_WEIGHT")
        .when(F.col("target_shares") == 0, "ROUNDING_TO_ZERO")
        .otherwise("TARGETED")
    )
    return rows.withColumns(
        {
            "target_dollar_value": F.col("portfolio_capital") * F.col("approved_target_weight"),
            "target_share_notional": notional,
            "realized_target_weight": F.try_divide(notional, F.col("portfolio_capital")),
            "weight_rounding_error": F.col("approved_target_weight") - F.try_divide(notional, F.col("portfolio_capital")),
            "target_status": status,
            "share_delta": F.col("target_shares") - F.col("current_position"),
            "trade_side": _side(F.col("target_shares") - F.col("current_position")),
            "execution_state": F.lit(state),
        }
    ).drop("close", "target_weight", "reference_price").withColumnRenamed("price", "reference_price")


def contract_targets(targets: DataFrame, allocation_sha256: str = "", manifest_sha256: str = "") -> DataFrame:
    """The 23-column hand-off in contract order."""
    constants = {
        "handoff_contract_version": F.lit(TARGET_VERSION),
        "target_builder_version": F.lit(BUILDER_VERSION),
        "allocation_contract_version": F.lit(ALLOCATION_VERSION),
        "allocation_sha256": F.lit(allocation_sha256),
        "allocation_manifest_sha256": F.lit(manifest_sha256),
    }
    return targets.withColumns(constants).select(*TARGET_COLUMNS)


def target_totals(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per status and side, notional, residual cash and rounding error."""
    out = [F.count_if(F.col("target_status") == s).alias(f"{s.lower()}_count") for s in ("TARGETED", "ZERO_WEIGHT", "ROUNDING_TO_ZERO", "EXIT")]
    out += [F.count_if(F.col("trade_side") == s).alias(f"{s.lower()}_count") for s in ("BUY", "SELL", "HOLD")]
    return targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *out,
        F.sum("target_share_notional").alias("target_notional"),
        (F.max("portfolio_capital") - F.sum("target_share_notional")).alias("residual_cash"),
        F.sum("realized_target_weight").alias("realized_weight_sum"),
        F.sum("weight_rounding_error").alias("total_weight_rounding_error"),
    )


def repair_cash(plan: DataFrame, cost_bps: float) -> DataFrame:
    """Give up BUY shares until cash is not negative.

    After flooring, dropping one share of an asset adds its price to the
    allocation error, so shares go in (price, asset) order. The freed cash is a
    running sum along that order and the number of shares per asset a ceiling;
    nothing is iterated. Needs ``shares, target_shares, price, cash``.
    """
    account = Window.partitionBy("account_id")
    rate = 1.0 + cost_bps / 10000.0
    trade = F.col("target_shares") - F.col("shares")
    spent = F.sum(trade * F.col("price") + F.abs(trade) * F.col("price") * cost_bps / 10000.0).over(account)
    order = account.orderBy(F.round("price", 9), "asset").rowsBetween(Window.unboundedPreceding, -1)
    buys = F.greatest(trade, F.lit(0))
    freed = buys * F.col("price") * rate
    rows = plan.withColumns({"deficit": spent - F.col("cash"), "buys": buys, "freed": freed}).withColumn(
        "freed_before", F.coalesce(F.sum("freed").over(order), F.lit(0.0))
    )
    left = F.col("deficit") - F.col("freed_before") - CASH_SLACK
    removed = F.when(
        (left > 0) & (F.col("buys") > 0),
        F.least(F.col("buys"), F.ceil(F.try_divide(left, F.col("price") * rate))),
    ).otherwise(0)
    return (
        rows.withColumn("removed_shares", removed.cast("long"))
        .withColumn("target_shares", F.col("target_shares") - F.col("removed_shares"))
        .drop("deficit", "buys", "freed", "freed_before")
    )


def plan_issues(cash: DataFrame, prices: DataFrame, targets: DataFrame) -> DataFrame:
    """``account_id, issue, subject`` of accounts that cannot be planned: targets without a positive price, or no cash row."""
    priced = prices.filter("price > 0").select("asset").distinct()
    unpriced = targets.join(priced, "asset", "left_anti").select("account_id", F.lit("MISSING_PRICE").alias("issue"), F.col("asset").alias("subject"))
    broke = targets.select("account_id").distinct().join(cash.filter("cash is not null").select("account_id"), "account_id", "left_anti")
    return unpriced.unionByName(broke.select("account_id", F.lit("MISSING_CASH").alias("issue"), F.lit(None).cast("string").alias("subject")))


def rebalance_plan(
    positions: DataFrame, cash: DataFrame, prices: DataFrame, targets: DataFrame, cost_bps: float = COST_BPS
) -> DataFrame:
    """Trades, cost, cash and weights after the trade per account and asset.

    Every (account, asset) of the target table is planned; holdings outside it
    are not part of the plan's universe. Accounts without positive value are left
    out, and so are accounts with a ``plan_issues`` row: half a plan is none.
    """
    account = Window.partitionBy("account_id")
    refused = plan_issues(cash, prices, targets).select("account_id").distinct()
    targets = targets.join(refused, "account_id", "left_anti")
    rows = (
        targets.join(positions, ["account_id", "asset"], "left")
        .join(cash, "account_id")
        .join(prices, "asset")
        .withColumn("shares", F.coalesce("shares", F.lit(0)).cast("long"))
    )
    value = F.sum(F.col("shares") * F.col("price")).over(account) + F.col("cash")
    floored = (
        rows.withColumn("portfolio_value", value)
        .filter("portfolio_value > 0")
        .withColumn("target_dollars", F.col("target_weight") * F.col("portfolio_value"))
        .withColumn("target_shares", F.floor(F.try_divide("target_dollars", "price")).cast("long"))
    )
    plan = repair_cash(floored, cost_bps)
    trade = F.col("target_shares") - F.col("shares")
    traded = F.abs(trade) * F.col("price")
    totals = plan.withColumns({"trade_shares": trade, "trade_notional": traded}).withColumns(
        {
            "gross_trade_notional": F.sum("trade_notional").over(account),
            "signed_trade_value": F.col("trade_shares") * F.col("price"),
        }
    )
    cost = F.col("gross_trade_notional") * cost_bps / 10000.0
    cash_after = F.col("cash") - F.sum("signed_trade_value").over(account) - cost
    post = F.col("target_shares") * F.col("price")
    return (
        totals.withColumns({"estimated_cost": cost, "cash_after": cash_after, "post_trade_value": post})
        .withColumn("ending_value", F.sum("post_trade_value").over(account) + F.col("cash_after"))
        .withColumns(
            {
                "side": _side(F.col("trade_shares")),
                "current_weight": F.try_divide(F.col("shares") * F.col("price"), F.col("portfolio_value")),
                "post_trade_weight": F.try_divide("post_trade_value", "ending_value"),
                "turnover_ratio": F.try_divide("gross_trade_notional", "portfolio_value"),
            }
        )
    )


def plan_violations(plan: DataFrame, tolerance: float = CASH_SLACK) -> DataFrame:
    """Broken accounting rules per account: value lost beyond cost, negative cash, negative shares."""
    rows = plan.groupBy("account_id").agg(
        F.max("portfolio_value").alias("start"), F.max("ending_value").alias("end"), F.max("estimated_cost").alias("cost"),
        F.max("cash_after").alias("cash_after"), F.min("target_shares").alias("fewest"),
    )
    scale = F.greatest(F.lit(1.0), F.abs("start") * 1e-12)
    rules = F.array_compact(
        F.array(
            F.when(F.abs(F.col("start") - F.col("cost") - F.col("end")) > tolerance * scale, "VALUE_NOT_CONSERVED"),
            F.when(F.col("cash_after") < -tolerance * 10, "NEGATIVE_CASH"),
            F.when(F.col("fewest") < 0, "SHORT_POSITION"),
        )
    )
    return rows.select("account_id", F.explode(rules).alias("violation"))


HASHED_DETAIL = ["asset", "shares", "price", "target_weight", "target_shares", "trade_shares", "side"]


def plan_tables(plan: DataFrame, header: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(summary row per plan, detail row per asset) for the audit ledgers.

    The plan hash covers the sorted detail of one account, a handful of assets.
    """
    constants = {name: F.lit(value) for name, value in header.items()}
    detail_hash = record_hash(HASHED_DETAIL)
    plans = (
        plan.groupBy("account_id")
        .agg(
            F.max("portfolio_value").alias("portfolio_value_before"),
            F.max("cash").alias("cash_before"),
            F.max("cash_after").alias("cash_after"),
            F.max("gross_trade_notional").alias("gross_trade_notional"),
            F.max("turnover_ratio").alias("turnover_ratio"),
            F.max("estimated_cost").alias("estimated_transaction_cost"),
            F.concat_ws("|", F.array_sort(F.collect_list(detail_hash))).alias("lines"),
        )
        .withColumns(constants)
    )
    plan_hash = F.sha2(F.concat_ws("|", F.col("account_id").cast("string"), *header, "lines"), 256)
    summary = plans.withColumns({"order_plan_hash": plan_hash, "execution_mode": F.lit("DRY_RUN")}).drop("lines")
    detail = plan.join(summary.select("account_id", "order_plan_hash", *header), "account_id").select(
        "order_plan_hash", "account_id", *header, F.lit("DRY_RUN").alias("execution_mode"), "asset", "shares", "price",
        "current_weight", "target_weight", "target_dollars", "target_shares", "trade_shares", "side", "trade_notional",
        "signed_trade_value", "post_trade_value", "post_trade_weight",
    )
    return summary, detail


def forward_weight_records(
    active: DataFrame, calendar: DataFrame, maximum_sharpe: DataFrame, universe: list[str], statistics: DataFrame | None = None
) -> DataFrame:
    """Target weights per information date: equal weights or the solved ones by signal state.

    ``active``: version, information_date, signal_date, state, age_months, status.
    ``calendar``: month, effective_session. ``maximum_sharpe``: information_date, asset, weight.
    """
    usable = active.filter("status = 'ACTIVE'").withColumn("month", F.trunc("information_date", "month"))
    dated = usable.join(calendar.select("month", "effective_session"), "month").withColumn(
        "asset", F.explode(F.array(*[F.lit(a) for a in universe]))
    )
    solved = maximum_sharpe.select("information_date", "asset", F.col("weight").alias("solved_weight"))
    share = F.lit(1.0 / len(universe))
    rows = dated.join(solved, ["information_date", "asset"], "left").withColumn(
        "target_weight",
        F.when(F.col("state") == "EQUAL_WEIGHT", share).otherwise(F.coalesce("solved_weight", F.lit(0.0))),
    )
    if statistics is not None:
        rows = rows.join(statistics, "information_date", "left")
    return rows.select(
        "version", "information_date", F.col("effective_session").alias("effective_from"), "signal_date", "age_months",
        F.col("state").alias("allocation_state"), "asset", "target_weight",
        *([c for c in statistics.columns if c != "information_date"] if statistics is not None else []),
    )
