"""A degenerate group next to a healthy one: no operator fails, and the healthy group's rows do not change."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocators, covariance, forecast, history, issues, portfolios, rebalance, returns

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def closes(universe: str, asset: str, values: list[float]):
    return [(universe, d, asset, float(v)) for d, v in zip(DAYS, values, strict=False)]


@pytest.fixture(scope="module")
def prices(spark):
    healthy = closes("H", "A", [100 + (i * 7) % 11 for i in range(40)]) + closes("H", "B", [50 + (i * 5) % 7 for i in range(40)])
    bad = (
        closes("zero", "A", [10, 0, 12, 11, 13]) + closes("zero", "B", [10, 11, 12, 11, 13])
        + closes("flat", "A", [10.0] * 9) + closes("flat", "B", [10, 12, 11, 13, 10, 9, 10, 12, 11])
        + closes("one", "A", [10, 11]) + closes("one", "B", [10, 12]) + closes("lone", "A", [10])
    )
    schema = "universe_id string, session date, asset string, close double"
    return spark.createDataFrame(healthy, schema), spark.createDataFrame(healthy + bad, schema)


def same_healthy(run, prices):
    alone, mixed = run(prices[0]), run(prices[1])
    rows = lambda df: sorted(map(str, (tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.filter("universe_id = 'H'").collect())))
    mixed_rows = mixed.collect()
    assert rows(alone) == rows(mixed) and rows(alone)
    return mixed_rows


@pytest.mark.parametrize(
    "run",
    [
        returns.daily_returns, returns.log_returns, returns.return_matrix,
        lambda p: returns.return_summary(returns.daily_returns(p)),
        lambda p: covariance.sample_covariance(returns.return_matrix(p)),
        lambda p: covariance.ledoit_wolf(returns.return_matrix(p)),
        lambda p: covariance.correlation(covariance.sample_covariance(returns.return_matrix(p))),
        lambda p: allocators.inverse_variance(covariance.sample_covariance(returns.return_matrix(p)).withColumn("as_of", F.current_date())),
        lambda p: forecast.expected_returns(returns.return_matrix(p)),
    ],
)
def test_price_operators(prices, run):
    same_healthy(run, prices)


def test_issues_name_the_groups(prices):
    mixed = prices[1]
    assert {(r.universe_id, r.subject) for r in issues.price_issues(mixed).collect()} == {("zero", "A")}
    found = {(r.universe_id, r.subject, r.issue) for r in issues.return_issues(returns.return_matrix(mixed)).collect()}
    assert {("flat", "A", "FLAT_ASSET"), ("one", "A", "SINGLE_RETURN"), ("one", "B", "SINGLE_RETURN")} <= found
    assert not any(u == "H" for u, _, _ in found)


def test_zero_weight_portfolio(spark):
    rows = [("H", "p", "A", 0.5), ("H", "p", "B", 1.5), ("Z", "z", "A", 0.0), ("Z", "z", "B", 0.0)]
    weights = spark.createDataFrame(rows, "universe_id string, portfolio_id string, asset string, weight double")
    out = {(r.portfolio_id, r.asset): r.weight for r in portfolios.normalize_weights(weights).collect()}
    assert out[("p", "A")] == 0.25 and out[("p", "B")] == 0.75 and out.get(("z", "A")) is None
    portfolios.concentration(weights).collect()
    assert [(r.subject, r.issue) for r in issues.weight_issues(weights).collect()] == [("z", "ZERO_WEIGHT_TOTAL")]


def test_exponential_average_of_a_long_series(spark):
    n, span = 50_000, 12
    values = [0.01 * math.sin(i) + 0.0001 for i in range(n)]
    df = spark.createDataFrame([("U", i, "A", v) for i, v in enumerate(values)], "universe_id string, session int, asset string, ret double")
    rows = forecast.expected_returns(df, span).orderBy("session").collect()
    alpha, mean = 2 / (span + 1), values[0]
    for i, v in enumerate(values):
        mean = mean if i == 0 else (1 - alpha) * mean + alpha * v
        assert rows[i].ewma == pytest.approx(mean * 252, rel=1e-9, abs=1e-12)


def test_null_keys_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, v double")
    for _ in range(2):
        with pytest.raises(history.HistoryConflict, match="null"):
            history.idempotent_append(str(tmp_path / "t"), rows, ["k"])


def test_repeated_keys_in_the_history_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1.0), (1, 1.0)], "k int, v double").write.parquet(path)
    with pytest.raises(history.HistoryConflict, match="history repeats"):
        history.idempotent_append(path, spark.createDataFrame([(2, 1.0)], "k int, v double"), ["k"])


def test_unpriced_targets_refuse_the_account(spark):
    targets = spark.createDataFrame([("a", "X", 0.5), ("a", "Y", 0.5), ("b", "X", 1.0), ("c", "X", 1.0)], "account_id string, asset string, target_weight double")
    prices = spark.createDataFrame([("X", 10.0), ("Y", 0.0)], "asset string, price double")
    cash = spark.createDataFrame([("a", 1000.0), ("b", 1000.0)], "account_id string, cash double")
    positions = spark.createDataFrame([("b", "X", 3)], "account_id string, asset string, shares long")
    found = {tuple(r) for r in rebalance.plan_issues(cash, prices, targets).collect()}
    assert found == {("a", "MISSING_PRICE", "Y"), ("c", "MISSING_CASH", None)}
    assert {r.account_id for r in rebalance.rebalance_plan(positions, cash, prices, targets).collect()} == {"b"}
