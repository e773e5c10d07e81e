from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, stats
from tidemark.operators import metrics, periods, returns

PRICES = "universe_id string, session date, asset string, close double"
RETURNS = "universe_id string, session date, asset string, ret double"


def price_rows(day):
    a = {"2026-01-05": 100.0, "2026-01-06": 110.0, "2026-01-07": 99.0, "2026-01-08": 108.9}
    b = {"2026-01-05": 50.0, "2026-01-06": 50.0, "2026-01-08": 55.0}
    return [("U", day(d), "A", v) for d, v in a.items()] + [("U", day(d), "B", v) for d, v in b.items()]


def test_gap_gives_no_return(spark, day):
    rets = returns.daily_returns(spark.createDataFrame(price_rows(day), PRICES))
    found = {(r.asset, str(r.session)): r.ret for r in rets.collect()}
    assert found[("A", "2026-01-06")] == pytest.approx(0.10)
    assert found[("A", "2026-01-07")] == pytest.approx(-0.10)
    # B has no close on the universe's previous session, so nothing is bridged.
    assert found[("B", "2026-01-08")] is None
    matrix = returns.return_matrix(spark.createDataFrame(price_rows(day), PRICES)).collect()
    assert {str(r.session) for r in matrix} == {"2026-01-06"}


def test_clean_prices_flags_and_drops(spark, day):
    rows = [("U", day("2026-01-05"), "A", "10"), ("U", day("2026-01-05"), "B", "x"), ("U", day("2026-01-06"), "A", "y"),
            ("U", day("2026-01-07"), "A", "-1")]
    out = returns.clean_prices(spark.createDataFrame(rows, "universe_id string, session date, asset string, close string"))
    found = {(r.asset, str(r.session)): (r.close, r.violation) for r in out.collect()}
    assert ("A", "2026-01-06") not in found
    assert found[("B", "2026-01-05")] == (None, False)
    assert found[("A", "2026-01-07")] == (-1.0, True)


def test_period_excludes_its_start(spark, day):
    rows = [("U", day("2026-01-30"), "AAA", 0.01), ("U", day("2026-02-02"), "AAA", 0.02), ("U", day("2026-02-03"), "AAA", 0.03)]
    out = periods.period_returns(spark.createDataFrame(rows, RETURNS)).collect()
    assert len(out) == 1
    assert str(out[0].rebalance_date) == "2026-01-30" and str(out[0].period_end) == "2026-02-03"
    assert out[0].ret == pytest.approx(1.02 * 1.03 - 1)


def test_turnover_against_drifted_weights(spark, day):
    d1, d2, d3 = day("2026-01-30"), day("2026-02-27"), day("2026-03-31")
    weights = [("U", "m", d1, "A", 0.5), ("U", "m", d1, "B", 0.5), ("U", "m", d2, "A", 1.0)]
    realized = [("U", d1, d2, "A", 0.2), ("U", d1, d2, "B", 0.0), ("U", d2, d3, "A", 0.1), ("U", d2, d3, "B", 0.3)]
    out = periods.strategy_period_results(
        spark.createDataFrame(weights, "universe_id string, model string, rebalance_date date, asset string, weight double"),
        spark.createDataFrame(realized, "universe_id string, rebalance_date date, period_end date, asset string, ret double"),
        10.0,
    )
    first, second = out.orderBy("rebalance_date").collect()
    assert (first.turnover, first.gross_return) == (1.0, pytest.approx(0.1))
    # Drifted weights are 0.6/1.1 and 0.5/1.1; B leaves the portfolio.
    assert second.turnover == pytest.approx(0.5 / 1.1)
    assert second.net_return == pytest.approx(0.1 - 0.5 / 1.1 * 10 / 1e4)


def test_drawdown_conventions_differ(spark, day):
    rows = [("U", day("2026-01-05"), "A", -0.5), ("U", day("2026-01-06"), "A", 0.1)]
    df = spark.createDataFrame(rows, RETURNS)
    period = metrics.series_summary(df, ["asset"], "session", "ret").first()
    research = metrics.research_summary(df, ["asset"], "session", "ret").first()
    assert period.max_drawdown == pytest.approx(-0.5)
    assert research.max_drawdown == pytest.approx(0.0)


def test_flat_and_ruined_series(spark, day):
    flat = [("U", day(f"2026-01-0{i}"), "F", 0.0) for i in range(5, 9)]
    ruin = [("U", day("2026-01-05"), "R", 0.1), ("U", day("2026-01-06"), "R", -1.0)]
    df = spark.createDataFrame(flat + ruin, RETURNS)
    period = {r.asset: r for r in metrics.series_summary(df, ["asset"], "session", "ret").collect()}
    research = {r.asset: r for r in metrics.research_summary(df, ["asset"], "session", "ret").collect()}
    assert period["F"].sharpe is None and period["F"].sortino is None
    assert research["F"].sharpe == 0.0 and research["F"].sortino == 0.0
    assert period["R"].annualized_return is None
    assert research["R"].annualized_return == -1.0


def test_worst_rolling_uses_full_windows_only(spark, day):
    rows = [("U", day(f"2026-01-{i:02d}"), "A", r) for i, r in zip(range(5, 10), [-0.9, 0.1, 0.1, -0.1, 0.1])]
    out = metrics.worst_rolling_return(spark.createDataFrame(rows, RETURNS), ["asset"], "session", "ret", (2, 9)).first()
    assert out.worst_rolling_2d_return == pytest.approx(0.1 * 1.1 - 1)
    assert out.worst_rolling_9d_return is None


def test_forward_returns_start_after_freeze(spark, day):
    out = returns.forward_price_returns(spark.createDataFrame(price_rows(day), PRICES), "2026-01-06", "2026-01-08")
    found = {r.asset: r.ret for r in out.collect()}
    # The base is the last complete session, and only complete sessions follow.
    assert found == {"A": pytest.approx(108.9 / 110 - 1), "B": pytest.approx(0.1)}


def test_business_month_ends(spark):
    df = spark.sql("select explode(array(date'2026-01-30', date'2026-01-29', date'2026-05-31', date'2026-05-29')) d")
    out = {str(r.d): str(r.s) for r in df.select("d", dates.last_completed_month_end(F.col("d")).alias("s")).collect()}
    assert out == {"2026-01-30": "2026-01-30", "2026-01-29": "2025-12-31", "2026-05-31": "2026-05-29", "2026-05-29": "2026-05-29"}


def test_summary_matches_numpy(spark, random_returns):
    import numpy as np

    wide, df = random_returns
    out = {r.asset: r for r in metrics.series_summary(df, ["asset"], "session", "ret", stats.TRADING_DAYS).collect()}
    for name in wide.columns:
        x = wide[name].to_numpy()
        assert out[name].sharpe == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(252))
        assert out[name].sortino == pytest.approx(x.mean() * 252 / (np.sqrt((np.minimum(x, 0) ** 2).mean()) * np.sqrt(252)))
        wealth = np.concatenate([[1.0], (1 + x).cumprod()])
        assert out[name].max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min())
