from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, labels, macro, market_features, periods, ridge, selection

RESULTS = "universe_id string, model string, rebalance_date date, period_end date, net_return double"


def test_regime_features_by_hand_and_without_look_ahead(random_returns):
    wide, df = random_returns
    roles = {"equity": "SPY", "bond": "TLT", "gold": "GLD", "growth": "QQQ", "dividend": "SCHD"}
    dates = periods.month_end_dates(df).withColumnRenamed("month_end", "rebalance_date")
    table = market_features.regime_features(df, dates, list(wide.columns), roles).toPandas().set_index("rebalance_date")
    assert min(table.index) >= wide.index[125]
    at = table.index.max()
    past = wide.loc[:at]
    row = table.loc[at]
    assert row["SPY_return_63d"] == pytest.approx((1 + past["SPY"].tail(63)).prod() - 1)
    assert row["TLT_vol_21d"] == pytest.approx(past["TLT"].tail(21).std() * np.sqrt(252))
    wealth = (1 + past["GLD"].tail(126)).cumprod()
    assert row["GLD_drawdown_126d"] == pytest.approx(wealth.iloc[-1] / wealth.max() - 1)
    corr = past.tail(63).corr().to_numpy()
    assert row["average_pairwise_corr_63d"] == pytest.approx(corr[~np.eye(5, dtype=bool)].mean())
    assert row["equity_bond_corr_63d"] == pytest.approx(past.tail(63)[["SPY", "TLT"]].corr().iloc[0, 1])
    early = df.filter(F.col("session") <= F.lit(sorted(table.index)[-3]))
    again = market_features.regime_features(early, dates, list(wide.columns), roles).toPandas().set_index("rebalance_date")
    shared = sorted(table.index)[-3]
    assert np.allclose(again.loc[shared].drop("universe_id").astype(float), table.loc[shared].drop("universe_id").astype(float), atol=1e-12)


def test_macro_fill_never_looks_ahead(spark, day):
    obs = spark.createDataFrame(
        [(day("2023-01-02"), "yield_2y", 4.0), (day("2023-01-05"), "yield_2y", 5.0)], "obs_date date, series string, value double"
    )
    lagged = macro.availability_lag(obs, macro.series_spec(spark))
    calendar = spark.createDataFrame([("U", day(f"2023-01-0{i}")) for i in range(2, 8)], "universe_id string, date date")
    rows = macro.asof_forward_fill(lagged, calendar, ["yield_2y"]).orderBy("date").collect()
    assert [r.value for r in rows] == [None, 4.0, 4.0, 4.0, 5.0, 5.0]


def test_macro_features_linear_series(spark):
    days = [d.date() for d in pd.bdate_range("2023-01-02", periods=200)]
    obs = [(d, name, float(i * (k + 1)) / 100 + 1) for i, d in enumerate(days) for k, name in enumerate(macro.SERIES_NAMES)]
    lagged = spark.createDataFrame(obs, "available_date date, series string, value double")
    calendar = spark.createDataFrame([("U", d) for d in days], "universe_id string, date date")
    rows = macro.macro_features(lagged, calendar).orderBy("date").collect()
    assert len(rows) == 200 - 126
    last = rows[-1]
    assert last["yield_10y_change_21d_bp"] == pytest.approx(21 * 2 / 100 * 100)
    assert last["yield_2y_change_std_21d_bp"] == pytest.approx(0.0, abs=1e-9)
    assert last["curve_10y_2y_bp"] == pytest.approx(199 / 100 * 100)
    assert last["unemployment_change_126d_pp"] == pytest.approx(126 * 7 / 100)


def five_months(day):
    ends = ["2026-01-30", "2026-02-27", "2026-03-31", "2026-04-30", "2026-05-29", "2026-06-30"]
    ew, ms = [0.01, 0.02, 0.03, 0.04, 0.05], [0.02, 0.01, 0.05, 0.0, 0.1]
    rows = []
    for i in range(5):
        for model, value in (("equal_weight", ew[i]), ("maximum_sharpe", ms[i])):
            rows.append(("U", model, day(ends[i]), day(ends[i + 1]), value))
    return rows


def test_horizon_labels_compound_and_drop_tails(spark, day):
    results = spark.createDataFrame(five_months(day), RESULTS)
    out = labels.horizon_labels(results, ["equal_weight", "maximum_sharpe"]).orderBy("rebalance_date").collect()
    assert len(out) == 3
    assert out[0].equal_weight_forward_return == pytest.approx(1.01 * 1.02 * 1.03 - 1)
    assert str(out[0].horizon_end) == "2026-04-30"
    assert out[0].best_model == "maximum_sharpe"
    assert out[0].maximum_sharpe_excess_vs_equal_weight == pytest.approx(1.02 * 1.01 * 1.05 - 1.01 * 1.02 * 1.03)


def test_label_ties_go_to_the_first_model(spark, day):
    rows = [("U", m, day("2026-01-30"), day("2026-02-27"), v) for m, v in (("b", 0.1), ("equal_weight", 0.1), ("c", 0.0))]
    out = labels.forward_labels(spark.createDataFrame(rows, RESULTS), ["equal_weight", "b", "c"]).first()
    assert out.best_model == "b" and (out.b_rank, out.equal_weight_rank, out.c_rank) == (1, 1, 3)
    assert out.winner_margin == pytest.approx(0.0)


def ridge_by_hand(x, y, now, alpha):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (now - mean) / sd @ beta


@pytest.mark.parametrize("purged", [False, True])
def test_ridge_equals_refitting(spark, purged):
    rng = np.random.default_rng(3)
    days = pd.date_range("2015-01-31", periods=60, freq="ME")
    x = rng.normal(size=(60, 4))
    x[:, 3] = 2.5
    y = x[:, :2] @ [0.02, -0.01] + rng.normal(0, 0.02, 60)
    ends = [d + pd.DateOffset(months=3) for d in days]
    rows = [("U", days[i].date(), ends[i].date(), *map(float, x[i]), float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "universe_id string, rebalance_date date, horizon_end date, a double, b double, c double, d double, t double")
    out = ridge.predictions(df, ["a", "b", "c", "d"], ["t"], purged=purged).collect()
    found = {r.rebalance_date: r for r in out}
    for i in range(60):
        known = [j for j in range(60) if (ends[j] < days[i] if purged else j < i)]
        if len(known) < 36:
            assert days[i].date() not in found
            continue
        row = found[days[i].date()]
        assert row.training_labels == len(known)
        assert row.predicted == pytest.approx(ridge_by_hand(x[known].copy(), y[known], x[i], 10.0), abs=1e-10)


def forecasts(spark, day, values, model="m"):
    rows = [("U", day("2020-01-01") + pd.Timedelta(days=30 * i), model, float(p), float(a)) for i, (p, a) in enumerate(values)]
    return spark.createDataFrame(rows, "universe_id string, rebalance_date date, model string, predicted double, actual double")


def test_calibration_follows_interpolated_quantiles(spark, day):
    values = [(i % 3, i) for i in range(10)]
    out = selection.calibration_buckets(forecasts(spark, day, values), ["model"], 4).collect()
    ranks = pd.Series([p for p, _ in values]).rank(method="first")
    expected = pd.qcut(ranks, 4, labels=False).add(1).value_counts()
    assert {r.bucket: r.observations for r in out} == expected.to_dict()


def test_spearman_averages_ties(spark, day):
    values = [(1, 3), (1, 1), (2, 2), (3, 5), (3, 4)]
    out = selection.information_coefficients(forecasts(spark, day, values), ["model"]).first()
    p, a = pd.Series([v[0] for v in values]), pd.Series([v[1] for v in values])
    assert out.spearman_ic == pytest.approx(p.rank().corr(a.rank()))


def test_assignments_take_three_dates_and_drop_short_windows(spark, day):
    dates = [day(f"2026-{m:02d}-28") for m in range(1, 9)]
    decisions = [("U", 0, day("2026-01-28"), "x"), ("U", 0, day("2026-04-15"), "y"), ("U", 0, day("2026-07-28"), "z")]
    out = selection.assign_models(
        spark.createDataFrame(decisions, "universe_id string, phase int, rebalance_date date, selected_model string"),
        spark.createDataFrame([("U", d) for d in dates], "universe_id string, rebalance_date date"),
    )
    rows = sorted((str(r.rebalance_date), r.selected_model) for r in out.collect())
    assert rows == [(f"2026-{m:02d}-28", "x") for m in (1, 2, 3)] + [(f"2026-{m:02d}-28", "y") for m in (4, 5, 6)]
    assert selection.overlapping_assignments(out).isEmpty()


def test_concentration_of_winners(spark):
    rows = [("p", v) for v in (0.05, 0.04, 0.03, 0.01, -0.06)] + [("q", -0.1), ("q", 0.05)]
    out = {r.k: r for r in selection.contribution_concentration(spark.createDataFrame(rows, "k string, e double"), ["k"], "e").collect()}
    assert out["p"].top_share == pytest.approx(0.12 / 0.07)
    assert out["q"].top_share is None


def test_bootstrap_is_reproducible_and_centred(spark, day):
    rng = np.random.default_rng(5)
    rows = [("c", i, float(x) + 0.01, float(x)) for i, x in enumerate(rng.normal(0.01, 0.03, 48))]
    pairs = spark.createDataFrame(rows, "k string, i int, challenger double, benchmark double")
    first = bootstrap.block_bootstrap(pairs, ["k"], "i", 300, 6)
    summary = bootstrap.bootstrap_summary(first, ["k"]).first()
    again = bootstrap.bootstrap_summary(bootstrap.block_bootstrap(pairs.repartition(5), ["k"], "i", 300, 6), ["k"]).first()
    assert summary == again
    assert summary.probability_return_improvement == 1.0 and summary.bootstrap_samples == 300
    assert bootstrap.block_bootstrap(pairs.filter("i < 8"), ["k"], "i", 10, 3).isEmpty()
