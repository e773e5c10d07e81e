from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocators, covariance, forecast, risk, walk_forward


def shrunk(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrinkage towards a scaled identity, straight from its definition."""
    n, p = x.shape
    z = x - x.mean(axis=0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    d = ((s - mu * np.eye(p)) ** 2).sum() / p
    b = sum(((np.outer(row, row) - s) ** 2).sum() for row in z) / (n * n * p)
    rho = min(b, d) / d
    return (1 - rho) * s + rho * mu * np.eye(p), rho


def as_matrix(rows, names):
    found = {(r.asset_i, r.asset_j): r.cov for r in rows}
    return np.array([[found[(a, b)] for b in names] for a in names])


def test_covariances_match_definitions(random_returns):
    wide, df = random_returns
    names = sorted(wide.columns)
    x = wide[names].to_numpy()
    sample = as_matrix(covariance.sample_covariance(df).collect(), names)
    assert np.allclose(sample, np.cov(x.T) * 252, atol=1e-12)
    rows = covariance.ledoit_wolf(df).collect()
    expected, rho = shrunk(x)
    assert rows[0].shrinkage == pytest.approx(rho, rel=1e-8)
    assert np.allclose(as_matrix(rows, names), expected * 252, atol=1e-12)
    assert covariance.asymmetric_pairs(covariance.ledoit_wolf(df)).isEmpty()


def test_expanding_moments_equal_refits(random_returns):
    wide, df = random_returns
    names = sorted(wide.columns)
    rows = covariance.shrunk_from_sums(covariance.expanding_pair_sums(df, 100)).collect()
    for as_of in sorted({r.as_of for r in rows})[::3]:
        part = [r for r in rows if r.as_of == as_of]
        expected, _ = shrunk(wide.loc[:as_of, names].to_numpy())
        assert np.allclose(as_matrix(part, names), expected * 252, atol=1e-12)


def test_spectrum(random_returns):
    wide, df = random_returns
    row = covariance.spectrum(covariance.sample_covariance(df)).first()
    eig = np.linalg.eigvalsh(np.cov(wide[sorted(wide.columns)].to_numpy().T) * 252)
    assert row.smallest_eigenvalue == pytest.approx(eig[0]) and row.condition_number == pytest.approx(eig[-1] / eig[0])


def test_risk_contributions_add_up(spark, random_returns):
    wide, df = random_returns
    cov = covariance.sample_covariance(df)
    weights = spark.createDataFrame([("P", a, 0.2) for a in wide.columns], "portfolio_id string, asset string, weight double")
    rows = risk.risk_contributions(weights, cov).collect()
    volatility = risk.portfolio_variance(weights, cov).first().volatility
    assert sum(r.risk_share for r in rows) == pytest.approx(1.0)
    assert sum(r.component_risk for r in rows) == pytest.approx(volatility)
    flat = risk.risk_contributions(weights, cov.withColumn("cov", F.lit(0.0))).collect()
    assert {r.risk_share for r in flat} == {0.0}


def test_forecast_recursion(random_returns):
    wide, df = random_returns
    rows = {r.asset: r for r in forecast.latest_expected_returns(df, 126).collect()}
    for name in wide.columns:
        level = wide[name].ewm(span=126, adjust=False).mean().iloc[-1] * 252
        assert rows[name].ewma == pytest.approx(level, rel=1e-9)
        geometric = (1 + wide[name]).prod() ** (252 / 300) - 1
        assert rows[name].robust == pytest.approx((geometric + wide[name].mean() * 252) / 2 * 0.8 + level * 0.2)


def random_covariance(rng, p):
    a = rng.normal(size=(p, 3 * p))
    sd = rng.uniform(0.05, 0.4, p)
    c = np.corrcoef(a) * 0.6 + 0.4
    return c * np.outer(sd, sd)


@pytest.mark.parametrize("p,high", [(2, 0.6), (5, 0.4), (5, 1.0), (12, 0.15), (30, 0.05)])
def test_solvers_meet_optimality_conditions(p, high):
    rng = np.random.default_rng(p)
    for _ in range(5):
        c = random_covariance(rng, p)
        mu = rng.normal(0.06, 0.05, p)
        for name, w, slope in (
            ("minimum variance", (w := allocators.min_variance(c, 0.0, high)), c @ w),
            ("maximum sharpe", (v := allocators.max_sharpe(c, mu, 0.0, 0.0, high)), (c @ v) * (mu @ v) / (v @ c @ v) - mu),
        ):
            assert w.sum() == pytest.approx(1.0) and w.min() >= 0 and w.max() <= high + 1e-9, name
            inner = (w > 1e-9) & (w < high - 1e-9)
            scale = np.abs(c @ w).max() if name == "minimum variance" else np.abs(mu).max()
            level = slope[inner].mean() if inner.any() else np.median(slope)
            assert np.abs(slope[inner] - level).max(initial=0) <= 1e-7 * scale, name
            if inner.any():
                assert (slope[w <= 1e-9] >= level - 1e-7 * scale).all(), name
                assert (slope[w >= high - 1e-9] <= level + 1e-7 * scale).all(), name
        even = allocators.risk_parity(c)
        assert np.allclose(allocators.risk_shares(even, c), 1 / p, atol=1e-8)
        tree = allocators.hrp(c)
        assert tree.sum() == pytest.approx(1.0) and tree.min() > 0


def test_capped_risk_parity_beats_a_grid():
    c = np.diag([0.01, 0.09, 0.16])
    c[0, 1] = c[1, 0] = 0.006
    best = allocators.risk_parity(c, 0.0, 0.45)
    error = lambda w: ((allocators.risk_shares(w, c) - 1 / 3) ** 2).sum()
    steps = np.linspace(0, 0.45, 46)
    grid = [np.array([a, b, 1 - a - b]) for a, b in itertools.product(steps, steps) if 0 <= 1 - a - b <= 0.45]
    assert error(best) <= min(error(w) for w in grid) + 1e-12


def test_losing_universe_still_has_an_answer():
    c = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = allocators.max_sharpe(c, np.array([-0.05, -0.10]), 0.0, 0.0, 0.7)
    assert w.sum() == pytest.approx(1.0) and w.max() <= 0.7 + 1e-12


def test_infeasible_cap_is_an_error():
    with pytest.raises(ValueError):
        allocators.min_variance(np.eye(3), 0.0, 0.3)


def test_leaf_order_keeps_pairs_together():
    rho = np.array([[1, 0.1, 0.9, 0.1], [0.1, 1, 0.1, 0.8], [0.9, 0.1, 1, 0.1], [0.1, 0.8, 0.1, 1]])
    order = allocators.leaf_order(np.sqrt((1 - rho) / 2))
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset({0, 2}), frozenset({1, 3})}
    assert order == [0, 2, 1, 3]


def test_walk_forward_ignores_the_future(random_returns):
    _, df = random_returns
    cut = df.filter("session <= date'2024-10-31'")
    settings = dict(min_training=150, span=63)
    full = walk_forward.walk_forward_weights(df, **settings).filter("as_of <= date'2024-10-31'")
    part = walk_forward.walk_forward_weights(cut, **settings)
    key = lambda r: (str(r.as_of), r.model, r.asset)
    a = {key(r): r.weight for r in full.collect()}
    b = {key(r): r.weight for r in part.collect()}
    assert set(a) == set(b) and len({m for _, m, _ in a}) == 6
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
