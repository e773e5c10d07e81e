"""Long-only allocators for many universes and dates at once.

Spark builds covariances and forecasts; the solver-backed models run as one
grouped map over (universe, as_of), whose group is a single covariance matrix
(assets squared rows, independent of the history length). Weights come back as
``universe_id, as_of, model, asset, weight``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import frontier

GROUP = ["universe_id", "as_of"]
# Fixed value: weights below this count as zero before renormalising.
DUST = 1e-12


def equal_weight(assets: DataFrame) -> DataFrame:
    """1/n over the assets of each (universe, as_of)."""
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*GROUP))
    return assets.select(*GROUP, F.lit("equal_weight").alias("model"), "asset", share.alias("weight"))


def inverse_variance(cov: DataFrame) -> DataFrame:
    """(1/variance) over its sum, from the diagonal of the covariance table."""
    own = cov.filter("asset_i = asset_j").select(*GROUP, F.col("asset_i").alias("asset"), F.try_divide(F.lit(1.0), F.col("cov")).alias("v"))
    share = F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy(*GROUP)))
    return own.select(*GROUP, F.lit("inverse_variance").alias("model"), "asset", share.alias("weight"))


def correlation_distance(corr: DataFrame) -> DataFrame:
    """sqrt((1 - rho) / 2), zero on the diagonal."""
    gap = F.sqrt(F.greatest((1.0 - F.col("corr")) / 2.0, F.lit(0.0)))
    return corr.withColumn("distance", F.when(F.col("asset_i") == F.col("asset_j"), 0.0).otherwise(gap))


def feasible_start(n: int, low: float, high: float) -> np.ndarray:
    frontier.check_bounds(n, low, high)
    return np.full(n, 1.0 / n)


def tidy(w: np.ndarray) -> np.ndarray:
    w = np.where(np.abs(w) < DUST, 0.0, w)
    return w / w.sum()


def min_variance(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """The last turning point of the critical line."""
    return solve_min_variance(cov, low, high)[0]


def solve_min_variance(cov: np.ndarray, low: float, high: float) -> tuple[np.ndarray, bool]:
    w, done = frontier.least_variance(cov, low, high)
    return tidy(w), done


def project(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nearest point of the capped simplex: the clipped sum is piecewise linear in the shift."""
    knots = np.sort(np.concatenate([v - low, v - high]))
    sums = np.clip(v[None, :] - knots[:, None], low, high).sum(axis=1)
    k = min(max(int(np.searchsorted(-sums, -1.0, side="right")) - 1, 0), len(knots) - 2)
    drop = sums[k] - sums[k + 1]
    shift = knots[k] if drop <= 0 else knots[k] + (sums[k] - 1.0) / drop * (knots[k + 1] - knots[k])
    return np.clip(v - shift, low, high)


def risk_shares(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    exposure = cov @ w
    return w * exposure / (w @ exposure)


def risk_parity(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return solve_risk_parity(cov, low, high)[0]


def solve_risk_parity(cov: np.ndarray, low: float, high: float) -> tuple[np.ndarray, bool]:
    """Equal risk shares by coordinate descent; a binding bound falls back to projected descent on their squared error.

    Also whether the descent came to rest before its last step.
    """
    n = len(cov)
    start = feasible_start(n, low, high)
    x = 1.0 / np.sqrt(np.diag(cov))
    for _ in range(500):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4.0 * cov[i, i] / n)) / (2.0 * cov[i, i])
        rest_ = np.abs(x - before).max() <= 1e-15 * np.abs(x).max()
        if rest_:
            break
    w = x / x.sum()
    if w.min() >= low - 1e-12 and w.max() <= high + 1e-12:
        # Rounding may keep the last digits moving; equal shares are the test.
        return tidy(w), bool(rest_ or np.abs(risk_shares(w, cov) - 1.0 / n).max() < 1e-10)
    goal = 1.0 / n

    def error(v):
        return float(((risk_shares(v, cov) - goal) ** 2).sum())

    w, step = project(w if error(project(w, low, high)) < error(start) else start, low, high), 1.0
    value = error(w)
    for _ in range(5000):
        exposure = cov @ w
        variance = w @ exposure
        gap = w * exposure / variance - goal
        slope = 2.0 / variance * (gap * exposure + cov @ (w * gap) - 2.0 * exposure * (gap @ (w * exposure)) / variance)
        while step > 1e-18:
            trial = project(w - step * slope, low, high)
            trial_value = error(trial)
            if trial_value <= value - 1e-4 / step * ((trial - w) ** 2).sum():
                break
            step /= 2.0
        gained, moved = value - trial_value, np.abs(trial - w).max()
        w, value, step = trial, trial_value, min(step * 2.0, 1e6)
        if moved < 1e-13 or gained < 1e-17:
            return tidy(w), True
    return tidy(w), False


def max_sharpe(cov: np.ndarray, expected: np.ndarray, risk_free: float = 0.0, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return solve_max_sharpe(cov, expected, risk_free, low, high)[0]


def solve_max_sharpe(cov: np.ndarray, expected: np.ndarray, risk_free: float, low: float, high: float) -> tuple[np.ndarray, bool]:
    """Highest excess return per volatility within bounds, and whether it is certain.

    It lies on the efficient frontier, whose pieces are known exactly. When no
    portfolio has a positive excess the ratio is climbed from equal weights.
    """
    n = len(cov)
    start = feasible_start(n, low, high)
    m = expected - risk_free
    richest = np.full(n, low)
    for i in np.argsort(-m, kind="stable"):
        richest[i] += min(high - low, 1.0 - richest.sum())
    if m @ richest <= 0:
        return _climb(cov / np.abs(np.diag(cov)).max(), m, low, high, start)
    w, done = frontier.best_ratio(cov, m, low, high)
    return tidy(w), done


def _climb(c: np.ndarray, m: np.ndarray, low: float, high: float, w: np.ndarray) -> tuple[np.ndarray, bool]:
    def ratio(v):
        return m @ v / np.sqrt(v @ c @ v)

    step = 1.0
    for _ in range(5000):
        vol = np.sqrt(w @ c @ w)
        slope = m / vol - (m @ w) * (c @ w) / vol**3
        trial = project(w + step * slope, low, high)
        if ratio(trial) > ratio(w):
            w, step = trial, step * 2.0
        elif step < 1e-15:
            return tidy(w), True
        else:
            step /= 2.0
    return tidy(w), False


def leaf_order(distance: np.ndarray) -> list[int]:
    """Single-linkage leaves: minimum spanning tree edges merged by length, lower cluster number on the left."""
    n = len(distance)
    near, parent, inside, edges = distance[0].copy(), np.zeros(n, dtype=int), {0}, []
    for _ in range(n - 1):
        pick = min((i for i in range(n) if i not in inside), key=lambda i: near[i])
        edges.append((near[pick], parent[pick], pick))
        inside.add(pick)
        closer = distance[pick] < near
        near, parent = np.where(closer, distance[pick], near), np.where(closer, pick, parent)
    label, leaves = list(range(n)), {i: [i] for i in range(n)}
    for k, (_, u, v) in enumerate(sorted(edges, key=lambda e: e[0])):
        left, right = sorted((label[u], label[v]))
        leaves[n + k] = leaves.pop(left) + leaves.pop(right)
        for i in leaves[n + k]:
            label[i] = n + k
    return next(iter(leaves.values()))


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single-linkage order, then halves weighted against their inverse-variance variance."""
    n = len(cov)
    if n == 1:
        return np.ones(1)
    sd = np.sqrt(np.diag(cov))
    distance = np.sqrt(np.maximum((1.0 - np.clip(cov / np.outer(sd, sd), -1.0, 1.0)) / 2.0, 0.0))
    np.fill_diagonal(distance, 0.0)

    def spread(items):
        part = cov[np.ix_(items, items)]
        v = 1.0 / np.diag(part)
        v = v / v.sum()
        return v @ part @ v

    weights, pending = np.ones(n), [leaf_order(distance)]
    while pending:
        items = pending.pop()
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            share = 1.0 - spread(left) / (spread(left) + spread(right))
            weights[left] *= share
            weights[right] *= 1.0 - share
            pending += [left, right]
    return weights / weights.sum()


SOLVED = ("minimum_variance", "risk_parity", "maximum_sharpe", "hrp")


def solved_weights(
    cov: DataFrame, expected: DataFrame | None = None, models: tuple[str, ...] = SOLVED,
    low: float = 0.0, high: float = 1.0, risk_free: float = 0.0, status: bool = False,
) -> DataFrame:
    """Weights of the solver-backed models for every (universe, as_of), with ``status`` also whether each solver came to its end (``converged``).

    ``expected`` holds ``universe_id, as_of, asset, expected`` and is needed for
    maximum_sharpe only. All models of a group share one pass over its matrix.
    A group whose matrix has missing cells or assets without variance has NULL weights.
    """
    table = cov.select(*GROUP, "asset_i", "asset_j", "cov")
    if expected is None:
        if "maximum_sharpe" in models:
            raise ValueError("maximum_sharpe needs expected returns")
        table = table.withColumn("expected", F.lit(0.0))
    else:
        table = table.join(expected.select(*GROUP, F.col("asset").alias("asset_i"), "expected"), [*GROUP, "asset_i"])
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def allocate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="asset_i", columns="asset_j", values="cov").sort_index()
        assets = list(wide.index)
        matrix = wide[assets].to_numpy(dtype=float)
        matrix = (matrix + matrix.T) / 2.0
        mu = rows.drop_duplicates("asset_i").set_index("asset_i")["expected"].reindex(assets).to_numpy(dtype=float)
        solve = {
            "minimum_variance": lambda: solve_min_variance(matrix, low, high),
            "risk_parity": lambda: solve_risk_parity(matrix, low, high),
            "maximum_sharpe": lambda: solve_max_sharpe(matrix, mu, risk_free, low, high),
            "hrp": lambda: (hrp(matrix), True),
        }
        usable = np.isfinite(matrix).all() and (np.diag(matrix) > 0).all() and np.isfinite(mu).all()
        nothing = np.full(len(assets), np.nan), False
        parts = []
        for name in models:
            w, done = solve[name]() if usable else nothing
            parts.append(pd.DataFrame({"model": name, "asset": assets, "weight": w} | ({"converged": done} if status else {})))
        out = pd.concat(parts, ignore_index=True)
        out.insert(0, "as_of", [key[1]] * len(out))
        out.insert(0, "universe_id", [key[0]] * len(out))
        return out

    # Few bytes but much arithmetic per group: a fixed partition count keeps
    # adaptive execution from folding the groups into one task.
    tasks = int(cov.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(tasks, *GROUP).groupBy(*GROUP).applyInPandas(
        allocate,
        f"universe_id {kinds['universe_id']}, as_of {kinds['as_of']}, model string, asset string, weight double" + (", converged boolean" if status else ""),
    ).withColumn("weight", F.nanvl("weight", F.lit(None).cast("double")))
