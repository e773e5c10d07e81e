"""The whole efficient frontier of one covariance matrix as a list of turning points, by the critical line.

Between two turning points the set of assets at a bound stays the same and the weights are linear in the price of
risk, so the frontier is known exactly: its last point has the least variance, and on each piece the best excess
return per volatility has a closed form. There are finitely many pieces and no iterates to converge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["universe_id", "as_of"]
_TINY = 1e-9


def check_bounds(n: int, low: float, high: float) -> None:
    if not 0.0 <= low <= high <= 1.0:
        raise ValueError(f"bounds must satisfy 0 <= low <= high <= 1, got {low}, {high}")
    if n * low > 1.0 + 1e-12 or n * high < 1.0 - 1e-12:
        raise ValueError(f"no fully invested portfolio of {n} assets fits the bounds {low}, {high}")


def turning_points(cov: np.ndarray, reward: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Prices ``t`` (descending, the last is 0), weights at each, and whether the line was followed to its end.

    A row minimises w'Cw/2 - t reward'w over sum(w) = 1 and low <= w <= high. Equal rewards are told apart by asset order.
    """
    n = len(cov)
    check_bounds(n, low, high)
    m = reward.astype(float)
    if len(np.unique(m)) < n:
        m = m + _TINY * max(1.0, np.abs(m).max()) * np.arange(n)[::-1]
    w, side = np.full(n, float(low)), np.full(n, -1)
    last = 0
    for i in np.argsort(-m, kind="stable"):
        room = 1.0 - w.sum()
        if room <= 0 and i != last:
            break
        w[i] += min(high - low, room)
        side[i], last = 1, i
        if w[i] < high:
            break
    side[last] = 0
    prices, weights, price = [np.inf], [w.copy()], np.inf
    moved: set[int] = set()  # changed at this very price; several assets may change at once, each once
    for _ in range(4 * n * n + 100):
        free, fixed = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
        k = len(free)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = cov[np.ix_(free, free)]
        system[:k, k] = system[k, :k] = 1.0
        held = np.where(side < 0, low, high)
        right = np.zeros((k + 1, 2))
        right[:k, 0], right[:k, 1] = m[free], -cov[np.ix_(free, fixed)] @ held[fixed]
        right[k, 1] = 1.0 - held[fixed].sum()
        try:
            found = np.linalg.solve(system, right)
        except np.linalg.LinAlgError:
            found = np.linalg.lstsq(system, right, rcond=None)[0]
        slope, base = np.zeros(n), held.astype(float)
        slope[free], base[free] = found[:k, 0], found[:k, 1]
        # Prices at which a free asset reaches a bound, or the gradient of one at a bound changes sign.
        best, who, to = 0.0, -1, 0
        if k > 1:
            for i in free:
                if abs(slope[i]) > 1e-300:
                    bound = -1 if slope[i] > 0 else 1
                    at = ((low if bound < 0 else high) - base[i]) / slope[i]
                    at = min(at, price)
                    if at > best and not (i in moved and at >= price * (1 - 1e-12)):
                        best, who, to = at, i, bound
        gain = cov @ slope - m + found[k, 0]
        level = cov @ base + found[k, 1]
        for i in fixed:
            # Gradient gain * t + level: not negative at the floor, not positive at the cap.
            sign = 1.0 if side[i] < 0 else -1.0
            if sign * gain[i] > 1e-300 and high > low:
                at = min(-level[i] / gain[i], price)
                if at > best and not (i in moved and at >= price * (1 - 1e-12)):
                    best, who, to = at, i, 0
        if best < price * (1 - 1e-12) or np.isinf(price):
            moved.clear()
        price = best
        w = base + slope * price
        prices.append(price)
        weights.append(np.clip(w, low, high))
        if who < 0 or price <= 0.0:
            return np.array(prices), np.array(weights), True
        side[who] = to
        moved.add(who)
    return np.array(prices), np.array(weights), False


def least_variance(cov: np.ndarray, low: float, high: float) -> tuple[np.ndarray, bool]:
    """The end of any frontier: it does not depend on the rewards."""
    uneven = np.mod(np.arange(1, len(cov) + 1) * 0.6180339887498949, 1.0)  # no two gaps of these are equal often
    _, weights, done = turning_points(cov / np.abs(np.diag(cov)).max(), uneven, low, high)
    return weights[-1], done


def best_ratio(cov: np.ndarray, excess: np.ndarray, low: float, high: float) -> tuple[np.ndarray, bool]:
    """Highest excess return per volatility among the points of the frontier, ends and inner points of every piece."""
    c = cov / np.abs(np.diag(cov)).max()
    _, weights, done = turning_points(c, excess, low, high)
    candidates = list(weights)
    for a, b in zip(weights, weights[1:]):
        d = b - a
        ma, md, aa, ad, dd = excess @ a, excess @ d, a @ c @ a, a @ c @ d, d @ c @ d
        below = ma * dd - md * ad
        if abs(below) > 1e-300:
            at = (md * aa - ma * ad) / below
            if 0.0 < at < 1.0:
                candidates.append(a + at * d)
    ratios = [excess @ w / np.sqrt(w @ c @ w) for w in candidates]
    return candidates[int(np.argmax(ratios))], done


def efficient_frontier(cov: DataFrame, expected: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """universe_id, as_of, point, price, asset, weight, expected, variance, complete: the turning points from highest return (price NULL) to least variance (price 0).

    A point minimises variance / 2 less price times expected return.

    ``cov`` has both triangles, ``expected`` a row per asset. A group is one matrix; unusable ones (missing cells, assets without variance) have no points.
    """
    table = cov.select(*GROUP, "asset_i", "asset_j", "cov").join(expected.select(*GROUP, F.col("asset").alias("asset_i"), "expected"), [*GROUP, "asset_i"])
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="asset_i", columns="asset_j", values="cov").sort_index()
        names = list(wide.index)
        matrix = wide[names].to_numpy(dtype=float)
        reward = rows.drop_duplicates("asset_i").set_index("asset_i")["expected"].reindex(names).to_numpy(dtype=float)
        columns = ["universe_id", "as_of", "point", "price", "asset", "weight", "expected", "variance", "complete"]
        if not (np.isfinite(matrix).all() and (np.diag(matrix) > 0).all() and np.isfinite(reward).all()):
            return pd.DataFrame(columns=columns)
        matrix = (matrix + matrix.T) / 2.0
        scale = np.abs(np.diag(matrix)).max()
        prices, weights, done = turning_points(matrix / scale, reward, low, high)
        # Of equal neighbours the last stands: the least variance is always there.
        last = np.append(np.abs(np.diff(weights, axis=0)).max(axis=1) > 1e-12, True)
        points = zip(np.where(last)[0].tolist(), (prices * scale)[last].tolist(), weights[last], strict=True)
        out = [
            (*key, p, None if np.isinf(t) else t, a, float(x), float(reward @ w), float(w @ matrix @ w), done)
            for p, (_, t, w) in enumerate(points) for a, x in zip(names, w, strict=True)
        ]
        return pd.DataFrame(out, columns=columns)

    fields = f"universe_id {kinds['universe_id']}, as_of {kinds['as_of']}, point int, price double, asset string, weight double, expected double, variance double, complete boolean"
    tasks = int(cov.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(tasks, *GROUP).groupBy(*GROUP).applyInPandas(follow, fields)
