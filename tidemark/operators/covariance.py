"""Covariance from pair moments: sample, shrunk, correlation and diagnostics.

Returns must be synchronised (see ``complete_rows``). Moments of asset pairs are
block products of tiles of assets (see ``tiles``), so no matrix of all assets is
ever held and no row per session and pair is made; only one triangle is computed.
Expanding windows add up monthly partial sums instead of re-reading history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import tiles
from tidemark.operators.tiles import SUMS


def pair_sums(returns: DataFrame, by_month: bool = False) -> DataFrame:
    """Raw power sums per asset pair (asset_i <= asset_j) of a universe, optionally per month, by block products."""
    return tiles.pair_sums(returns, by_month)


def expanding_pair_sums(returns: DataFrame, min_history: int = 2) -> DataFrame:
    """Pair sums over all history up to each month-end, keyed by ``as_of``.

    One window row per (pair, month): its length is the number of months.
    """
    monthly = pair_sums(returns, by_month=True)
    span = stats.running(["universe_id", "asset_i", "asset_j"], "month")
    return (
        monthly.select(
            "universe_id",
            F.col("month_end").alias("as_of"),
            "asset_i",
            "asset_j",
            *[F.sum(c).over(span).alias(c) for c in SUMS],
        )
        .filter(F.col("n") >= min_history)
    )


def _centred(sums: DataFrame) -> DataFrame:
    """Population covariance ``s`` and mean of squared products ``q`` of centred returns."""
    n, mi, mj = F.col("n"), F.col("s_i") / F.col("n"), F.col("s_j") / F.col("n")
    fourth = (
        F.col("s_iijj")
        - 2 * mj * F.col("s_iij")
        - 2 * mi * F.col("s_ijj")
        + mj * mj * F.col("s_ii")
        + mi * mi * F.col("s_jj")
        + 4 * mi * mj * F.col("s_ij")
        - 3 * n * mi * mi * mj * mj
    )
    return sums.withColumn("s", F.col("s_ij") / n - mi * mj).withColumn("q", fourth / n)


def mirrored(half: DataFrame) -> DataFrame:
    """Both triangles from one: a pair of different assets yields a second, swapped row."""
    orders = F.when(F.col("asset_i") == F.col("asset_j"), F.array(F.lit(False))).otherwise(
        F.array(F.lit(False), F.lit(True))
    )
    return (
        half.withColumn("swap", F.explode(orders))
        .withColumns(
            {
                "asset_i": F.when(F.col("swap"), F.col("asset_j")).otherwise(F.col("asset_i")),
                "asset_j": F.when(F.col("swap"), F.col("asset_i")).otherwise(F.col("asset_j")),
            }
        )
        .drop("swap")
    )


def _keys(sums: DataFrame) -> list[str]:
    return ["universe_id", "as_of"] if "as_of" in sums.columns else ["universe_id"]


def sample_from_sums(sums: DataFrame, periods: int = stats.TRADING_DAYS) -> DataFrame:
    value = _centred(sums).withColumn("cov", F.try_divide(F.col("s") * F.col("n"), F.col("n") - 1) * periods)
    return mirrored(value.select(*_keys(sums), "asset_i", "asset_j", "cov"))


def sample_covariance(returns: DataFrame, periods: int = stats.TRADING_DAYS) -> DataFrame:
    """Annualised sample covariance, both triangles."""
    return sample_from_sums(pair_sums(returns), periods)


def shrinkage_from_sums(sums: DataFrame) -> DataFrame:
    """Shrinkage intensity towards a scaled identity, per universe (and as_of)."""
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    diagonal = F.col("asset_i") == F.col("asset_j")
    totals = _centred(sums).groupBy(*_keys(sums)).agg(
        F.sum(F.when(diagonal, 1).otherwise(0)).alias("p"),
        F.max("n").alias("n"),
        F.sum(F.when(diagonal, F.col("s")).otherwise(0.0)).alias("trace"),
        F.sum(twice * F.col("s") * F.col("s")).alias("squares"),
        F.sum(twice * (F.col("q") - F.col("s") * F.col("s"))).alias("noise"),
    )
    p = F.col("p")
    mu = F.col("trace") / p
    distance = (F.col("squares") - 2 * mu * F.col("trace") + p * mu * mu) / p
    return (
        totals.withColumns({"mu": mu, "d": distance, "b": F.col("noise") / (p * F.col("n"))})
        .withColumn("b", F.least("b", "d"))
        .select(
            *_keys(sums),
            "p",
            "n",
            "mu",
            F.when(F.col("b") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("b"), F.col("d"))).alias("shrinkage"),
        )
    )


def shrunk_from_sums(sums: DataFrame, periods: int = stats.TRADING_DAYS) -> DataFrame:
    keys = _keys(sums)
    target = F.when(F.col("asset_i") == F.col("asset_j"), F.col("mu")).otherwise(0.0)
    mixed = (1.0 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * target
    return mirrored(
        _centred(sums)
        .drop("n")
        .join(shrinkage_from_sums(sums), keys)
        .select(*keys, "asset_i", "asset_j", (mixed * periods).alias("cov"), "shrinkage")
    )


def ledoit_wolf(returns: DataFrame, periods: int = stats.TRADING_DAYS) -> DataFrame:
    """Annualised shrunk covariance with its intensity."""
    return shrunk_from_sums(pair_sums(returns), periods)


def correlation(cov: DataFrame) -> DataFrame:
    """Correlation clipped to [-1, 1] from a long covariance table."""
    keys = _keys(cov)
    deviations = cov.filter("asset_i = asset_j").select(*keys, F.col("asset_i").alias("asset"), F.sqrt("cov").alias("sd"))
    left = deviations.withColumnsRenamed({"asset": "asset_i", "sd": "sd_i"})
    right = deviations.withColumnsRenamed({"asset": "asset_j", "sd": "sd_j"})
    value = F.try_divide(F.col("cov"), F.col("sd_i") * F.col("sd_j"))
    return (
        cov.join(left, [*keys, "asset_i"])
        .join(right, [*keys, "asset_j"])
        .select(*keys, "asset_i", "asset_j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).alias("corr"))
    )


def asymmetric_pairs(cov: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Pairs whose mirror image is missing or differs."""
    keys = _keys(cov)
    flipped = cov.select(
        *keys, F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), F.col("cov").alias("mirror")
    )
    joined = cov.join(flipped, [*keys, "asset_i", "asset_j"], "left")
    return joined.filter(F.col("mirror").isNull() | (F.abs(F.col("cov") - F.col("mirror")) > tolerance))


def covariance_distance(returns: DataFrame) -> DataFrame:
    """Frobenius distance between the sample and the shrunk covariance."""
    sums = pair_sums(returns)
    sample = sample_from_sums(sums).withColumnRenamed("cov", "sample")
    return (
        shrunk_from_sums(sums)
        .join(sample, ["universe_id", "asset_i", "asset_j"])
        .groupBy("universe_id")
        .agg(
            F.countDistinct("asset_i").alias("assets"),
            F.max("shrinkage").alias("shrinkage"),
            F.sqrt(F.sum(F.pow(F.col("cov") - F.col("sample"), 2.0))).alias("frobenius_distance"),
            F.sqrt(F.sum(F.pow(F.col("sample"), 2.0))).alias("sample_norm"),
        )
    )


def _matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    wide = rows.pivot(index="asset_i", columns="asset_j", values="cov").sort_index()
    return list(wide.index), wide[list(wide.index)].to_numpy(dtype=float)


def spectrum(cov: DataFrame) -> DataFrame:
    """Extreme eigenvalues and condition number per universe (and as_of).

    One task holds one covariance matrix: assets squared, however long the history.
    """
    keys = _keys(cov)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cov.select(*keys).schema.fields)

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, values = _matrix(rows)
        eig = np.linalg.eigvalsh((values + values.T) / 2)
        return pd.DataFrame(
            [[*key, float(eig[0]), float(eig[-1]), float(np.linalg.cond(values))]],
            columns=[*keys, "smallest_eigenvalue", "largest_eigenvalue", "condition_number"],
        )

    return cov.groupBy(*keys).applyInPandas(
        measure, f"{fields}, smallest_eigenvalue double, largest_eigenvalue double, condition_number double"
    )


def trailing_pair_correlation(returns: DataFrame, length: int, marks: DataFrame | None = None) -> DataFrame:
    """Correlation of every asset pair (asset_i < asset_j) over the last ``length`` sessions; of the sessions of ``marks`` only, if given."""
    return tiles.trailing_correlations(returns, length, marks)


def average_trailing_correlation(returns: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Average pair correlation over the ``length`` sessions up to each of ``marks(universe_id, session)``.

    With standardised returns z it is ((sum over sessions of (sum of z)^2) / (length - 1) - n) / (n (n - 1)), so the
    rows are those of the windows before marked dates, and linear in the assets. Flat assets have no correlation.
    """
    sessions = returns.select("universe_id", "session").distinct()
    numbered = sessions.withColumn("no", F.row_number().over(Window.partitionBy("universe_id").orderBy("session")))
    asked = (
        marks.select("universe_id", "session").distinct().join(numbered, ["universe_id", "session"]).filter(F.col("no") >= length)
        .select("universe_id", F.col("session").alias("mark"), F.explode(F.sequence(F.col("no") - length + 1, F.col("no"))).alias("no"))
    )
    own = Window.partitionBy("universe_id", "mark", "asset")
    rows = (
        returns.join(numbered, ["universe_id", "session"]).join(asked, ["universe_id", "no"])
        .withColumns({"seen": F.count("ret").over(own), "mean": F.avg("ret").over(own), "sd": F.stddev_samp("ret").over(own)})
        .filter((F.col("seen") == length) & (F.col("sd") > 0))
    )
    per_session = rows.groupBy("universe_id", "mark", "no").agg(F.sum((F.col("ret") - F.col("mean")) / F.col("sd")).alias("z"), F.count(F.lit(1)).alias("n"))
    total, n = F.sum(F.col("z") * F.col("z")), F.max("n")
    average = F.try_divide(F.try_divide(total, F.lit(length - 1)) - n, n * (n - 1))
    return per_session.groupBy("universe_id", F.col("mark").alias("session")).agg(average.alias("average_corr"))


def average_pairwise(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("universe_id", "session").agg(F.avg("corr").alias("average_corr"))
