"""Standardised ridge forecasts refitted at every date from sums of products.

A design table is wide: ``universe_id, rebalance_date, horizon_end?``, feature
and target columns. Each row is turned into its Gram rows once; they are
accumulated by one running sum, and a small solve per date reads at most
(features + targets) squared numbers, never the history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 10.0
MIN_TRAINING = 36
KEYS = ["universe_id", "rebalance_date"]


def training_sums(design: DataFrame, features: list[str], targets: list[str], purged: bool) -> DataFrame:
    """Gram rows of every date's training rows: ``universe_id, rebalance_date, i, row`` with row i as an array.

    Unpurged training uses all strictly earlier dates. Purged training uses rows
    whose horizon ended strictly before the date: completions and questions are
    stacked on one time line, questions first on equal dates, and summed along
    it, so no (row, date) pairs are formed. A decision is one row per Gram row
    with its cells as columns; a window group is one Gram row of one universe
    and as long as its list of decision dates.
    """
    names = [*features, *targets]
    vector = F.array(F.lit(1.0), *[F.col(n).cast("double") for n in names])
    rows = design.select(*KEYS, *(["horizon_end"] if purged else []), vector.alias("z")).select("*", F.posexplode("z").alias("i", "own"))
    cells = [f"g{j}" for j in range(len(names) + 1)]
    none = F.lit(None).cast("date")
    at = "horizon_end" if purged else "rebalance_date"
    done = rows.select("universe_id", F.col(at).alias("at"), F.lit(1).alias("kind"), "i", none.alias("asked"), *[(F.col("own") * F.col("z")[j]).alias(c) for j, c in enumerate(cells)])
    ask = rows.select(
        "universe_id", F.col("rebalance_date").alias("at"), F.lit(0).alias("kind"), "i", F.col("rebalance_date").alias("asked"), *[F.lit(0.0).alias(c) for c in cells]
    )
    order = Window.partitionBy("universe_id", "i").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    totals = F.array(*[F.sum(c).over(order) for c in cells])
    return (
        done.unionByName(ask)
        .select("universe_id", "asked", "i", totals.alias("row"))
        .filter("asked is not null")
        .select("universe_id", F.col("asked").alias("rebalance_date"), "i", "row")
    )


def fit(gram: np.ndarray, n_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature mean, feature scale, intercepts, standardised slopes) from a Gram matrix over (1, features, targets).

    Features are standardised by population moments (a constant feature gets
    scale 1); the penalty acts on standardised slopes and not on the intercept.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] / n - np.outer(mean, mean)
    f = n_features
    variance = np.diag(centred)[:f].copy()
    floor = 10 * np.finfo(float).eps * np.maximum(np.abs(np.diag(gram)[1 : f + 1] / n), 1e-300)
    scale = np.where(variance > floor, np.sqrt(np.maximum(variance, 0.0)), 1.0)
    zz = centred[:f, :f] / np.outer(scale, scale) * n
    zy = centred[:f, f:] / scale[:, None] * n
    return mean[:f], scale, mean[f:], np.linalg.solve(zz + alpha * np.eye(f), zy)


def unpack(cells, k: int) -> np.ndarray:
    """Symmetric matrix from its cells in row order."""
    return np.asarray(cells, dtype=float).reshape(k, k)


def _packed(sums: DataFrame) -> DataFrame:
    """One row per date with the cells of its Gram matrix in row order."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "row")))
    return (
        sums.groupBy(*KEYS)
        .agg(F.flatten(F.transform(ordered, lambda x: x["row"])).alias("g"))
        .withColumn("training_labels", F.col("g")[0].cast("long"))
    )


def predictions(
    design: DataFrame, features: list[str], targets: list[str], purged: bool = False,
    alpha: float = ALPHA, min_training: int = MIN_TRAINING,
) -> DataFrame:
    """Long forecasts: ``universe_id, rebalance_date, training_labels, target, predicted, actual``."""
    k = len(features) + len(targets) + 1
    rows_now = design.select(
        *KEYS,
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.array(*[F.col(c).cast("double") for c in targets]).alias("y"),
    )
    flat = (
        _packed(training_sums(design, features, targets, purged))
        .filter(F.col("training_labels") >= min_training)
        .join(rows_now, KEYS)
    )
    n_features = len(features)

    def forecast(batches):
        for rows in batches:
            values = []
            for g, x in zip(rows["g"], rows["x"]):
                mean, scale, intercept, slopes = fit(unpack(g, k), n_features, alpha)
                values.append((intercept + ((np.asarray(x, dtype=float) - mean) / scale) @ slopes).tolist())
            yield pd.DataFrame(
                {
                    "universe_id": rows["universe_id"],
                    "rebalance_date": rows["rebalance_date"],
                    "training_labels": rows["training_labels"],
                    "y": rows["y"],
                    "p": pd.Series(values, index=rows.index, dtype=object),
                }
            )

    solved = flat.mapInPandas(
        forecast,
        "universe_id string, rebalance_date date, training_labels long, y array<double>, p array<double>",
    )
    names = F.array(*[F.lit(t) for t in targets])
    return solved.select(
        *KEYS, "training_labels", F.explode(F.arrays_zip(names.alias("target"), F.col("p").alias("predicted"), F.col("y").alias("actual"))).alias("z")
    ).select(*KEYS, "training_labels", "z.target", "z.predicted", "z.actual")


def frozen_coefficients(
    design: DataFrame, features: list[str], targets: list[str], alpha: float = ALPHA, purged: bool = True, frozen_through: str | None = None
) -> DataFrame:
    """Coefficients of the latest fit of each universe: target, feature, mean, scale, slope and intercept.

    With ``frozen_through`` the latest fit on or before that date is taken. A
    purged fit knows only labels whose horizon has ended by its own date, so none
    reaches beyond the freeze.
    """
    k = len(features) + len(targets) + 1
    dates = design if frozen_through is None else design.filter(F.col("rebalance_date") <= F.to_date(F.lit(frozen_through)))
    last = dates.groupBy("universe_id").agg(F.max("rebalance_date").alias("rebalance_date"))
    packed = _packed(training_sums(design, features, targets, purged).join(last, KEYS, "left_semi"))
    n_features = len(features)

    def table(batches):
        for rows in batches:
            out = []
            for universe, date, g in zip(rows["universe_id"], rows["rebalance_date"], rows["g"]):
                mean, scale, intercept, slopes = fit(unpack(g, k), n_features, alpha)
                for t, target in enumerate(targets):
                    for f, feature in enumerate(features):
                        out.append((universe, date, target, feature, mean[f], scale[f], slopes[f, t], intercept[t]))
            yield pd.DataFrame(
                out, columns=["universe_id", "fitted_at", "target", "feature", "mean", "scale", "slope", "intercept"]
            )

    return packed.mapInPandas(
        table,
        "universe_id string, fitted_at date, target string, feature string, mean double, scale double, "
        "slope double, intercept double",
    )


def score_signal(snapshots: DataFrame, coefficients: DataFrame, features: list[str], frozen_through: str) -> DataFrame:
    """Frozen coefficients applied to feature snapshots; ``forward_only`` marks dates after the freeze."""
    long = snapshots.unpivot(KEYS, features, "feature", "value")
    term = F.col("slope") * (F.col("value") - F.col("mean")) / F.col("scale")
    return (
        long.join(coefficients, ["universe_id", "feature"])
        .groupBy(*KEYS, "target")
        .agg((F.max("intercept") + F.sum(term)).alias("score"))
        .withColumn("forward_only", F.col("rebalance_date") > F.to_date(F.lit(frozen_through)))
    )
