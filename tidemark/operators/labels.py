"""Forward-return labels per decision date and their join with features.

``results`` rows: ``universe_id, model, rebalance_date, period_end, net_return``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BENCHMARK = "equal_weight"
DATE = ["universe_id", "rebalance_date"]


def duplicate_results(results: DataFrame) -> DataFrame:
    """(date, model) keys with more than one result; labels over them are an error."""
    return results.groupBy(*DATE, "model").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def _wide_labels(long: DataFrame, models: list[str], value: str, ranks: bool, extra: list | None = None) -> DataFrame:
    """Labels from long returns in one aggregate; dates missing a model are dropped.

    ``models`` is the column order, which also settles ties for the best model.
    """
    names = sorted(models)
    cell = {m: F.max(F.when(F.col("model") == m, F.col(value))) for m in names}
    wide = long.groupBy(*DATE).agg(
        F.countDistinct("model").alias("present"), *[cell[m].alias(f"{m}_forward_return") for m in names], *(extra or [])
    )
    returns = [F.col(f"{m}_forward_return") for m in names]
    values = F.array(*returns)
    ordered = F.array_sort(values)
    mean = reduce(lambda a, b: a + b, returns) / len(names)
    spread = reduce(lambda a, b: a + b, [F.pow(c - mean, 2.0) for c in returns]) / len(names)
    out = {f"{m}_excess_vs_{BENCHMARK}": F.col(f"{m}_forward_return") - F.col(f"{BENCHMARK}_forward_return") for m in names}
    if ranks:
        for m in names:
            above = [F.when(c > F.col(f"{m}_forward_return"), 1).otherwise(0) for c in returns]
            out[f"{m}_rank"] = reduce(lambda a, b: a + b, above) + 1
    out |= {
        "best_model": F.element_at(F.array(*[F.lit(m) for m in names]), F.array_position(values, F.array_max(values)).cast("int")),
        "best_model_return": F.array_max(values),
        "worst_model_return": F.array_min(values),
        "winner_margin": F.element_at(ordered, -1) - F.element_at(ordered, -2),
        "model_return_dispersion": F.sqrt(spread),
    }
    return wide.filter(F.col("present") == len(names)).drop("present").withColumns(out)


def forward_labels(results: DataFrame, models: list[str]) -> DataFrame:
    """One-period labels: return, excess, rank (1 = best, ties share), winner and margins."""
    return _wide_labels(results, models, "net_return", ranks=True)


def horizon_returns(results: DataFrame, horizon: int = 3) -> DataFrame:
    """Compound of the next ``horizon`` net returns of each model, dated at the start; short tails are dropped."""
    series = Window.partitionBy("universe_id", "model").orderBy("rebalance_date")
    ahead = series.rowsBetween(0, horizon - 1)
    return (
        results.withColumns(
            {
                "seen": F.count("net_return").over(ahead),
                "forward_return": F.product(1.0 + F.col("net_return")).over(ahead) - 1.0,
                "horizon_end": F.last("period_end").over(ahead),
            }
        )
        .filter(F.col("seen") == horizon)
        .select(*DATE, "horizon_end", "model", F.lit(horizon).alias("horizon_periods"), "forward_return")
    )


def horizon_labels(results: DataFrame, models: list[str], horizon: int = 3) -> DataFrame:
    long = horizon_returns(results, horizon)
    return _wide_labels(long, models, "forward_return", ranks=False, extra=[F.max("horizon_end").alias("horizon_end")])


def join_tables(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inner join of two wide tables by date; a shared column name is an error."""
    keys = keys or DATE
    clashes = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clashes:
        raise ValueError(f"columns present on both sides: {clashes}")
    return left.join(right, keys)


def join_checks(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Counts that must be zero for the join to be whole: dates without a match and missing values."""
    keys = keys or DATE
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns], F.lit(0).cast("long"))
    joined = left.join(right.withColumn("matched", F.lit(True)), keys, "left")
    return joined.agg(
        F.count("matched").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("matched"), missing)), F.lit(0)).alias("missing_values"),
        F.count_if(F.col("matched").isNull()).alias("lost_rows"),
    )


def meta_dataset(features: DataFrame, labels: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """Features, labels and optional macro features of each decision date."""
    table = join_tables(features, labels)
    return table if macro is None else join_tables(table, macro)
