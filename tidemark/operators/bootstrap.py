"""Paired circular block bootstrap of two return series.

``pairs`` rows: comparison keys, an order column, ``challenger`` and
``benchmark``. Each comparison's series is folded into one row (its length is a
number of periods), sent out once per hundred iterations and copied for each of
them inside the task, where one iteration is computed in its own row.
Draws come from an md5 of (iteration, block, seed): reproducible on any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_OBSERVATIONS = 12
#: Iterations that one copy of a series on the network serves.
CHUNK = 100


def series_rows(pairs: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per comparison with its aligned series as arrays in time order."""
    complete = pairs
    for c in columns:
        complete = complete.filter(F.col(c).isNotNull())
    packed = F.array_sort(F.collect_list(F.struct(order, *columns)))
    rows = complete.groupBy(*keys).agg(packed.alias("p"))
    return rows.select(
        *keys, F.size("p").alias("n"), *[F.col(f"p.{c}").alias(c) for c in columns]
    )


def too_short(pairs: DataFrame, keys: list[str], order: str, columns: list[str], least: int = MIN_OBSERVATIONS) -> DataFrame:
    """Comparisons that the bootstrap leaves out, with their number of complete observations."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    counted = pairs.groupBy(*keys).agg(F.count_if(complete & F.col(order).isNotNull()).alias("observations"))
    return counted.filter(F.col("observations") < least).withColumn("issue", F.lit("TOO_FEW_OBSERVATIONS"))


def draw(iteration: Column, block: Column, seed: int | Column, n: Column) -> Column:
    """A reproducible integer in [0, n)."""
    seed_text = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat_ws("|", iteration.cast("string"), block.cast("string"), seed_text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def resample(rows: DataFrame, columns: list[str], iterations: int, block_length: int, seed: int | Column) -> DataFrame:
    """Every iteration's positions and resampled series."""
    blocks = F.ceil(F.col("n") / block_length).cast("int")
    # Few bytes but much arithmetic per row: a fixed count keeps adaptive execution from folding the tasks into one.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // CHUNK))))
    dealt = chunks.repartition(tasks, "chunk", *[c for c in rows.columns if c not in columns])
    last = F.least((F.col("chunk") + 1) * CHUNK, F.lit(iterations)) - 1
    spread = dealt.withColumn("iteration", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")
    starts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: draw(F.col("iteration"), b, seed, F.col("n")))
    offsets = F.sequence(F.lit(0), F.lit(block_length - 1))
    runs = F.transform(starts, lambda s: F.transform(offsets, lambda o: (s + o) % F.col("n")))
    placed = spread.withColumn("positions", F.slice(F.flatten(runs), 1, F.col("n")))

    def pick(column: str) -> Column:
        return F.transform("positions", lambda p: F.element_at(column, (p + 1).cast("int")))

    return placed.withColumns({c: pick(c) for c in columns}).drop("positions")


def _growth(series: str) -> Column:
    return F.aggregate(series, F.lit(1.0), lambda acc, x: acc * (1.0 + x))


def _mean(series: str) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda acc, x: acc + x) / F.col("n")


def _std(series: str) -> Column:
    centred = F.aggregate(series, F.lit(0.0), lambda acc, x: acc + F.pow(x - F.col(f"{series}_mean"), 2.0))
    return F.sqrt(F.try_divide(centred, F.col("n") - 1))


def _drawdown(series: str) -> Column:
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        wealth = acc["w"] * (1.0 + x)
        peak = F.greatest(acc["peak"], wealth)
        return F.struct(wealth.alias("w"), peak.alias("peak"), F.least(acc["worst"], F.try_divide(wealth, peak) - 1.0).alias("worst"))

    return F.aggregate(series, start, step, lambda acc: acc["worst"])


def series_statistics(samples: DataFrame, columns: list[str], periods: int) -> DataFrame:
    """Annualised return, Sharpe ratio and drawdown of each resampled series."""
    out = samples.withColumns({f"{c}_mean": _mean(c) for c in columns})
    out = out.withColumns({f"{c}_std": _std(c) for c in columns} | {f"{c}_growth": _growth(c) for c in columns})
    stats = {}
    for c in columns:
        grown, std = F.col(f"{c}_growth"), F.col(f"{c}_std")
        stats[f"{c}_annualized_return"] = F.when(grown > 0, F.pow(grown, F.lit(float(periods)) / F.col("n")) - 1.0)
        stats[f"{c}_sharpe"] = F.when(std > 0, F.col(f"{c}_mean") / std * math.sqrt(periods))
        stats[f"{c}_max_drawdown"] = _drawdown(c)
    return out.withColumns(stats)


def block_bootstrap(
    pairs: DataFrame, keys: list[str], order: str, iterations: int = 5000, block_length: int = 6,
    periods: int = 12, seed: int = 42,
) -> DataFrame:
    """Per iteration: both sides' statistics and their differences; positive drawdown improvement is shallower."""
    columns = ["challenger", "benchmark"]
    rows = series_rows(pairs, keys, order, columns)
    enough = (F.col("n") >= MIN_OBSERVATIONS) & (F.col("n") >= block_length)
    samples = series_statistics(resample(rows.filter(enough), columns, iterations, block_length, seed), columns, periods)
    return samples.select(
        *keys,
        "iteration",
        "n",
        *[f"{c}_{s}" for s in ("annualized_return", "sharpe", "max_drawdown") for c in columns],
        (F.col("challenger_annualized_return") - F.col("benchmark_annualized_return")).alias("annualized_return_difference"),
        (F.col("challenger_sharpe") - F.col("benchmark_sharpe")).alias("sharpe_difference"),
        (F.col("challenger_max_drawdown") - F.col("benchmark_max_drawdown")).alias("drawdown_improvement"),
    )


def _won(column: str) -> Column:
    return F.avg(F.coalesce(F.col(column) > 0, F.lit(False)).cast("double"))


def bootstrap_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Means, 95% intervals and win probabilities; a comparison has as many rows as iterations."""

    def interval(column: str, name: str) -> list[Column]:
        bounds = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
        return [bounds[0].alias(f"{name}_ci_low"), bounds[1].alias(f"{name}_ci_high")]

    return samples.groupBy(*keys).agg(
        F.max("n").alias("observations"),
        F.count(F.lit(1)).alias("bootstrap_samples"),
        F.avg("sharpe_difference").alias("mean_sharpe_difference"),
        F.percentile("sharpe_difference", 0.5).alias("median_sharpe_difference"),
        *interval("sharpe_difference", "sharpe_difference"),
        _won("sharpe_difference").alias("probability_sharpe_improvement"),
        F.avg("annualized_return_difference").alias("mean_return_difference"),
        *interval("annualized_return_difference", "return_difference"),
        _won("annualized_return_difference").alias("probability_return_improvement"),
        F.avg("drawdown_improvement").alias("mean_drawdown_improvement"),
        _won("drawdown_improvement").alias("probability_drawdown_improvement"),
    )


def iid_bootstrap(
    quarterly: DataFrame, keys: list[str], order: str, selector: str, benchmarks: list[str],
    iterations: int = 10000, seed: int | Column = 42, periods: int = 4,
) -> DataFrame:
    """Independent resampling of decision periods: win probabilities and excess intervals against each benchmark."""
    columns = [selector, *benchmarks]
    rows = series_rows(quarterly, keys, order, columns).filter("n >= 2")
    samples = series_statistics(resample(rows, columns, iterations, 1, seed), columns, periods)
    out = []
    for b in benchmarks:
        better = F.col(f"{selector}_annualized_return") > F.col(f"{b}_annualized_return")
        steadier = F.col(f"{selector}_sharpe") > F.col(f"{b}_sharpe")
        bounds = F.percentile(F.col(f"{selector}_mean") - F.col(f"{b}_mean"), F.array(F.lit(0.025), F.lit(0.975)))
        out += [
            F.avg(F.coalesce(better, F.lit(False)).cast("double")).alias(f"p_return_above_{b}"),
            F.avg(F.coalesce(steadier, F.lit(False)).cast("double")).alias(f"p_sharpe_above_{b}"),
            bounds[0].alias(f"excess_{b}_ci_low"),
            bounds[1].alias(f"excess_{b}_ci_high"),
        ]
    return samples.groupBy(*keys).agg(F.max("n").alias("quarters"), F.count(F.lit(1)).alias("draws"), *out)
