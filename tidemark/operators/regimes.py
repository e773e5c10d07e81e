"""Performance inside named date ranges and ranks across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranges

# Fixed value: the only metric for which a smaller number ranks first.
ASCENDING_METRICS = ("annualized_volatility",)


def custom_regimes(results: DataFrame, regimes: dict[str, tuple[str, str]], extra_keys: list[str] | None = None) -> DataFrame:
    """Summary per (named inclusive date range, model).

    The named ranges are a short literal list, so each row is tagged by an
    array of matching names and exploded instead of being range-joined.
    """
    end = F.col("period_end")
    names = [
        F.when(end.between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))), F.lit(name)) for name, (lo, hi) in regimes.items()
    ]
    tagged = results.withColumn("regime", F.explode(F.array_compact(F.array(*names))))
    keys = ["regime", *(extra_keys or []), "universe_id", "model"]
    return metrics.series_summary(tagged, keys, "period_end", "net_return")


def regimes_from_table(results: DataFrame, named: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Summary per (range, model) of ``named(universe_id, regime, start, stop)``, inclusive ranges of any number that may overlap."""
    tagged = ranges.join_ranges(results, "period_end", named, "start", "stop", ["universe_id"])
    return metrics.series_summary(tagged, ["regime", *(extra_keys or []), "universe_id", "model"], "period_end", "net_return")


def rank_by_regime(regime_results: DataFrame, metric: str = "sharpe", extra_keys: list[str] | None = None) -> DataFrame:
    """Rank within each regime; equal values share the smallest rank."""
    order = F.col(metric).asc_nulls_last() if metric in ASCENDING_METRICS else F.col(metric).desc_nulls_last()
    group = Window.partitionBy("regime", *(extra_keys or []), "universe_id").orderBy(order)
    return regime_results.withColumn("rank", F.when(F.col(metric).isNotNull(), F.rank().over(group)))


def mean_rank(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("universe_id", "model").agg(
        F.avg("rank").alias("mean_rank"), F.count("rank").alias("regimes")
    )
