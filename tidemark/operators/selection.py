"""Choosing a model per decision date from forecasts, and what became of the choice.

``forecasts`` rows: ``universe_id, rebalance_date, model, predicted, actual``
with one row per candidate; ``actual`` is the realised excess over the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import metrics, periods, ranks

BENCHMARK = "equal_weight"
THRESHOLD = 0.0
DATE = ["universe_id", "rebalance_date"]
# Fixed value: periods held per quarterly decision.
HOLD = 3


def _position(candidates: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))


def select_models(
    forecasts: DataFrame, labels: DataFrame, candidates: list[str], threshold: float = THRESHOLD, keys: list[str] | None = None
) -> DataFrame:
    """The candidate with the highest forecast above the threshold, else the benchmark.

    Ties go to the earlier candidate. ``labels`` supplies realised returns and
    the best model of each date.
    """
    keys = keys or DATE
    order = F.struct(F.col("predicted"), -_position(candidates))
    best = forecasts.groupBy(*keys).agg(
        F.max_by(F.struct("model", "predicted", "actual"), order).alias("top"),
    )
    active = F.col("top.predicted") > threshold
    chosen = best.select(
        *keys,
        F.when(active, F.col("top.model")).otherwise(BENCHMARK).alias("selected_model"),
        F.when(active, F.greatest(F.col("top.predicted"), F.lit(0.0))).otherwise(0.0).alias("selected_predicted_excess"),
        F.when(active, F.col("top.actual")).otherwise(0.0).alias("selected_realized_excess"),
    )
    facts = labels.select(*DATE, F.col(f"{BENCHMARK}_forward_return"), F.col("best_model").alias("actual_best_model"))
    return chosen.join(facts, DATE).withColumn(
        "selected_forward_return", F.col(f"{BENCHMARK}_forward_return") + F.col("selected_realized_excess")
    )


def _sign(column: str) -> Column:
    return F.signum(F.col(column))


def _safe_corr(a: str, b: str) -> Column:
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def prediction_metrics(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, correlation and sign agreement per candidate."""
    error = F.col("predicted") - F.col("actual")
    return forecasts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        _safe_corr("predicted", "actual").alias("correlation"),
        F.avg((_sign("predicted") == _sign("actual")).cast("double")).alias("directional_accuracy"),
    )


def information_coefficients(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of forecast and outcome; ties have their average rank."""
    rows = forecasts.select(*keys, "predicted", "actual").filter("predicted is not null and actual is not null")
    predicted, actual = (ranks.average_ranks(rows, keys, c, n) for c, n in (("predicted", "rp"), ("actual", "ra")))
    ranked = rows.join(predicted, [*keys, "predicted"]).join(actual, [*keys, "actual"])
    return ranked.groupBy(*keys).agg(
        _safe_corr("predicted", "actual").alias("pearson_ic"), _safe_corr("rp", "ra").alias("spearman_ic")
    )


def calibration_buckets(forecasts: DataFrame, keys: list[str], bins: int = 4) -> DataFrame:
    """Realised outcome by quantile bucket of the forecast; equal forecasts keep date order.

    A value at 1-based rank k of n falls in bucket max(1, ceil((k-1) q / (n-1))),
    the right-closed interpolated quantile rule, which differs from ``ntile``.
    Bucket b thus ends at rank 1 + floor(b (n-1) / q); equal rows may fall on both sides of it.
    """
    ranked = ranks.distinct_ranks(forecasts, keys, ["predicted", "rebalance_date", "actual"])

    def bucket(k: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.try_divide((k - 1) * bins, F.col("total") - 1)).cast("int"))

    def end(b: Column) -> Column:
        return F.when(b < 1, 0).otherwise(1 + F.floor(b * (F.col("total") - 1) / bins))

    first, last = bucket(F.col("below") + 1), bucket(F.col("below") + F.col("n"))
    dealt = ranked.withColumn("bucket", F.explode(F.sequence(first, last))).withColumn(
        "held", F.least(F.col("below") + F.col("n"), end(F.col("bucket"))) - F.greatest(F.col("below"), end(F.col("bucket") - 1))
    )
    count = F.sum("held")
    return dealt.groupBy(*keys, "bucket").agg(
        count.alias("observations"),
        (F.sum(F.col("predicted") * F.col("held")) / count).alias("mean_predicted_excess"),
        (F.sum(F.col("actual") * F.col("held")) / count).alias("mean_realized_excess"),
        (F.sum((F.col("actual") > 0).cast("double") * F.col("held")) / count).alias("positive_realized_rate"),
    )


def sign_diagnostics(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Realised outcome by the sign of the forecast."""
    signal = F.when(F.col("predicted") > 0, "predicted_positive").otherwise("predicted_nonpositive")
    return (
        forecasts.withColumn("signal", signal)
        .groupBy(*keys, "signal")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.avg("actual").alias("mean_realized_excess"),
            F.percentile("actual", 0.5).alias("median_realized_excess"),
            F.avg((F.col("actual") > 0).cast("double")).alias("positive_realized_rate"),
        )
    )


def selection_metrics(selections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, hit rates, mean excess and the compounded proxy against the benchmark."""
    active = F.col("selected_model") != BENCHMARK
    won = (F.col("selected_realized_excess") > 0).cast("double")
    proxy = stats.growth("selected_forward_return")
    bench = stats.growth(f"{BENCHMARK}_forward_return")
    return selections.groupBy(*(keys or ["universe_id"])).agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg((F.col("selected_model") == F.col("actual_best_model")).cast("double")).alias("selection_accuracy"),
        F.avg(won).alias("positive_excess_rate"),
        F.avg(F.when(active, won)).alias("active_positive_rate"),
        F.avg("selected_realized_excess").alias("average_selected_excess"),
        (proxy - 1.0).alias("proxy_total_return"),
        (bench - 1.0).alias("equal_weight_total_return"),
        (F.try_divide(proxy, bench) - 1.0).alias("proxy_excess_growth"),
    )


def strategy_benchmarks(selections: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Static choices, the selector and the per-date best of all, summarised alike."""
    base = selections.select(*DATE, f"{BENCHMARK}_forward_return", "selected_forward_return")
    statics = (
        forecasts.join(base, DATE)
        .select(*DATE, F.col("model").alias("strategy"), (F.col(f"{BENCHMARK}_forward_return") + F.col("actual")).alias("ret"))
    )
    own = base.select(*DATE, F.lit("selector_proxy").alias("strategy"), F.col("selected_forward_return").alias("ret"))
    bench = base.select(*DATE, F.lit(BENCHMARK).alias("strategy"), F.col(f"{BENCHMARK}_forward_return").alias("ret"))
    oracle = (
        statics.unionByName(bench).groupBy(*DATE).agg(F.max("ret").alias("ret")).withColumn("strategy", F.lit("oracle_best"))
    )
    every = statics.unionByName(own).unionByName(bench).unionByName(oracle)
    return metrics.series_summary(every, ["universe_id", "strategy"], "rebalance_date", "ret")


def confusion_table(selections: DataFrame) -> DataFrame:
    """Actual best against selected model with margins; "All" marks a margin."""
    return (
        selections.cube("actual_best_model", "selected_model")
        .agg(F.count(F.lit(1)).alias("n"))
        .na.fill("All", ["actual_best_model", "selected_model"])
    )


def feature_set_diagnostics(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, correlations and the results of positive calls per feature set and candidate."""
    positive = F.col("predicted") > 0
    calls = forecasts.groupBy(*keys).agg(
        F.count_if(positive).alias("predicted_positive_count"),
        F.avg(F.when(positive, F.col("actual"))).alias("mean_realized_excess_when_positive"),
        F.avg(F.when(positive, (F.col("actual") > 0).cast("double"))).alias("positive_prediction_win_rate"),
    )
    return (
        prediction_metrics(forecasts, keys).drop("correlation").join(information_coefficients(forecasts, keys), keys).join(calls, keys)
    )


def selector_summary(selections: DataFrame, keys: list[str]) -> DataFrame:
    active = F.col("selected_model") != BENCHMARK
    excess = F.col("selected_realized_excess")
    return selections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("oos_predictions"),
        F.min("rebalance_date").alias("first_prediction"),
        F.max("rebalance_date").alias("last_prediction"),
        F.avg((F.col("selected_model") == F.col("actual_best_model")).cast("double")).alias("selection_accuracy"),
        F.avg(active.cast("double")).alias("active_rate"),
        F.avg(F.when(active, (excess > 0).cast("double"))).alias("active_win_rate"),
        F.avg(F.when(active, excess)).alias("mean_active_excess"),
        F.avg(excess).alias("mean_selected_excess"),
        F.percentile("selected_realized_excess", 0.5).alias("median_selected_excess"),
    )


def selection_frequency(selections: DataFrame, models: list[str], keys: list[str] | None = None) -> DataFrame:
    """Times each model was chosen, zero included."""
    keys = keys or ["universe_id"]
    names = F.array(*[F.lit(m) for m in models])
    counted = selections.groupBy(*keys, F.col("selected_model").alias("model")).agg(F.count(F.lit(1)).alias("selections"))
    every = selections.select(*keys).distinct().withColumn("model", F.explode(names))
    return every.join(counted, [*keys, "model"], "left").na.fill(0, ["selections"])


def phase_schedule(selections: DataFrame, phase: int, every: int = HOLD) -> DataFrame:
    """Every third prediction of a universe, starting at row ``phase``."""
    row = F.row_number().over(Window.partitionBy("universe_id").orderBy("rebalance_date"))
    return (
        selections.withColumn("row", row)
        .filter((F.col("row") > phase) & ((F.col("row") - 1 - phase) % every == 0))
        .drop("row")
        .withColumn("phase", F.lit(phase))
    )


def assign_models(decisions: DataFrame, rebalance_dates: DataFrame, hold: int = HOLD) -> DataFrame:
    """The first ``hold`` rebalance dates on or after each decision; shorter windows are dropped.

    Dates are numbered per universe, so a decision looks up its own number and
    the window is an equi-join on number + 0..hold-1.
    """
    order = Window.partitionBy("universe_id").orderBy("rebalance_date")
    dated = rebalance_dates.select(*DATE).distinct().withColumn("no", F.row_number().over(order))
    wanted = decisions.withColumnRenamed("rebalance_date", "decision_date")
    marks = dated.select("universe_id", F.col("rebalance_date").alias("at"), "no", F.lit(None).cast("date").alias("decision_date"))
    asks = wanted.select("universe_id", F.col("decision_date").alias("at"), F.lit(None).cast("int").alias("no"), "decision_date").distinct()
    # The first date on or after a decision: carry the smallest later number backwards.
    ahead = Window.partitionBy("universe_id").orderBy("at", F.col("no").isNotNull().cast("int")).rowsBetween(0, Window.unboundedFollowing)
    first = (
        marks.unionByName(asks)
        .withColumn("first_no", F.min("no").over(ahead))
        .filter("decision_date is not null")
        .select("universe_id", "decision_date", "first_no")
    )
    slots = wanted.join(first, ["universe_id", "decision_date"]).withColumn(
        "no", F.explode(F.sequence(F.col("first_no"), F.col("first_no") + hold - 1))
    )
    full = F.count(F.lit(1)).over(Window.partitionBy("universe_id", "phase", "decision_date"))
    return (
        slots.join(dated, ["universe_id", "no"])
        .withColumn("n", full)
        .filter(F.col("n") == hold)
        .select("universe_id", "phase", "decision_date", "rebalance_date", "selected_model")
    )


def overlapping_assignments(assignments: DataFrame) -> DataFrame:
    """Rebalance dates claimed by two decisions of one phase; the schedule is then an error."""
    return (
        assignments.groupBy("universe_id", "phase", "rebalance_date")
        .agg(F.count(F.lit(1)).alias("claims"))
        .filter("claims > 1")
    )


def selector_weight_history(assignments: DataFrame, weights: DataFrame, benchmarks: list[str], name: str = "selector") -> DataFrame:
    """Weights of the assigned model per date, next to static benchmarks on the same dates.

    The phase becomes part of the universe key so that every phase runs at once.
    """
    keys = ["universe_id", "rebalance_date"]
    chosen = assignments.select(*keys, "phase", F.col("selected_model").alias("model")).join(weights, [*keys, "model"])
    dates = assignments.select(*keys, "phase").distinct()
    statics = weights.filter(F.col("model").isin(benchmarks)).join(dates, keys)
    columns = [*keys, "phase", "model", "asset", "weight"]
    return chosen.withColumn("model", F.lit(name)).select(*columns).unionByName(statics.select(*columns))


def quarterly_compound(results: DataFrame, assignments: DataFrame, models: list[str], benchmarks: list[str]) -> DataFrame:
    """Monthly net returns compounded to decision periods, with the excess over each benchmark."""
    cells = [(F.product(F.when(F.col("model") == m, 1.0 + F.col("net_return")).otherwise(1.0)) - 1.0).alias(m) for m in models]
    wide = (
        results.join(
            assignments.select("universe_id", "phase", "decision_date", "rebalance_date"), ["universe_id", "phase", "rebalance_date"]
        )
        .groupBy("universe_id", "phase", "decision_date")
        .agg(*cells)
    )
    return wide.withColumns({f"excess_vs_{b}": F.col(models[0]) - F.col(b) for b in benchmarks})


def decision_equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dates both selectors decided, with both choices and whether they agree."""
    other = right.select(*DATE, F.col("selected_model").alias("other_model"))
    return (
        left.select(*DATE, "selected_model")
        .join(other, DATE)
        .withColumn("same", F.col("selected_model") == F.col("other_model"))
    )


def yearly_agreement(equivalence: DataFrame) -> DataFrame:
    return equivalence.groupBy("universe_id", F.year("rebalance_date").alias("year")).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(~F.col("same")).alias("different"),
        F.avg(F.col("same").cast("double")).alias("agreement"),
    )


def contribution_concentration(excess: DataFrame, keys: list[str], column: str, top: int = 3) -> DataFrame:
    """Share of the total excess owed to the best few winners; NULL when the total is not positive.

    Each task keeps its own best values through the ranked window limit Spark
    pushes below the shuffle, and the total is an ordinary aggregate.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(column).desc())
    best = (
        excess.filter(F.col(column) > 0)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .groupBy(*keys)
        .agg(F.sum(column).alias("best"))
    )
    total = excess.groupBy(*keys).agg(F.sum(column).alias("total"), F.count(column).alias("periods"))
    return total.join(best, keys, "left").select(
        *keys, "periods", F.when(F.col("total") > 0, F.col("best") / F.col("total")).alias("top_share")
    )


def phase_results(phase_weights: DataFrame, realized: DataFrame, cost_bps=5.0) -> DataFrame:
    """Period results of every (phase, model) at once, optionally over a grid of costs."""
    tagged = phase_weights.withColumn("model", F.concat_ws("#", "model", F.col("phase").cast("string"))).drop("phase")
    results = periods.strategy_period_results(tagged, realized, cost_bps)
    return results.withColumn("phase", F.split_part("model", F.lit("#"), F.lit(2)).cast("int")).withColumn(
        "model", F.split_part("model", F.lit("#"), F.lit(1))
    )
