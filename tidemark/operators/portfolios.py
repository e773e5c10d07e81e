"""Weights of many portfolios: normalising, constant-mix returns, blends and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import covariance, metrics, risk
from tidemark.session import cut_lineage

PORTFOLIO = ["portfolio_id"]


def invalid_weights(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Portfolios with a missing, non-finite or negative weight or a total that is not positive."""
    keys = keys or PORTFOLIO
    number = F.col("weight")
    broken = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")) | (number < 0)
    return (
        weights.groupBy(*keys)
        .agg(F.count_if(broken).alias("bad_weights"), F.sum("weight").alias("total"))
        .filter((F.col("bad_weights") > 0) | (F.coalesce(F.col("total"), F.lit(0.0)) <= 0))
    )


def normalize_weights(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scale each portfolio to one; a portfolio is as large as its list of holdings."""
    total = F.sum("weight").over(Window.partitionBy(*(keys or PORTFOLIO)))
    return weights.withColumn("weight", F.try_divide(F.col("weight"), total))


def portfolio_returns(returns: DataFrame, weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Daily constant-mix return; assets a portfolio does not hold weigh nothing.

    The product is summed map-side before the shuffle on (portfolio, session).
    """
    return (
        returns.join(weights, "asset")
        .groupBy(*(keys or PORTFOLIO), "universe_id", "session")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def pair_weights(personal: DataFrame, optimizer: DataFrame) -> DataFrame:
    """Both normalised weight vectors over the union of their symbols."""
    left = normalize_weights(personal).withColumnRenamed("weight", "personal")
    right = normalize_weights(optimizer).withColumnRenamed("weight", "optimizer")
    return left.join(right, ["portfolio_id", "asset"], "full").na.fill(0.0, ["personal", "optimizer"])


def blend_weights(personal: DataFrame, optimizer: DataFrame, alphas: list[float]) -> DataFrame:
    """(1-alpha) personal + alpha optimizer for every alpha of a grid, renormalised."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in sorted(set(alphas))]))
    mixed = (
        pair_weights(personal, optimizer)
        .withColumn("alpha", grid)
        .select(
            "portfolio_id",
            "alpha",
            "asset",
            ((1.0 - F.col("alpha")) * F.col("personal") + F.col("alpha") * F.col("optimizer")).alias("weight"),
        )
    )
    return normalize_weights(mixed, ["portfolio_id", "alpha"])


def concentration(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or PORTFOLIO
    squares = F.sum(F.col("weight") * F.col("weight"))
    return (
        normalize_weights(weights, keys)
        .groupBy(*keys)
        .agg(squares.alias("concentration"), F.try_divide(F.lit(1.0), squares).alias("effective_positions"))
    )


def compare_weights(personal: DataFrame, optimizer: DataFrame) -> DataFrame:
    """Overlap, L1 distance and one-way turnover between two weight vectors."""
    gap = F.sum(F.abs(F.col("personal") - F.col("optimizer")))
    return (
        pair_weights(personal, optimizer)
        .groupBy("portfolio_id")
        .agg(
            F.sum(F.least("personal", "optimizer")).alias("portfolio_overlap"),
            gap.alias("weight_difference"),
            (0.5 * gap).alias("turnover"),
        )
    )


def tracking_error(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Annualised deviation of the return difference over common sessions."""
    other = right.withColumnRenamed("ret", "other_ret")
    return (
        left.join(other, [*keys, "session"])
        .withColumn("active", F.col("ret") - F.col("other_ret"))
        .groupBy(*keys)
        .agg(stats.annualized_volatility("active", stats.TRADING_DAYS).alias("tracking_error"))
    )


def benchmark_summary(returns: DataFrame, personal: DataFrame, optimizer: DataFrame, benchmark: str) -> DataFrame:
    """One row per portfolio: its own book against the optimizer's, an equal weight book and one symbol."""
    key = ["portfolio_id"]
    equal = optimizer.withColumn("weight", F.lit(1.0))
    single = personal.select(*key).distinct().withColumns({"asset": F.lit(benchmark), "weight": F.lit(1.0)})
    books = {"personal": personal, "optimizer": optimizer, "equal_weight": equal, "benchmark": single}
    stacked = None
    for name, book in books.items():
        tagged = normalize_weights(book).withColumn("book", F.lit(name)).select(*key, "book", "asset", "weight")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    daily = cut_lineage(portfolio_returns(returns, stacked, ["portfolio_id", "book"]))
    risk_rows = metrics.research_summary(daily, ["portfolio_id", "book", "universe_id"], "session", "ret")
    wide = (
        risk_rows.groupBy(*key)
        .pivot("book", list(books))
        .agg(F.first("annualized_volatility").alias("volatility"), F.first("max_drawdown").alias("max_drawdown"))
    )
    own = daily.filter("book = 'personal'").drop("book")
    other = daily.filter("book = 'optimizer'").drop("book")

    def held(book: DataFrame, prefix: str) -> DataFrame:
        return concentration(book).withColumnsRenamed(
            {"concentration": f"{prefix}_concentration", "effective_positions": f"{prefix}_effective_positions"}
        )

    return (
        wide.drop("equal_weight_max_drawdown", "benchmark_max_drawdown")
        .join(held(personal, "personal"), key)
        .join(held(optimizer, "optimizer"), key)
        .join(tracking_error(own, other, ["portfolio_id", "universe_id"]).drop("universe_id"), key)
        .join(compare_weights(personal, optimizer), key)
    )


def blend_table(returns: DataFrame, personal: DataFrame, optimizer: DataFrame, alphas: list[float]) -> DataFrame:
    """Per portfolio and alpha: performance, distance from both books, risk shares and changes against personal."""
    key = ["portfolio_id", "alpha"]
    blends = cut_lineage(blend_weights(personal, optimizer, [0.0, 1.0, *alphas]))
    daily = cut_lineage(portfolio_returns(returns, blends, key))
    perf = metrics.research_summary(daily, key, "session", "ret")
    rolling = metrics.worst_rolling_return(daily, key, "session", "ret")
    ends = daily.filter("alpha in (0.0, 1.0)").groupBy("portfolio_id", "session").agg(
        F.max(F.when(F.col("alpha") == 0.0, F.col("ret"))).alias("own_ret"),
        F.max(F.when(F.col("alpha") == 1.0, F.col("ret"))).alias("optimizer_ret"),
    )
    errors = (
        daily.join(ends, ["portfolio_id", "session"])
        .withColumn("versus_own", F.col("ret") - F.col("own_ret"))
        .withColumn("versus_optimizer", F.col("ret") - F.col("optimizer_ret"))
        .groupBy(*key)
        .agg(
            stats.annualized_volatility("versus_own", stats.TRADING_DAYS).alias("tracking_error_vs_personal"),
            stats.annualized_volatility("versus_optimizer", stats.TRADING_DAYS).alias("tracking_error_vs_optimizer"),
        )
    )
    own_weights = blends.filter("alpha = 0.0").select("portfolio_id", "asset", F.col("weight").alias("own_weight"))
    shape = (
        blends.join(own_weights, ["portfolio_id", "asset"])
        .groupBy(*key)
        .agg(
            F.sum(F.col("weight") * F.col("weight")).alias("concentration"),
            (0.5 * F.sum(F.abs(F.col("weight") - F.col("own_weight")))).alias("turnover_from_personal"),
        )
        .withColumn("effective_positions", F.try_divide(F.lit(1.0), F.col("concentration")))
    )
    shares = (
        risk.risk_contributions(blends, covariance.sample_covariance(returns), key)
        .groupBy(*key)
        .agg(F.max(F.abs("risk_share")).alias("largest_absolute_risk_contribution"))
    )
    table = cut_lineage(perf.join(rolling, key).join(errors, key).join(shape, key).join(shares, key))
    base = table.filter("alpha = 0.0").select(
        "portfolio_id",
        F.col("annualized_return").alias("own_return"),
        F.col("annualized_volatility").alias("own_volatility"),
        F.col("max_drawdown").alias("own_drawdown"),
        F.col("concentration").alias("own_concentration"),
    )
    wanted = [float(a) for a in alphas]
    return (
        table.filter(F.col("alpha").isin(wanted))
        .join(base, "portfolio_id")
        .withColumns(
            {
                "personal_blend_weight": 1.0 - F.col("alpha"),
                "annualized_return_change_vs_personal": F.col("annualized_return") - F.col("own_return"),
                "volatility_change_vs_personal": F.col("annualized_volatility") - F.col("own_volatility"),
                "max_drawdown_change_vs_personal": F.col("max_drawdown") - F.col("own_drawdown"),
                "concentration_change_vs_personal": F.col("concentration") - F.col("own_concentration"),
                "lower_volatility_than_personal": F.col("annualized_volatility") < F.col("own_volatility"),
                "shallower_drawdown_than_personal": F.col("max_drawdown") > F.col("own_drawdown"),
                "lower_concentration_than_personal": F.col("concentration") < F.col("own_concentration"),
            }
        )
        .drop("own_return", "own_volatility", "own_drawdown", "own_concentration")
    )


def best_blends(table: DataFrame) -> DataFrame:
    """The blends with the shallowest drawdown, the lowest volatility and the lowest concentration."""
    choices = [
        ("best_drawdown", F.struct(-F.col("max_drawdown"), "alpha")),
        ("lowest_volatility", F.struct("annualized_volatility", "alpha")),
        ("lowest_concentration", F.struct("concentration", "alpha")),
    ]
    return table.groupBy("portfolio_id").agg(*[F.min_by("alpha", order).alias(name) for name, order in choices])


# Fixed value: sessions needed before a forward comparison counts as formal.
FORMAL_SESSIONS = 20


def forward_blend_daily(returns: DataFrame, personal: DataFrame, optimizer: DataFrame, alphas: list[float]) -> DataFrame:
    """Daily return of each blend, one column per alpha."""
    daily = portfolio_returns(returns, blend_weights(personal, optimizer, alphas), ["portfolio_id", "alpha"])
    labels = [f"optimizer_{int(round(a * 100)):03d}" for a in sorted(set(alphas))]
    label = F.format_string("optimizer_%03d", F.round(F.col("alpha") * 100).cast("int"))
    return (
        daily.withColumn("label", label).groupBy("portfolio_id", "session").pivot("label", labels).agg(F.first("ret"))
    )


def forward_blend_table(returns: DataFrame, personal: DataFrame, optimizer: DataFrame, alphas: list[float]) -> DataFrame:
    """Realised results of each blend after the freeze, and its excess over the untouched book."""
    key = ["portfolio_id", "alpha"]
    daily = portfolio_returns(returns, blend_weights(personal, optimizer, [0.0, *alphas]), key)
    path = stats.drawdown_path(daily, key, "session", "ret", start_at_one=False)
    rows = path.groupBy(*key).agg(
        F.count("ret").alias("observed_sessions"),
        stats.total_return("ret").alias("cumulative_return"),
        stats.annualized_volatility("ret", stats.TRADING_DAYS).alias("realized_annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("ret").alias("best_day"),
        F.min("ret").alias("worst_day"),
        F.avg((F.col("ret") > 0).cast("double")).alias("positive_session_rate"),
    )
    own = rows.filter("alpha = 0.0").select("portfolio_id", F.col("cumulative_return").alias("own_return"))
    status = F.when(F.col("observed_sessions") < FORMAL_SESSIONS, "PROVISIONAL").otherwise("FORMAL")
    return (
        rows.filter(F.col("alpha").isin([float(a) for a in alphas]))
        .join(own, "portfolio_id")
        .withColumn("cumulative_excess_return_vs_personal", F.col("cumulative_return") - F.col("own_return"))
        .withColumn("status", status)
        .drop("own_return")
    )
