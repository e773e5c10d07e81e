"""Expected-return estimators, as known at every session of a series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

# Share of the strategic and the tactical estimate in the robust blend.
STRATEGIC, TACTICAL = 0.80, 0.20


def expected_returns(
    returns: DataFrame, span: int = 126, periods: int = stats.TRADING_DAYS,
    blend: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Geometric, arithmetic, exponentially weighted, blended and robust estimates per session.

    The recursive average e_t = (1-a) e_(t-1) + a r_t with e_1 = r_1 is a sum of
    returns weighted by powers of 1-a, the first return counting without the
    factor a. Powers are taken relative to blocks of the series, long enough for
    the weight to fall to 1e-100 over one: the running sum of the own block and the
    sum of the block before are all that a double can tell, for any length.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    length = max(1, int(math.log(1e-100) / math.log(decay))) if decay > 0 else 1
    keys = ["universe_id", "asset"]
    window = stats.running(keys, "session")
    t = F.col("t").cast("double")
    lead = F.when(F.col("t") == 1, 1.0).otherwise(1.0 - decay)
    place = F.col("place").cast("double")
    own = Window.partitionBy(*keys, "block").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("block").rangeBetween(-1, -1)
    recent = F.sum("scaled").over(own) * F.pow(F.lit(decay), place)
    older = F.coalesce(F.sum("scaled").over(before) * F.pow(F.lit(decay), place + length), F.lit(0.0))
    path = (
        returns.withColumn("t", F.count("ret").over(window))
        .withColumns({"block": F.floor((F.greatest("t", F.lit(1)) - 1) / length), "place": F.pmod(F.greatest("t", F.lit(1)) - 1, F.lit(length))})
        .withColumn("scaled", lead * F.col("ret") * F.pow(F.lit(decay), -place))
        .withColumns(
            {
                "geometric": F.pow(F.product(1.0 + F.col("ret")).over(window), F.try_divide(F.lit(float(periods)), t)) - 1.0,
                "arithmetic": F.avg("ret").over(window) * periods,
                "ewma": (recent + older) * periods,
            }
        )
    )
    g, a, e = F.col("geometric"), F.col("arithmetic"), F.col("ewma")
    total = sum(blend)
    mean = (g + a + e) / 3.0
    return path.select(
        "universe_id",
        "session",
        "asset",
        F.col("t").alias("observations"),
        g,
        a,
        e,
        ((g * blend[0] + a * blend[1] + e * blend[2]) / total).alias("blended"),
        ((g + a) / 2.0 * STRATEGIC + e * TACTICAL).alias("robust"),
        F.sqrt((F.pow(g - mean, 2.0) + F.pow(a - mean, 2.0) + F.pow(e - mean, 2.0)) / 3.0).alias("estimator_dispersion"),
    )


def latest_expected_returns(returns: DataFrame, span: int = 126) -> DataFrame:
    """The estimates at the last session of each universe."""
    last = returns.groupBy("universe_id").agg(F.max("session").alias("session"))
    return expected_returns(returns, span).join(last, ["universe_id", "session"])
