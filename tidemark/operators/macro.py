"""Macro series: availability lag, as-of fill on a calendar, and features without look-ahead.

Long form is ``available_date, series, value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import sliding

# Series column, days until an observation is public, frequency.
SERIES_SPEC = (
    ("yield_2y", 1, "daily"),
    ("yield_10y", 1, "daily"),
    ("yield_30y", 1, "daily"),
    ("fed_funds", 1, "daily"),
    ("breakeven_10y", 1, "daily"),
    ("real_yield_10y", 1, "daily"),
    ("unemployment", 40, "monthly"),
    ("initial_claims", 6, "weekly"),
    ("payrolls", 40, "monthly"),
    ("retail_sales", 45, "monthly"),
)
SERIES_NAMES = [name for name, _, _ in SERIES_SPEC]
LEVELS = ["yield_2y", "yield_10y", "yield_30y", "fed_funds", "breakeven_10y", "real_yield_10y", "unemployment"]
RATES = ["yield_2y", "yield_10y", "yield_30y", "fed_funds", "breakeven_10y", "real_yield_10y"]
YIELDS = ["yield_2y", "yield_10y", "yield_30y"]
CURVES = {
    "curve_10y_2y_bp": ("yield_10y", "yield_2y"),
    "curve_30y_10y_bp": ("yield_30y", "yield_10y"),
    "policy_10y_ff_bp": ("yield_10y", "fed_funds"),
}
PERCENT_CHANGES = {"initial_claims": (21, 63), "payrolls": (63, 126), "retail_sales": (63, 126)}
MIN_CALENDAR_ROWS = 127


def series_spec(spark, spec=SERIES_SPEC) -> DataFrame:
    """The series dimension: one row per series, a literal list."""
    return spark.createDataFrame(list(spec), "series string, lag_days int, frequency string")


def availability_lag(observations: DataFrame, spec: DataFrame) -> DataFrame:
    """Date each observation becomes public. ``spec`` holds one row per series, so it is broadcast."""
    return observations.join(F.broadcast(spec), "series").select(
        F.date_add("obs_date", F.col("lag_days")).alias("available_date"), "series", "value"
    )


def outer_merge(macro: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Wide table by available date; the explicit list spares a distinct job."""
    names = series or SERIES_NAMES
    return macro.groupBy("available_date").pivot("series", names).agg(F.first("value", ignorenulls=True))


def asof_forward_fill(macro: DataFrame, calendar: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Latest value public on or before each calendar date, never filled backwards.

    Observations and calendar marks are stacked and the last value is carried
    along each series, so the as-of lookup sorts once and forms no pairs. A
    series holds at most one observation and one mark per date.
    """
    names = F.array(*[F.lit(n) for n in (series or SERIES_NAMES)])
    marks = calendar.select("date").distinct().select("date", F.explode(names).alias("series"))
    stacked = macro.select(F.col("available_date").alias("date"), "series", "value", F.lit(False).alias("mark")).unionByName(
        marks.withColumns({"value": F.lit(None).cast("double"), "mark": F.lit(True)})
    )
    span = Window.partitionBy("series").orderBy("date", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return (
        stacked.withColumn("value", F.last("value", ignorenulls=True).over(span)).filter("mark").select("date", "series", "value")
    )


def macro_features(
    macro: DataFrame, calendar: DataFrame, dates: DataFrame | None = None, min_rows: int = MIN_CALENDAR_ROWS
) -> DataFrame:
    """Levels, curve spreads, rate momentum and volatility, labour and demand trends per calendar date.

    ``calendar`` holds ``universe_id, date``; a lag counts rows of that calendar.
    Only dates with enough calendar history and every series public are kept.
    """
    filled = asof_forward_fill(macro, calendar)
    wide = filled.groupBy("date").pivot("series", SERIES_NAMES).agg(F.first("value"))
    order = Window.partitionBy("universe_id").orderBy("date")
    table = calendar.join(wide, "date").withColumn("rows_so_far", F.row_number().over(order))
    table = table.withColumns({f"{c}_step": F.col(c) - F.lag(c).over(order) for c in YIELDS})
    spread = {f"{c}_std_{n}": (sliding.MOMENTS, f"{c}_step", n) for c in YIELDS for n in (21, 63)}
    table = sliding.trailing(table, ["universe_id"], "date", spread)

    out = {f"{c}_level": F.col(c) for c in LEVELS}
    out |= {name: (F.col(a) - F.col(b)) * 100.0 for name, (a, b) in CURVES.items()}
    for c in RATES:
        for n in (21, 63):
            out[f"{c}_change_{n}d_bp"] = (F.col(c) - F.lag(c, n).over(order)) * 100.0
    for c in YIELDS:
        for n in (21, 63):
            out[f"{c}_change_std_{n}d_bp"] = F.col(f"{c}_std_{n}") * 100.0
    for n in (63, 126):
        out[f"unemployment_change_{n}d_pp"] = F.col("unemployment") - F.lag("unemployment", n).over(order)
    for c, spans in PERCENT_CHANGES.items():
        for n in spans:
            base = F.lag(c, n).over(order)
            out[f"{c}_change_{n}d_pct"] = F.when(F.abs(base) > 1e-8, F.col(c) / base - 1.0)
    features = table.withColumns(out)
    complete = F.lit(True)
    for c in SERIES_NAMES:
        complete = complete & F.col(c).isNotNull()
    features = features.filter((F.col("rows_so_far") >= min_rows) & complete).select("universe_id", "date", *out)
    if dates is not None:
        features = features.join(dates.select("universe_id", "date"), ["universe_id", "date"], "left_semi")
    return features


FEATURES = (
    [f"{c}_level" for c in LEVELS]
    + list(CURVES)
    + [f"{c}_change_{n}d_bp" for c in RATES for n in (21, 63)]
    + [f"{c}_change_std_{n}d_bp" for c in YIELDS for n in (21, 63)]
    + [f"unemployment_change_{n}d_pp" for n in (63, 126)]
    + [f"{c}_change_{n}d_pct" for c, spans in PERCENT_CHANGES.items() for n in spans]
)
