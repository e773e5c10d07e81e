"""Queries on macro series.

The provided events span thirty days, too few for windows of 126 rows, so an
hour of the event stream plays a calendar day and five event types split by
user parity play the ten series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import macro
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import harness, macro_files

_ORIGIN = "2000-01-01"


def observations(spark, sf):
    """obs_date, series, value: cents averaged per (hour, event type, user parity)."""
    events = harness.read(spark, sf, "events").select("ts", "user_id", "event_type", "value")
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("int")
    code = F.array_position(F.array(*[F.lit(t) for t in _TYPES]), F.col("event_type")) * 2 + F.col("user_id") % 2 - 1
    names = F.array(*[F.lit(n) for n in macro.SERIES_NAMES])
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        events.select(
            F.date_add(F.lit(_ORIGIN).cast("date"), hour).alias("obs_date"),
            F.element_at(names, code.cast("int")).alias("series"),
            cents.alias("cents"),
        )
        .groupBy("obs_date", "series")
        .agg((F.sum("cents").cast("double") / F.count(F.lit(1)) / 100.0).alias("value"))
    )


# The event types of the provided table.
_TYPES = ["click", "error", "purchase", "signup", "view"]

_OBS_SQL = f"""
names as (select {macro.SERIES_NAMES!r} as n, {_TYPES!r} as t),
observations as (
  select cast(date '{_ORIGIN}' + cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 3600) as integer) as date) as obs_date,
         n[cast(list_position(t, event_type) * 2 + user_id % 2 - 1 as integer)] as series,
         cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) / 100 as value
  from events, names group by all),
spec(series, lag_days) as (values {", ".join(f"('{s}', {lag})" for s, lag, _ in macro.SERIES_SPEC)}),
lagged as (select cast(obs_date + lag_days as date) as available_date, series, value from observations join spec using (series))"""


@register("availability_lag", f"with {_OBS_SQL} select available_date, series, {r('value', 8)} from lagged")
def availability_lag(spark, sf):
    lagged = macro.availability_lag(observations(spark, sf), macro.series_spec(spark))
    return rounded(lagged, 8, "value")


@register(
    "macro_outer_merge",
    f"""with {_OBS_SQL}
    select available_date, {", ".join(
        f"round(max(case when series = '{s}' then value end), 8) + 0.0::double as {s}" for s in macro.SERIES_NAMES)}
    from lagged group by available_date""",
)
def macro_outer_merge(spark, sf):
    lagged = macro.availability_lag(observations(spark, sf), macro.series_spec(spark))
    return rounded(macro.outer_merge(lagged), 8, *macro.SERIES_NAMES)


# Calendar: every observed hour-day, one universe.
_CALENDAR_SQL = "calendar as (select distinct 'ALL' as universe_id, obs_date as date from observations)"
_FILLED_SQL = """
filled as (
  select date, s.series, value
  from (select distinct date from calendar) c cross join (select series from spec) s
  asof left join lagged l on l.series = s.series and l.available_date <= c.date)"""


def _calendar(obs):
    return obs.select(F.lit("ALL").alias("universe_id"), F.col("obs_date").alias("date")).distinct()


@register(
    "asof_forward_fill",
    f"with {_OBS_SQL}, {_CALENDAR_SQL}, {_FILLED_SQL} select date, series, {r('value', 8)} from filled",
)
def asof_forward_fill(spark, sf):
    obs = cut_lineage(observations(spark, sf))
    lagged = macro.availability_lag(obs, macro.series_spec(spark))
    return rounded(macro.asof_forward_fill(lagged, _calendar(obs)), 8, "value")


def _features_sql() -> str:
    w = "over (partition by universe_id order by date)"
    exprs = {f"{c}_level": c for c in macro.LEVELS}
    exprs |= {n: f"({a} - {b}) * 100" for n, (a, b) in macro.CURVES.items()}
    for c in macro.RATES:
        for n in (21, 63):
            exprs[f"{c}_change_{n}d_bp"] = f"({c} - lag({c}, {n}) {w}) * 100"
    for c in macro.YIELDS:
        for n in (21, 63):
            exprs[f"{c}_change_std_{n}d_bp"] = (
                f"stddev_samp({c}_step) over (partition by universe_id order by date "
                f"rows between {n - 1} preceding and current row) * 100"
            )
    for n in (63, 126):
        exprs[f"unemployment_change_{n}d_pp"] = f"unemployment - lag(unemployment, {n}) {w}"
    for c, spans in macro.PERCENT_CHANGES.items():
        for n in spans:
            exprs[f"{c}_change_{n}d_pct"] = (
                f"case when abs(lag({c}, {n}) {w}) > 1e-8 then {c} / lag({c}, {n}) {w} - 1 end"
            )
    complete = " and ".join(f"{c} is not null" for c in macro.SERIES_NAMES)
    return f"""
wide as (
  select date, {", ".join(f"max(case when series = '{s}' then value end) as {s}" for s in macro.SERIES_NAMES)}
  from filled group by date),
stepped as (
  select *, row_number() {w} as rows_so_far, {", ".join(f"{c} - lag({c}) {w} as {c}_step" for c in macro.YIELDS)}
  from calendar join wide using (date)),
macro_features as (
  select * from (
    select universe_id, date, rows_so_far, {", ".join(macro.SERIES_NAMES)},
           {", ".join(f"{e} as {n}" for n, e in exprs.items())} from stepped)
  where rows_so_far >= {macro.MIN_CALENDAR_ROWS} and {complete})"""


@register(
    "macro_features",
    f"""with {_OBS_SQL}, {_CALENDAR_SQL}, {_FILLED_SQL}, {_features_sql()}
    select universe_id, date, {", ".join(r(c, 6) for c in macro.FEATURES)} from macro_features""",
)
def macro_features(spark, sf):
    obs = cut_lineage(observations(spark, sf))
    lagged = macro.availability_lag(obs, macro.series_spec(spark))
    return rounded(macro.macro_features(lagged, _calendar(obs)), 6, *macro.FEATURES)


@register(
    "macro_file_round_trip",
    f"""with {_OBS_SQL} select obs_date, series, {r("value", 8)} from observations""",
)
def macro_file_round_trip(spark, sf):
    """Every series written as date, value files with "." for missing and read back."""
    obs = cut_lineage(observations(spark, sf))
    days = obs.select("obs_date").distinct()
    parts = []
    for name in macro.SERIES_NAMES:
        path = scratch_path(spark, name)
        # Dates without an observation are written as "." and must be dropped by the scan.
        rows = days.join(obs.filter(F.col("series") == name), "obs_date", "left")
        text = F.coalesce(F.col("value").cast("string"), F.lit("."))
        rows.select(F.col("obs_date").alias("DATE"), text.alias("VALUE")).write.option("header", True).csv(path)
        parts.append(macro_files.scan_series(spark, path, name))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 8, "value")
