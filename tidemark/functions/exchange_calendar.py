"""Sessions of the New York exchanges by rule, as column expressions on a date: weekdays that are no holiday and no special close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days without a session outside the yearly rules (state funerals, September 2001, hurricane of 2012).
SPECIAL_CLOSES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30",
    "2018-12-05", "2025-01-09",
)
# First years of holidays that came later.
KING_DAY_FROM, JUNETEENTH_FROM = 1998, 2022
#: No two sessions are further apart: four days of 2001 and a weekend.
LONGEST_GAP = 8


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year: the golden number and the century give the full moon, the weekday rule the Sunday."""
    golden, century, rest = year % 19, F.floor(year / 100), year % 100
    moon = (19 * golden + century - F.floor(century / 4) - F.floor((century - F.floor((century + 8) / 25) + 1) / 3) + 15) % 30
    shift = (32 + 2 * (century % 4) + 2 * F.floor(rest / 4) - moon - rest % 4) % 7
    late = F.floor((golden + 11 * moon + 22 * shift) / 451)
    day = moon + shift - 7 * late + 114
    return F.make_date(year.cast("int"), F.floor(day / 31).cast("int"), (day % 31 + 1).cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th such weekday (1 Sunday .. 7 Saturday) of a month; n = -1 is the last."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, ((weekday - F.dayofweek(first) + 7) % 7 + 7 * (n - 1)).cast("int"))
    last = F.last_day(first)
    return F.date_sub(last, ((F.dayofweek(last) - weekday + 7) % 7).cast("int"))


def observed(day: Column, saturday: bool = True) -> Column:
    """A holiday on Sunday is kept on Monday, one on Saturday on Friday (or not at all)."""
    kept = F.when(F.dayofweek(day) == 1, F.date_add(day, 1)).when(F.dayofweek(day) != 7, day)
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).otherwise(kept) if saturday else kept


def _fixed(year: Column, month: int, day: int) -> Column:
    return F.make_date(year.cast("int"), F.lit(month), F.lit(day))


def holidays(year: Column) -> dict[str, Column]:
    """Dates of a year without a session, by name; NULL where a holiday is not kept."""
    return {
        "new_year": observed(_fixed(year, 1, 1), saturday=False),
        "king": F.when(year >= KING_DAY_FROM, nth_weekday(year, 1, 2, 3)),
        "washington": nth_weekday(year, 2, 2, 3),
        "good_friday": F.date_sub(easter(year), 2),
        "memorial": nth_weekday(year, 5, 2, -1),
        "juneteenth": F.when(year >= JUNETEENTH_FROM, observed(_fixed(year, 6, 19))),
        "independence": observed(_fixed(year, 7, 4)),
        "labor": nth_weekday(year, 9, 2, 1),
        "thanksgiving": nth_weekday(year, 11, 5, 4),
        "christmas": observed(_fixed(year, 12, 25)),
    }


def is_session(day: Column) -> Column:
    """Whether the exchange opens on a date. Valid from 1994."""
    closed = F.array(*holidays(F.year(day)).values())
    special = F.date_format(day, "yyyy-MM-dd").isin(*SPECIAL_CLOSES)
    return ~F.dayofweek(day).isin(1, 7) & ~F.coalesce(F.array_contains(F.array_compact(closed), day), F.lit(False)) & ~special


def sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """session: every session from ``first`` through ``last``."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("session"))
    return days.filter(is_session(F.col("session")))


def next_session(day: Column) -> Column:
    """First session strictly after a date."""
    after = F.sequence(F.date_add(day, 1), F.date_add(day, LONGEST_GAP))
    return F.filter(after, is_session)[0]


def month_end_session(day: Column) -> Column:
    """Last session of the month of a date."""
    end = F.last_day(day)
    return F.element_at(F.filter(F.sequence(F.date_sub(end, LONGEST_GAP), end), is_session), -1)


def information_dates(dates: DataFrame, day: str) -> DataFrame:
    """``dates`` with is_session, month_end, effective_from and why a date cannot be one of information.

    Only the last session of a month can; what is decided on it takes effect at the next session.
    """
    end = month_end_session(F.col(day))
    problem = F.when(F.col(day).isNull(), "NO_DATE").when(~F.col("is_session"), "NO_SESSION").when(F.col(day) != F.col("month_end"), "NOT_MONTH_END")
    marked = dates.withColumns({"is_session": is_session(F.col(day)), "month_end": end, "effective_from": next_session(F.col(day))})
    return marked.withColumn("problem", problem)
