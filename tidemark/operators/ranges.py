"""Joins of days with ranges of days as equi-joins.

A range of days is the union of few aligned stretches of 1, 2, 4, ... days, at most two of each length, and a day lies in
exactly one aligned stretch of each length. Both sides are keyed by (length, number of the stretch), so a day meets a range
once, however many ranges overlap, and no pair that does not belong together is formed. Keys of a whole decade are few rows, so
long ranges do not multiply either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths 1, 2, ..., 2**(LEVELS - 1) days: the longest stretch is 89 years.
LEVELS = 16


def _stretches(low: Column, high: Column) -> Column:
    """Array of (level, number) whose stretches make up the days low..high - 1, days counted from 1970."""
    found = []
    for level in range(LEVELS):
        width = 1 << level
        a, b = F.ceil(low / width), F.floor(high / width)
        if level == LEVELS - 1:
            # What is left at the top is taken whole.
            every = F.when(a < b, F.transform(F.sequence(a, b - 1), lambda k: F.struct(F.lit(LEVELS - 1).alias("level"), k.alias("stretch"))))
            found.append(F.coalesce(every, F.array().cast("array<struct<level:int,stretch:bigint>>")))
            continue
        left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.struct(F.lit(level).alias("level"), a.alias("stretch")))
        right = F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.struct(F.lit(level).alias("level"), (b - 1).alias("stretch")))
        found.append(F.array_compact(F.array(left, right)))
    return F.flatten(F.array(*found))


def join_ranges(rows: DataFrame, day: str, ranges: DataFrame, start: str, stop: str, keys: list[str] | None = None) -> DataFrame:
    """Each row of ``rows`` with each row of ``ranges`` that has the same ``keys`` and whose inclusive range of days holds its day.

    Empty ranges (stop before start) and nulls meet nothing. Other columns must have different names.
    """
    low, high = F.unix_date(start).cast("long"), F.unix_date(stop).cast("long") + 1
    cut = ranges.filter(F.col(start) <= F.col(stop)).withColumn("__at", F.explode(_stretches(low, high)))
    at = F.unix_date(day).cast("long")
    own = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(at / (1 << i)).alias("stretch")) for i in range(LEVELS)])
    placed = rows.filter(F.col(day).isNotNull()).withColumn("__at", F.explode(own))
    return placed.join(cut, ["__at", *(keys or [])]).drop("__at")
