"""Calendar expressions: decision months, month distance, month-ends and signal ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First month of each quarter.
DECISION_MONTHS = (1, 4, 7, 10)
MAX_SIGNAL_AGE_MONTHS = 2


def month_distance(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def is_decision_month(day: Column) -> Column:
    return F.month(day).isin(*DECISION_MONTHS)


def business_month_end(day: Column) -> Column:
    """Last weekday of the month of ``day``."""
    end = F.last_day(day)
    back = F.when(F.dayofweek(end) == 7, 1).when(F.dayofweek(end) == 1, 2).otherwise(0)
    return F.date_sub(end, back)


def last_completed_month_end(as_of: Column) -> Column:
    """Latest business month-end on or before ``as_of``; a partial month falls back to the one before."""
    this_month = business_month_end(as_of)
    return F.when(this_month <= as_of, this_month).otherwise(business_month_end(F.add_months(as_of, -1)))


def session_calendar(sessions: DataFrame) -> DataFrame:
    """Last session of each month and the first session after it, from a ``universe_id, session`` dimension."""
    following = F.lead("session").over(Window.partitionBy("universe_id").orderBy("session"))
    return (
        sessions.withColumn("next_session", following)
        .groupBy("universe_id", F.trunc("session", "month").alias("month"))
        .agg(
            F.max("session").alias("last_session"),
            F.max_by("next_session", "session").alias("effective_session"),
        )
    )


def active_signal(signals: DataFrame, information: DataFrame, frozen_through: str) -> DataFrame:
    """The signal in force at each information date of a version, with the reason when none may be used.

    The as-of lookup is a union of signals and questions sorted by date within
    a version, carrying the last signal forward; no pairs are formed. A version
    has one signal per quarter and one question per date.
    """
    span = Window.partitionBy("version").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = signals.select(
        "version", F.col("signal_date").alias("at"), F.lit(0).alias("kind"), F.struct("signal_date", "state").alias("s")
    )
    asks = information.select(
        "version", F.col("information_date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["s"].dataType).alias("s")
    )
    found = (
        marks.unionByName(asks)
        .withColumn("found", F.last("s", ignorenulls=True).over(span))
        .filter("kind = 1")
        .select("version", F.col("at").alias("information_date"), "found.signal_date", "found.state")
    )
    age = month_distance(F.col("signal_date"), F.col("information_date"))
    status = (
        F.when(F.col("signal_date").isNull(), "NO_SIGNAL")
        .when(F.col("signal_date") <= F.to_date(F.lit(frozen_through)), "IN_SAMPLE")
        .when(is_decision_month(F.col("information_date")) & (age != 0), "DECISION_MONTH_WITHOUT_SIGNAL")
        .when(~age.between(0, MAX_SIGNAL_AGE_MONTHS), "STALE")
        .otherwise("ACTIVE")
    )
    return found.withColumn("age_months", age).withColumn("status", status)
