"""Issue rows for groups that have no defined result.

Operators divide with NULL for a zero denominator, so one degenerate group does
not stop the others; these tables say which groups and why.
Columns: ``universe_id, subject, issue, rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(table: DataFrame, subject: Column, issue: str, broken: Column) -> DataFrame:
    counted = table.groupBy("universe_id", subject.cast("string").alias("subject")).agg(F.count_if(broken).alias("rows"))
    return counted.filter("rows > 0").select("universe_id", "subject", F.lit(issue).alias("issue"), "rows")


def price_issues(prices: DataFrame) -> DataFrame:
    """Closes that are zero or negative: their next return is NULL or has no meaning."""
    return _found(prices, F.col("asset"), "CLOSE_NOT_POSITIVE", F.col("close") <= 0)


def return_issues(returns: DataFrame) -> DataFrame:
    """Assets without risk, or with one return: neither has an inverse variance, a correlation or a sample covariance."""
    moments = returns.groupBy("universe_id", F.col("asset").alias("subject")).agg(F.count("ret").alias("rows"), F.var_pop("ret").alias("variance"))
    issue = F.when(F.col("rows") < 2, "SINGLE_RETURN").when(F.col("variance") == 0, "FLAT_ASSET")
    return moments.select("universe_id", "subject", issue.alias("issue"), "rows").filter("issue is not null")


def weight_issues(weights: DataFrame, group: str = "portfolio_id") -> DataFrame:
    """Portfolios whose weights add up to zero: they cannot be normalised."""
    totals = weights.groupBy("universe_id", F.col(group).cast("string").alias("subject")).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("rows"))
    return totals.filter("total = 0 or total is null").select("universe_id", "subject", F.lit("ZERO_WEIGHT_TOTAL").alias("issue"), "rows")
