"""Windows over the last L rows of a series at a cost that does not grow with L.

Rows of a series are numbered and cut into blocks of L. Each row has a running value from the start of its block
and one to its end; the L rows up to a row are the end of one block and the start of the next, so their value is the
combination of two of those. Both are running windows, which Spark updates row by row, while a sliding
frame is folded anew for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRODUCT, MAXIMUM, MOMENTS = "product", "maximum", "moments"


def _parts(kind: str, value: Column) -> dict[str, Column]:
    """Aggregates whose values over two neighbouring stretches give that of both."""
    if kind == PRODUCT:
        return {"v": F.product(value)}
    if kind == MAXIMUM:
        return {"v": F.max(value)}
    return {"n": F.count(value), "mean": F.avg(value), "var": F.var_pop(value)}


def _joined(kind: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The product, the maximum, or the sample standard deviation of two stretches."""
    if kind == PRODUCT:
        return F.coalesce(a["v"] * b["v"], a["v"], b["v"])
    if kind == MAXIMUM:
        return F.greatest(a["v"], b["v"])
    n = a["n"] + b["n"]
    gap = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    m2 = F.coalesce(a["var"] * a["n"], F.lit(0.0)) + F.coalesce(b["var"] * b["n"], F.lit(0.0)) + gap * gap * a["n"] * b["n"] / n
    return F.when(n > 1, F.sqrt(m2 / (n - 1)))


def _alone(kind: str, a: dict[str, Column]) -> Column:
    return F.when(a["n"] > 1, F.sqrt(a["var"] * a["n"] / (a["n"] - 1))) if kind == MOMENTS else a["v"]


def trailing(rows: DataFrame, series: list[str], order: str, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``rows`` with a column for each of ``wanted`` (name: kind, column, length) over the last ``length`` rows, NULL while there are fewer.

    PRODUCT and MAXIMUM leave out nulls, MOMENTS gives the sample standard deviation of the values that are there.
    """
    kept = rows.columns
    line = Window.partitionBy(*series).orderBy(order)
    out = rows.withColumn("__no", F.row_number().over(line))
    for length in sorted({n for _, _, n in wanted.values()}):
        block = f"__block{length}"
        out = out.withColumn(block, F.floor((F.col("__no") - 1) / length))
        mine = {(k, c): _parts(k, F.col(c)) for k, c, n in wanted.values() if n == length}
        for way, by in (("from", F.col("__no")), ("to", F.col("__no").desc())):
            span = Window.partitionBy(*series, block).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumns({f"__{way}_{k}_{c}_{length}_{p}": v.over(span) for (k, c), parts in mine.items() for p, v in parts.items()})
    before, values = {}, {}
    for name, (kind, column, length) in wanted.items():
        parts = _parts(kind, F.col(column))
        here = {p: F.col(f"__from_{kind}_{column}_{length}_{p}") for p in parts}
        for p in parts:
            before[f"__lag_{kind}_{column}_{length}_{p}"] = F.lag(f"__to_{kind}_{column}_{length}_{p}", length - 1).over(line)
        there = {p: F.col(f"__lag_{kind}_{column}_{length}_{p}") for p in parts}
        whole_block = F.col("__no") % length == 0
        value = F.when(whole_block, _alone(kind, here)).otherwise(_joined(kind, there, here))
        values[name] = F.when(F.col("__no") >= length, value)
    return out.withColumns(before).select(*kept, *[v.alias(n) for n, v in values.items()])
