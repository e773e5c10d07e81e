"""Hash tree of a table: digests of key ranges, of their parents, and of the whole, to compare versions from the root down.

``levels`` names expressions from coarse to fine that cut the keys into ranges (a year, its months, their days). A node's
sums are those of the hashes of its rows, so a parent is the sum of its children, an append changes one path per
range it touches, and the root is the table's fingerprint. Two versions that agree in a node are not looked at below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import SEGMENT_DIGITS, SEGMENTS, record_hash
from tidemark.session import cut_lineage

_SUMS = [f"s{i}" for i in range(SEGMENTS)]


def _path(levels: dict[str, Column]) -> list[Column]:
    return [value.cast("string").alias(name) for name, value in levels.items()]


def _nodes(leaves: DataFrame, names: list[str]) -> DataFrame:
    """level, names..., rows, sums of every node; names finer than a node's level are NULL."""
    rolled = leaves.rollup(*names).agg(F.grouping_id().alias("id"), F.sum("rows").alias("rows"), *[F.sum(s).alias(s) for s in _SUMS])
    depth = {(1 << (len(names) - level)) - 1: level for level in range(len(names) + 1)}
    level = reduce(lambda c, k: c.when(F.col("id") == k, depth[k]), list(depth)[1:], F.when(F.col("id") == list(depth)[0], depth[list(depth)[0]]))
    return rolled.select(level.cast("int").alias("level"), *names, "rows", *_SUMS)


def leaves(table: DataFrame, columns: list[str], levels: dict[str, Column]) -> DataFrame:
    """names..., rows, sums of the finest ranges of ``table``."""
    hashed = table.select(*_path(levels), record_hash(columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + i * SEGMENT_DIGITS, SEGMENT_DIGITS), 16, 10).cast("decimal(38,0)")).alias(s) for i, s in enumerate(_SUMS)]
    return hashed.groupBy(*levels).agg(F.count(F.lit(1)).alias("rows"), *parts)


def build(table: DataFrame, columns: list[str], levels: dict[str, Column]) -> DataFrame:
    """level (0 is the root), the names of ``levels``, rows, sums and digest of every node."""
    return _digested(_nodes(leaves(table, columns, levels), list(levels)))


def _digested(nodes: DataFrame) -> DataFrame:
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(s).cast("string") for s in _SUMS])
    return nodes.withColumn("digest", F.sha2(text, 256))


def appended(tree: DataFrame, batch: DataFrame, columns: list[str], levels: dict[str, Column]) -> DataFrame:
    """The tree with a batch of new rows: only the paths that the batch touches change, and the table is not read."""
    more = _nodes(leaves(batch, columns, levels), list(levels)).withColumn("digest", F.lit(None).cast("string"))
    both = tree.withColumn("fresh", F.lit(0)).unionByName(more.withColumn("fresh", F.lit(1)))
    sums = both.groupBy("level", *levels).agg(F.sum("rows").alias("rows"), *[F.sum(s).alias(s) for s in _SUMS])
    return _digested(sums)


def _same_node(names: list[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in names], F.lit(True))


def changed(before: DataFrame, after: DataFrame, levels: list[str]) -> DataFrame:
    """level, names..., change (ADDED, REMOVED, CHANGED), rows_before, rows_after of every node that differs, level by level below nodes that do."""
    open_, found = None, []
    for depth in range(len(levels) + 1):
        names = levels[:depth]
        x, y = (t.filter(F.col("level") == depth).select(*names, "rows", "digest") for t in (before, after))
        if open_ is not None:
            x, y = (t.alias("t").join(open_.alias("o"), reduce(lambda p, q: p & q, [F.col(f"t.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names[:-1]], F.lit(True)), "left_semi") for t in (x, y))
        met = x.withColumn("__x", F.lit(1)).alias("x").join(y.withColumn("__y", F.lit(1)).alias("y"), _same_node(names), "full")
        change = F.when(F.col("x.__x").isNull(), "ADDED").when(F.col("y.__y").isNull(), "REMOVED").when(F.col("x.digest") != F.col("y.digest"), "CHANGED")
        differing = met.select(
            *[F.coalesce(f"x.{n}", f"y.{n}").alias(n) for n in names], change.alias("change"), F.col("x.rows").alias("rows_before"), F.col("y.rows").alias("rows_after")
        ).filter("change is not null")
        differing = cut_lineage(differing, "differing")
        found.append(differing.select(F.lit(depth).alias("level"), *[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in levels], "change", "rows_before", "rows_after"))
        if depth == len(levels) or differing.isEmpty():
            break
        open_ = differing.select(*names)
    return reduce(DataFrame.unionByName, found)


def changed_rows(
    before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], levels: dict[str, Column], differing: DataFrame
) -> DataFrame:
    """keys..., change of each row in the finest ranges that differ; other ranges are not read past their keys."""
    leaf = differing.filter(F.col("level") == len(levels)).select(*levels)
    fields = [c for c in columns if c not in keys]

    def inside(table: DataFrame) -> DataFrame:
        placed = table.select(*keys, record_hash([*keys, *fields]).alias("__h"), *_path(levels))
        on = reduce(lambda p, q: p & q, [F.col(f"t.{n}").eqNullSafe(F.col(f"l.{n}")) for n in levels])
        kept = placed.alias("t").join(leaf.alias("l"), on, "left_semi")
        return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias("__h"))

    x, y = inside(before).alias("x"), inside(after).alias("y")
    on = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    change = F.when(F.col("x.__h").isNull(), "ADDED").when(F.col("y.__h").isNull(), "REMOVED").when(F.col("x.__h") != F.col("y.__h"), "CHANGED")
    return x.join(y, on, "full").select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], change.alias("change")).filter("change is not null")
