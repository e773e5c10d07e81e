"""Record hashes and order-free table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS, SEGMENT_DIGITS = 2, 15


def record_hash(columns: list[str]) -> Column:
    """SHA-256 of the named fields as JSON in the given order; NULLs are written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(table: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """One digest per group that does not depend on row order.

    Row hashes are cut into numeric segments and summed, so the digest is an
    ordinary aggregate with map-side combining; no group is sorted or listed.
    Equal multisets of rows give equal digests, and a changed, lost or repeated
    row changes it.
    """
    hashed = table.select(*(keys or []), record_hash(columns).alias("h"))
    parts = [
        F.sum(F.conv(F.substring("h", 1 + i * SEGMENT_DIGITS, SEGMENT_DIGITS), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
        for i in range(SEGMENTS)
    ]
    sums = hashed.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("rows"), *parts)
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(SEGMENTS)])
    return sums.select(*(keys or []), "rows", F.sha2(text, 256).alias("fingerprint"))
