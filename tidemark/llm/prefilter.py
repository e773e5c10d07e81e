"""A fixed-size bit set of keys, to drop rows that cannot match before they are shuffled to a join.

Its size never grows with the keys: with very many it only filters less.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bits_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bit set of a long column; at most ``BITS / 64`` words reach the driver."""
    at = F.pmod(F.col(column), F.lit(BITS))
    words = keys.filter(F.col(column).isNotNull()).select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("bit"))
    out = np.zeros(BITS // 64, dtype=np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = np.int64(row["bits"]).astype(np.uint64)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.asarray(keys).astype(np.int64).view(np.uint64) & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def may_hold(docs: DataFrame, bits: np.ndarray, column: Column) -> DataFrame:
    """Rows whose (well mixed) long key may be in the set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, keys.to_numpy(dtype=np.int64)))

    return docs.filter(test(column))
