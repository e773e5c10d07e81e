"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Lengths are all that packing depends on, and there are at most ``capacity`` of
them, so the plan is made on counts per length, whose size does not grow with
the corpus, and documents are dealt to the planned places by their rank in their
length. A plan row is a pattern: lengths side by side and how often it is laid.

A pattern starts with the longest piece left, is filled greedily with the longest that
fits, and then its smallest piece gives way, while that narrows the gap, to the
two unpacked pieces that fit the widened gap most tightly.

Defined results: documents longer than the capacity are cut, the others never
are; a null or empty text is the end id alone; repeated rows are packed each.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import tokenizing
from tidemark.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are numbered by one task, about.
NUMBERED = 20_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, kept: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs(doc_id, text)``; ``kept``: see ``tokenizing.encoder``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    @tx.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizing.encoder(vocabulary, kept)
        for keys, texts in tx.rows(batches, "doc_id", "text"):
            out = []
            for key, text in zip(keys, texts, strict=True):
                ids = one.ids(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield tx.batch(schema, *zip(*out, strict=True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is laid; together they use up the counts."""
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}
        pattern: list[int] = []
        gap = capacity

        def take(length: int) -> None:
            nonlocal gap
            pattern.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length

        take(lengths[-1])
        at = len(lengths)
        while gap and (at := bisect.bisect_right(lengths, gap, hi=at)):
            length = lengths[at - 1]
            fit = min(left[length] - used.get(length, 0), gap // length)
            for _ in range(fit):
                take(length)
            if length <= gap or not fit:
                at -= 1
        while gap and len(pattern) > 1:
            small = min(pattern)
            pair = _tightest_pair(lengths, left, used, small, small + gap)
            if pair is None:
                break
            pattern.remove(small)
            used[small] -= 1
            gap += small
            for length in pair:
                take(length)
        times = min(left[length] // n for length, n in used.items() if n)
        out.append((sorted(pattern, reverse=True), times))
        for length, n in used.items():
            if n:
                left[length] -= n * times
                if not left[length]:
                    del left[length]
                    lengths.remove(length)
    return out


def _tightest_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces with the largest total above ``small`` and at most ``room``."""
    free = [x for x in lengths[: bisect.bisect_left(lengths, room)] if left[x] > used.get(x, 0)]
    if not free:
        return None
    a = np.array(free)
    at = np.searchsorted(a, room - a, side="right") - 1
    for i in range(len(a)):  # a length of which one is free makes no pair with itself
        if at[i] == i and left[free[i]] - used.get(free[i], 0) < 2:
            at[i] -= 1
    total = np.where(at >= 0, a + a[at], 0)
    best = int(total.argmax())
    return (free[best], free[at[best]]) if total[best] > small else None


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, kept: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs(doc_id, text)``."""
    return pack_pieces(cut_lineage(pieces(docs, vocabulary, capacity, kept=kept), "pieces"), capacity)


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """Give each row of a written table with a ``length`` of 1..capacity its sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in pattern:
            starts.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    places = {length: np.array(rows, dtype=np.int64) for length, rows in starts.items()}
    shared = cut.sparkSession.sparkContext.broadcast(places)

    buckets = sum(counts.values()) // NUMBERED + 1
    dealt = cut.withColumn("__bucket", F.pmod(F.xxhash64(*cut.columns), F.lit(buckets)))
    per = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy(*cut.columns)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(base, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__base"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        out = np.zeros((len(length), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for value in np.unique(lengths):
            rows = np.flatnonzero(lengths == value)
            table = shared.value[int(value)]
            at = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
            out[rows, 0] = table[at, 1] + ranks[rows] - table[at, 0]
            out[rows, 1] = table[at, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("__place", place("length", "__rank")).select(*cut.columns, "__place.sequence_id", "__place.offset")
