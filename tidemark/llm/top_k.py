"""Exact top-k inner products by columnar branch and bound.

Components become integers, floor(scale * x). Candidates are worked through in
blocks with one row per dimension. Scores grow dimension block by dimension
block, largest query mass first; what the rest can add is at most the product
of the remaining norms (Cauchy-Schwarz), and a candidate that cannot reach the
query's k-th score any more is dropped: the surviving (query, candidate) pairs
are compacted once few are left.

Queries are a stated set that meets all rows. They are sent to the tasks in
rounds of at most ``QUERIES`` vectors, whatever their number, each task keeps k
rows a query, and one window per query merges them.

Defined results: vectors that are null or hold a null or non-finite component
take no part; shorter vectors count as padded with zeros; ties go to the smaller
id; rows with the query's id are its own. Repeated query rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES = 4096
BLOCK = 2048
DIMENSIONS = 8
#: Share of surviving pairs from which on they are kept as a list.
FEW = 0.05


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part and their integer vectors."""
    if pa.types.is_large_list(vectors.type) or pa.types.is_list(vectors.type):
        valid = ~np.asarray(vectors.is_null())
        offsets = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        rows, out = [], []
        for i in np.flatnonzero(valid):
            v = values[offsets[i] : offsets[i + 1]]
            if np.isfinite(v).all():
                rows.append(i)
                out.append(np.floor(scale * v))
        return np.array(rows, dtype=np.int64), out
    raise TypeError(f"not a list of numbers: {vectors.type}")


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.q = self.ids = self.scores = np.zeros(0, dtype=np.int64)
        self.least = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        last = rank[keep] == self.k - 1
        self.least[self.q[last]] = self.scores[last]


def search(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Merge the candidates of one block (rows of ``vectors``) into ``best``."""
    n, width = vectors.shape
    exact = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * width < 2**52
    columns = np.ascontiguousarray(vectors.T) if exact else vectors.T.astype(np.int64)
    queries = queries if exact else queries.astype(np.int64)
    cuts = [*range(0, width, DIMENSIONS), width]
    left_q = np.sqrt([(queries[:, c:].astype(float) ** 2).sum(axis=1) for c in cuts])
    left_v = np.sqrt([(columns[c:].astype(float) ** 2).sum(axis=0) for c in cuts])
    total = np.zeros((len(queries), n), dtype=columns.dtype)
    q = at = None
    for step, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        slack = 1 + left_q[step] * 1e-9
        if q is None:
            total += queries[:, low:high] @ columns[low:high]
            alive = total + np.outer(left_q[step], left_v[step]) + slack[:, None] >= best.least[:, None]
            if alive.mean() < FEW or step == len(cuts) - 1:
                q, at = np.nonzero(alive)
                scores = total[q, at]
        else:
            for d in range(low, high):
                scores = scores + queries[q, d] * columns[d, at]
            alive = scores + left_q[step][q] * left_v[step][at] + slack[q] >= best.least[q]
            q, at, scores = q[alive], at[alive], scores[alive]
    if q is None:
        q, at = np.nonzero(np.ones_like(total, dtype=bool))
        scores = total[q, at]
    other = own[q] != ids[at]
    best.add(q[other], ids[at[other]], scores[other].astype(np.int64))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest integer inner product per query."""
    spark = candidates.sparkSession
    wanted = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    wanted = wanted.dropDuplicates(["id", "v"])
    rows = candidates.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rounds = max(1, -(-wanted.count() // QUERIES))
    dealt = wanted.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    found = None
    for i in range(rounds):
        group = dealt.filter(F.col("round") == i).select("id", "v").toArrow()
        at, vectors = integers(group.column("v").combine_chunks(), scale)
        ids = group.column("id").to_numpy()[at] if len(at) else np.zeros(0, dtype=np.int64)
        part = rows.mapInArrow(_searcher(spark.sparkContext.broadcast((ids, vectors)), k, scale), "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, scale: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = shared.value
        best = Best(len(own), k)
        for b in batches:
            rows, values = integers(b.column("v"), scale)
            if not len(rows) or not len(own):
                continue
            width = max(len(v) for v in (*vectors, *values))
            asked, ids = _matrix(vectors, width), b.column("id").to_numpy()[rows]
            for i in range(0, len(rows), BLOCK):
                search(asked, own, ids[i : i + BLOCK], _matrix(values[i : i + BLOCK], width), best)
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array(own[best.q]), pa.array(best.ids), pa.array(best.scores)], schema=schema)

    return run
