"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.session import cut_lineage

LOCAL_EDGES = 1 << 21


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forests(edges: DataFrame) -> DataFrame:
    """The same components with one edge per node, part by part."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @tx.lean
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= LOCAL_EDGES:
                held = [_star(held)]
                if len(held[0][0]) >= LOCAL_EDGES // 2:
                    yield tx.batch(schema, *held.pop())
        if held:
            yield tx.batch(schema, *_star(held))

    return edges.mapInArrow(shrink, "a long, b long")


def _star(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    nodes, root = local_components(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    moved = nodes != root
    return nodes[moved], root[moved]


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges(a, b)``.

    Each round points every node at its smallest neighbour and then at that
    node's own label, and contracts the graph; only the minimum per node is
    shuffled, so a node with very many edges is pre-aggregated. Loops are dropped.
    """
    edges = cut_lineage(_forests(edges.select("a", "b").filter("a <> b")).distinct(), "edges")
    labels = cut_lineage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "near")
        step = near.join(near.select(F.col("a").alias("m"), F.col("m").alias("mm")), "m", "left").select("a", F.coalesce("mm", "m").alias("m"))
        step = cut_lineage(step, "step")
        labels = cut_lineage(
            labels.join(step.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component")), "labels"
        )
        moved = edges.join(step, "a").select(F.col("m").alias("a"), "b").join(step.select(F.col("a").alias("b"), F.col("m").alias("n")), "b")
        edges = cut_lineage(_forests(moved.select("a", F.col("n").alias("b")).filter("a <> b")).distinct(), "edges")
    return labels
