"""N-gram Jaccard self join of documents with signature trees, to connected components.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of word
shingles. The job:

1. ``shingle_sets``: size and 128-bit fingerprint of each document's set. Equal
   sets are one class from here on, however many copies there are.
2. ``candidate_edges``: a set is dealt by token hash into ``m`` parts, ``m`` by
   size class so that a linked pair differs in fewer parts than there are. It
   therefore shares a non-empty equal part, and equal parts meet in one shuffle
   by hash, pre-aggregated in each task. Parts of frequent shingles alone are left
   out where enough others remain, and sets with too many empty parts send the
   tokens of their prefix too. Nothing linked is missed, and unrelated texts with
   a common passage hardly ever meet.
3. Candidates that hang together form a block. Blocks are gathered into bins of
   bounded size; a block over the bound is split by size and hash, with some of
   its members, the pivots, in all its bins.
4. In each bin a signature tree is joined with itself (``signature_tree``), pairs
   verified on the whole sets. In split blocks the members outside the largest
   component then visit the other bins of compatible sizes.
5. Components of the links, and back to all copies.

Defined results: null, empty and blank texts have an empty set and link with
nothing. Rows with one doc_id and different texts are one node of the graph.
A null doc_id has a null component and links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import prefilter, signature_tree
from tidemark.llm import text as tx
from tidemark.llm.components import connected_components
from tidemark.session import cut_lineage

#: Shingles that a bin holds, about, 8 bytes each: small, as the pairs in a bin are compared by one task.
BIN_SHINGLES = 1 << 15
PIVOTS = 32
CLASS_RATIO = 1.3
#: Cells of the table of shingle counts, and how many of them are sent as one row.
CELLS, CELLS_IN_ROW = 1 << 20, 1 << 12
#: A cell is frequent above this multiple of the mean and so many more.
FREQUENT, FREQUENT_LEAST = 3, 32
#: Parts of sets that a mapping task gathers before it sends them on.
HELD_PARTS = 1 << 18
#: Shingles of a bucket, about, in which signatures meet, and the bytes that a signature keeps there and that name a set.
BUCKET, KEY_BYTES, NODE_BYTES = 1 << 20, 5, 6


def shingle_sets(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, f1, f2 per row of ``docs(doc_id, text)``, written: number of distinct shingles and fingerprint of the set.

    Also, from the same pass, a bit per cell of a fixed-size table of shingle
    counts: set where the cell counts well above the mean, because a shingle in
    it stands in very many documents.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("block", pa.int32()), ("cells", pa.binary())]
    )
    ddl = "doc_id long, n long, f1 long, f2 long, block int, cells binary"

    @tx.lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.other_work()
        cells = np.zeros(CELLS, dtype=np.int64)
        for ids, texts in tx.rows(batches, "doc_id", "text"):
            sets = [tx.shingle_set(t, size) for t in texts]
            f1, f2 = (np.array([_total(s, salt) for s in sets], dtype=np.uint64).view(np.int64) for salt in (1, 2))
            cells += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
            none = [None] * len(ids)
            yield tx.batch(schema, ids, [len(s) for s in sets], f1, f2, none, none)
        for k, part in enumerate(cells.reshape(-1, CELLS_IN_ROW)):
            if part.any():
                yield tx.batch(schema, [None], [None], [None], [None], [k], [part.astype("<i4").tobytes()])

    @tx.lean
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for blocks, parts in tx.rows(batches, "block", "cells"):
            for k, part in zip(blocks, parts, strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(part, dtype="<i4").astype(np.int64)
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()])], names=["block", "cells"])

    written = cut_lineage(_texts(docs).mapInArrow(measure, ddl), "sets")
    counts = np.zeros(CELLS, dtype=np.int64)
    sums = written.filter("block is not null").select("block", "cells").repartition("block").mapInArrow(add_up, "block int, cells binary")
    for row in sums.toLocalIterator():
        counts[row["block"] * CELLS_IN_ROW :][:CELLS_IN_ROW] = np.frombuffer(row["cells"], dtype=np.int64)
    return written.filter("block is null").select("doc_id", "n", "f1", "f2"), np.packbits(counts > FREQUENT * counts.mean() + FREQUENT_LEAST)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _total(s: np.ndarray, salt: int) -> np.uint64:
    return tx.mix(np.array([tx.mix(s, salt).sum(dtype=np.uint64)]) + np.uint64(len(s)), salt)[0]


@lru_cache(None)
def _classes(largest: int) -> np.ndarray:
    """Lower edges of the size classes."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * CLASS_RATIO)))
    return np.array(edges)


@lru_cache(None)
def _parts(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """Parts of a set in the class of sizes low..high-1, and how many of them may be empty.

    A linked pair whose smaller set is in the class differs in at most
    ``differ`` tokens, hence in as many parts.
    """
    differ = (den - num) * (high - 1) // num
    spare = differ // 8 + (1 if differ else 0)
    for _ in range(3):  # a few more parts than empty ones to expect
        parts = differ + 1 + spare
        empty = parts * np.exp(-low / parts)
        spare = min(differ // 2 + 1, int(np.ceil(empty + 2 * np.sqrt(empty)))) if differ else 0
    return differ + 1 + spare, spare


def _signatures(s: np.ndarray, num: int, den: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Hashes that a linked set is sure to share at least one of.

    A linked set has more equal parts than ``spare``. If no more than that are
    empty or hold frequent shingles only, those can be left out.
    """
    n = len(s)
    rare = np.ones(n, dtype=bool) if frequent is None else frequent[_cell(s)] == 0
    edges = _classes(1 << max(16, int(n).bit_length()))
    own = int(np.searchsorted(edges, n, side="right")) - 1
    partner = int(np.searchsorted(edges, -(-n * num // den), side="right")) - 1
    found = []
    for c in range(partner, own + 1):
        parts, spare = _parts(int(edges[c]), int(edges[c + 1]), num, den)
        part = (tx.mix(s, 3) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        sums = np.add.reduceat(tx.mix(s, 4)[order], cut)
        hashes = tx.mix(sums + tx.mix(part[cut].astype(np.uint64), 5), 6 + c)
        telling = np.logical_or.reduceat(rare[order], cut)
        found.append(hashes[telling] if parts - int(telling.sum()) <= spare else hashes)
        if parts - len(cut) > spare:
            prefix = n - -(-n * num // den) + 1
            found.append(tx.mix(s[:prefix], 1000))
    return np.concatenate(found)


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each value, as an array of bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _blobs(data: np.ndarray, width: int, cuts: np.ndarray) -> pa.Array:
    """One binary value from each cut to the next of values that are ``width`` bytes wide."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])


_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary()), ("runs", pa.binary()), ("others", pa.binary())])


def _packed(keys: np.ndarray, sets: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per bucket of each signature once with its first set, and one of edges to that for each further set of this task.

    A set stands once in a row, with the number of its signatures there; those lose the bits that the bucket has.
    """
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    fresh = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    leader = sets[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    more = ~fresh & (leader != sets)
    a, b = _different(leader[more], sets[more])
    keys, sets = keys[fresh], sets[fresh]
    bucket = ((keys >> np.uint64(8 * KEY_BYTES)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((sets, bucket))
    keys, sets, bucket = keys[order], sets[order], bucket[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (sets[1:] != sets[:-1]) | (bucket[1:] != bucket[:-1])
    run = np.flatnonzero(first)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    runs = np.append(np.searchsorted(run, cut), len(run))
    lengths = np.diff(run, append=len(keys)).astype("<u4").view(np.uint8)
    none = _blobs(np.zeros(0, dtype=np.uint8), 1, np.zeros(len(cut) + 1, dtype=np.int64))
    columns = [_blobs(_narrow(keys, KEY_BYTES), KEY_BYTES, np.append(cut, len(keys))), _blobs(_narrow(sets[run], NODE_BYTES), NODE_BYTES, runs), _blobs(lengths, 4, runs), none]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), *columns], schema=_PACKED)
    if len(a):
        yield tx.batch(_PACKED, [int(a[0] % np.uint64(buckets))], [b""], [_narrow(a, NODE_BYTES).tobytes()], [b""], [_narrow(b, NODE_BYTES).tobytes()])


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def node_of(f1: Column) -> Column:
    """The node that stands for a set in ``candidate_edges``: the lower bytes of its first fingerprint."""
    return f1.bitwiseAND(F.lit((1 << 8 * NODE_BYTES) - 1))


def candidate_edges(docs: DataFrame, size: int, num: int, den: int, frequent: np.ndarray, shingles: int = 0) -> DataFrame:
    """Distinct edges (a, b) between nodes (``node_of``); the sets of every linked pair hang together by them.

    Signatures travel packed, some thousand in a row, to buckets whose number grows with that of ``shingles``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET)

    @tx.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held = [], [], 0
        frequent_cells = np.unpackbits(shared.value)
        for (texts,) in tx.rows(batches, "text"):
            for text in texts:
                s = tx.shingle_set(text, size)
                if not len(s):
                    continue
                found = np.unique(_signatures(s, num, den, frequent_cells))
                keys.append(found)
                sets.append(np.full(len(found), _total(s, 1) & np.uint64((1 << 8 * NODE_BYTES) - 1), dtype=np.uint64))
                held += len(found)
                if held >= HELD_PARTS:
                    yield from _packed(np.concatenate(keys), np.concatenate(sets), buckets)
                    keys, sets, held = [], [], 0
        if held:
            yield from _packed(np.concatenate(keys), np.concatenate(sets), buckets)

    def met(keys: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        """Neighbours in the order of a bucket's signatures that have one and the same."""
        key, node = np.concatenate(keys), np.concatenate(sets)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
        return tx.batch(schema, *(x.view(np.int64) for x in _different(node[:-1][same], node[1:][same])))

    @tx.lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets = None, [], []
        for found, packed, nodes, runs, others in tx.rows(batches, *_PACKED.names, at_once=16):
            for bucket, k, s, r, o in zip(found, packed, nodes, runs, others, strict=True):
                if o:
                    yield tx.batch(schema, _wide(s, NODE_BYTES).view(np.int64), _wide(o, NODE_BYTES).view(np.int64))
                    continue
                if bucket != at and keys:
                    yield met(keys, sets)
                    keys, sets = [], []
                at = bucket
                keys.append(_wide(k, KEY_BYTES))
                sets.append(np.repeat(_wide(s, NODE_BYTES), np.frombuffer(r, dtype="<u4")))
        if keys:
            yield met(keys, sets)

    rows = _texts(docs).select("text").mapInArrow(deal, "bucket int, keys binary, sets binary, runs binary, others binary")
    # A signature stands at most once in what a task gathers: its part of a bucket is bounded by tasks, not by copies.
    edges = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _member_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """f1, n, block, shingles (sorted 64-bit hashes as bytes) of one document per class that has candidates."""
    schema = pa.schema([("f1", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("shingles", pa.binary())])

    @tx.lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f1, blocks, texts in tx.rows(batches, "f1", "block", "text"):
            sets = [tx.shingle_set(t, size) for t in texts]
            kept = [k for k, s in enumerate(sets) if int(_total(s, 1).view(np.int64)) == f1[k]]
            yield tx.batch(schema, *([v[k] for k in kept] for v in (f1, [len(s) for s in sets], blocks, [s.tobytes() for s in sets])))

    key = F.xxhash64("doc_id")
    near = prefilter.may_hold(_texts(docs), prefilter.bits_of(members.select(key.alias("key")), "key"), key)
    # Not broadcast: with a shuffle between them the filter and the reading do not take two workers for one task.
    rows = near.join(members.select("doc_id", "f1", "block").hint("merge"), "doc_id").select("f1", "block", "text")
    return rows.mapInArrow(read, "f1 long, n long, block long, shingles binary").dropDuplicates(["f1"])


def _tree_join(sets: DataFrame, bins: DataFrame, num: int, den: int) -> DataFrame:
    """New links (a, b) between first fingerprints in each bin; ``bins(f1, bin, known)``."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("f1")
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        f1 = pdf["f1"].to_numpy()
        found = list(signature_tree.links(sets, pdf["block"].to_numpy(), pdf["known"].to_numpy(), num, den))
        return pd.DataFrame({"a": f1[[i for i, _ in found]], "b": f1[[j for _, j in found]]}, dtype="int64")

    rows = sets.drop("n").join(bins, "f1")
    return rows.groupBy("bin").applyInPandas(join, "a long, b long")


def _class_links(docs: DataFrame, members: DataFrame, size: int, num: int, den: int, bound: int) -> DataFrame:
    """Links (a, b) between first fingerprints that hold every component together; ``members(doc_id, n, f1, block)``."""
    spark = docs.sparkSession
    sets = cut_lineage(_member_sets(docs, members, size), "member_sets")
    step = float(np.log(den / num))
    blocks = sets.groupBy("block").agg(F.sum("n").alias("total"))
    placed = cut_lineage(
        sets.select("f1", "n", "block").join(blocks, "block").withColumn("size_class", F.when(F.col("total") > bound, F.floor(F.log("n") / step)).otherwise(-1)).drop("total"),
        "placed",
    )
    parts = (
        placed.filter("size_class >= 0").groupBy("block", "size_class").agg(F.ceil(F.sum("n") / bound).alias("parts"), F.count(F.lit(1)).alias("held"), F.avg("n").alias("mean"))
        .withColumn("pivots", F.greatest(F.lit(2.0), F.least(F.lit(float(PIVOTS)), F.lit(bound / 2) / F.col("mean"))) / F.col("held"))
    )
    big = placed.join(parts, ["block", "size_class"]).withColumn("part", F.pmod(F.xxhash64("f1"), F.col("parts")))
    total = placed.agg(F.sum("n")).first()[0] or 0
    n_bins = max(int(4 * total // bound), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(0).cast("long")

    def at(block, size_class, part, other_class=none, other=none):
        return F.struct(*[F.coalesce(c.cast("long"), none).alias(n) for c, n in ((block, "block"), (size_class, "c"), (part, "p"), (other_class, "d"), (other, "q"))])

    small = placed.filter("size_class < 0").select("f1", at(F.pmod(F.xxhash64("block"), F.lit(n_bins)), F.lit(-1), none).alias("bin"))
    # A split block's pivots stand in all bins of their size class, so that a large group of near copies joins up at once.
    pivot = F.pmod(F.xxhash64("f1", F.lit(7)), F.lit(1 << 20)) < F.col("pivots") * (1 << 20)
    stands = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
    split = big.select("f1", "block", "size_class", F.explode(stands).alias("p")).select("f1", at(F.col("block"), F.col("size_class"), F.col("p")).alias("bin"))
    first = cut_lineage(_tree_join(sets, small.union(split).withColumn("known", F.col("f1")), num, den), "links")
    if parts.isEmpty():
        return first

    # What is not in the largest component of its split block meets the other bins of compatible sizes.
    joined = connected_components(first).withColumnRenamed("node", "f1")
    known = cut_lineage(
        big.select("f1", "n", "block", "size_class", "part").join(joined, "f1", "left").withColumn("known", F.coalesce("component", "f1")).drop("component"), "known"
    )
    counted = known.groupBy("block", "known").agg(F.count(F.lit(1)).alias("held"))
    largest = counted.groupBy("block").agg(F.max_by("known", F.struct("held", "known")).alias("largest"))
    rest = cut_lineage(known.join(largest, "block").filter("known <> largest").drop("largest"), "rest")
    if rest.isEmpty():
        return first
    rest_parts = rest.groupBy("block", F.col("size_class").alias("d")).agg(F.ceil(F.sum("n") / bound).alias("rest_parts"))
    rest = rest.join(rest_parts.withColumnRenamed("d", "size_class"), ["block", "size_class"]).withColumn("q", F.pmod(F.xxhash64("f1"), F.col("rest_parts"))).withColumnRenamed("size_class", "d")
    near = F.explode(F.array(*[F.col("d") + k for k in (-1, 0, 1)]))
    met = rest_parts.select("block", "d", "rest_parts", near.alias("size_class")).join(parts.select("block", "size_class", "parts"), ["block", "size_class"])
    hosts = known.join(met.drop("parts"), ["block", "size_class"]).select(
        "f1", "known", "block", "size_class", F.col("part").alias("p"), "d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1)).alias("q")
    )
    guests = rest.join(met.drop("rest_parts"), ["block", "d"]).select(
        "f1", "known", "block", met["size_class"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), "d", "q"
    )
    bins = hosts.unionByName(guests).select("f1", at(*[F.col(c) for c in ("block", "size_class", "p", "d", "q")]).alias("bin"), "known")
    return first.union(cut_lineage(_tree_join(sets, bins, num, den), "links"))


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, bound: int = BIN_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs(doc_id, text)``."""
    sets, frequent = shingle_sets(docs, size)
    filled = sets.filter("n > 0 and doc_id is not null")
    classes = cut_lineage(filled.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    blocks = connected_components(candidate_edges(docs, size, num, den, frequent, shingles)).withColumnRenamed("component", "block")
    members = cut_lineage(classes.select(F.col("rep").alias("doc_id"), "n", "f1", node_of(F.col("f1")).alias("node")).join(blocks, "node").drop("node"), "members")
    found = _class_links(docs, members, size, num, den, bound)
    reps = members.groupBy("f1").agg(F.min("doc_id").alias("doc_id"))
    linked = found.join(reps.select(F.col("f1").alias("a"), F.col("doc_id").alias("x")), "a").join(reps.select(F.col("f1").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    copies = filled.join(classes, ["n", "f1", "f2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    graph = linked.union(copies).select(F.col("x").alias("a"), F.col("y").alias("b"))
    components = connected_components(graph).withColumnRenamed("node", "doc_id")
    return (
        sets.join(components, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
