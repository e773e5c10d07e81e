"""Ranked lexical search: the best ``k`` documents for each item, scored in whole numbers.

Terms are maximal stretches of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. With N documents that have a term, L terms in all of them together, n terms in a
document and df documents with a term, a term weighs floor(1000 ln((2N+2)/(2df+1))), and an item's
score is the sum over its different terms of weight * (10^9 tf div (1000 tf + 8 m)) with
m = 10 + (90 n N div L). The job:

1. The items' terms are the vocabulary of a round. One pass over the texts writes, per
   document, n and the vocabulary terms in it with their counts; N, L and df are sums
   over that table.
2. A second pass takes documents in blocks. The part of a score that does not depend
   on the item is computed once per posting. For an item, the bitmaps of its terms are turned into a
   mask of matched terms per document, documents are grouped by mask, and
   masks are evaluated by descending maximum score until that falls below
   the item's tenth score so far in the task. Documents without a matched term are never looked at.
3. Each task gives at most k documents an item, which are ranked in two steps.

Items go to the tasks in rounds of at most ``ROUND_TERMS`` terms (or one item with more), each with its own two passes,
so nothing that is broadcast or sent to the driver grows with either table.

Defined results: a null or empty text has no terms; rows of one item id (null included) are one item
with the terms of all; every document row is ranked, repeated ones each; equal scores go by
ascending doc_id, nulls last; documents with score 0 are left out, as are items without any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.session import cut_lineage

#: Terms of the items of a round, repeats counted.
ROUND_TERMS = 1 << 18
#: Documents of a block, and different terms of the items whose scores are laid out together: 32 MB.
BLOCK, GROUP_TERMS = 2048, 4096
#: Documents that an item scores at once.
SCORED = 64

_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(data: bytes | None) -> list[bytes]:
    """The terms of a text in order."""
    return data.translate(_TERM_BYTES).split() if data else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _bytes(column: str):
    return F.col(column).cast("string").cast("binary")


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (different ones) of ``items(item_id, text)``."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in tx.rows(batches, "item_id", "text"):
            yield tx.batch(schema, keys, [sorted(set(terms(t))) for t in texts])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), _bytes("text").alias("text"))
    found = rows.mapInArrow(cut, "item_id long, terms array<binary>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def _rounds(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The items with a number of their round, and how many rounds there are."""
    sized = items.withColumn("__hash", F.xxhash64("item_id", F.lit(7))).withColumn("__size", F.size("terms"))
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    rounds = max(1, -(-int(total) // most))
    while rounds > 1 and rounds < rows:
        per = sized.groupBy(F.pmod("__hash", F.lit(rounds))).agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n"))
        if per.filter(f"s > {most} and n > 1").isEmpty():
            break
        rounds *= 2
    return sized.withColumn("__round", F.pmod("__hash", F.lit(rounds))).drop("__hash", "__size"), rounds


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms (numbers of the vocabulary) and times of each row of ``docs(doc_id, text)`` that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    numbers, counts = pa.list_(pa.int32()), pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for keys, texts in tx.rows(batches, "doc_id", "text", at_once=500):
            n, ends, held, times, kept = [], [0], [], [], []
            for key, text in zip(keys, texts, strict=True):
                words = terms(text)
                if not words:
                    continue
                found = np.array([v for v in map(number, words) if v is not None], dtype=np.int32)
                which, often = np.unique(found, return_counts=True)
                kept.append(key)
                n.append(len(words))
                held.append(which)
                times.append(often)
                ends.append(ends[-1] + len(which))
            if kept:
                offsets = pa.array(ends, type=pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (held, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, type=pa.int64()), pa.array(n, type=pa.int64()), *lists], schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", numbers), ("times", counts)])
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes("text").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


def grouped_by_mask(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different masks of matched terms (rows of booleans), the documents with a match ordered by mask, and where each mask's documents begin.

    ``present`` has a row per term and a column per document; a mask is kept as a bitmap in 64-bit words.
    """
    some = np.flatnonzero(present.any(axis=0))
    packed = np.packbits(present[:, some], axis=0)
    words = np.zeros((len(some), -(-len(packed) // 8) * 8), dtype=np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0])
    in_order = words[order]
    begin = np.flatnonzero(np.append(True, (in_order[1:] != in_order[:-1]).any(axis=1))) if len(some) else np.zeros(0, dtype=np.int64)
    some = some[order]
    return present[:, some[begin]].T, some, np.append(begin, len(some))


class Best:
    """The best ``k`` (score, document) of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def needed(self) -> int:
        """The score under which a document cannot be among the best."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, keys: list[int | None]) -> None:
        fresh = [(-s, d is None, d or 0, d) for s, d in zip(scores.tolist(), keys, strict=True)]
        self.rows = sorted(self.rows + fresh)[: self.k] if fresh else self.rows


def evaluate(impact: np.ndarray, weights: np.ndarray, most: np.ndarray, keys: np.ndarray, best: Best) -> int:
    """Rank a block's documents for one item, masks by descending maximum score; gives the number of documents scored.

    ``impact``: a row per term of the item and a column per document; ``most``: the largest value of each row.
    """
    masks, docs, begin = grouped_by_mask(impact > 0)
    bound = masks @ (weights * most)
    by = np.argsort(-bound, kind="stable")
    sizes = np.diff(begin)[by]
    ends = np.cumsum(sizes)
    done = scored = 0
    while done < len(by) and bound[by[done]] >= best.needed:
        # As many masks as make a handful of documents, and none that is out of reach by now.
        stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SCORED)) + 1
        stop = min(stop, done + int(np.searchsorted(-bound[by[done:]], -best.needed, side="right")))
        chosen = np.concatenate([docs[begin[m] : begin[m + 1]] for m in by[done:stop].tolist()])
        scores = weights @ impact[:, chosen].astype(np.int64)
        good = scores >= best.needed
        best.add(scores[good], [keys[d] for d in chosen[good].tolist()])
        scored += len(chosen)
        done = stop
    return scored


def _groups(items: list[tuple[int | None, np.ndarray]]) -> list[list[int]]:
    """Items whose different terms together fit the layout of a block; an item with more stands alone."""
    groups: list[list[int]] = []
    held: set[int] = set()
    for at, (_, numbers) in enumerate(items):
        mine = set(numbers.tolist())
        if not groups or len(held | mine) > GROUP_TERMS:
            groups.append([])
            held = set()
        held |= mine
        groups[-1].append(at)
    return groups


def _ranked(found: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """item, score, doc_id, task: at most ``k`` documents of each item from each task."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights, _groups(items)))
    schema = pa.schema([("item_id", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64()), ("task", pa.int32())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, worth, groups = shared.value
        best = [Best(k) for _ in asked]
        local = np.full(len(worth), -1, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                keys = part.column(0).to_pylist()
                m = 10 + (90 * part.column(1).to_numpy() * documents) // words
                numbers, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(keys)), np.diff(part.column(2).offsets.to_numpy()))
                value = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
                for group in groups:
                    wanted = np.unique(np.concatenate([asked[i][1] for i in group]))
                    local[wanted] = np.arange(len(wanted))
                    row = local[numbers]
                    here = row >= 0
                    impact = np.zeros((len(wanted), len(keys)), dtype=np.int32)
                    impact[row[here], doc[here]] = value[here]
                    most = impact.max(axis=1, initial=0).astype(np.int64)
                    for i in group:
                        rows = local[asked[i][1]]
                        rows = rows[most[rows] > 0]
                        if len(rows):
                            evaluate(impact[rows], worth[wanted[rows]], most[rows], keys, best[i])
                    local[wanted] = -1
        task = TaskContext.get().partitionId()
        out = [(asked[i][0], -r[0], r[3], task) for i, b in enumerate(best) for r in b.rows]
        if out:
            yield tx.batch(schema, *zip(*out, strict=True))

    return found.mapInArrow(rank, "item_id long, score long, doc_id long, task int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, round_terms: int = ROUND_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best rows of ``docs(doc_id, text)`` for each item of ``items(item_id, text)``."""
    asked, rounds = _rounds(cut_lineage(_item_terms(items), "items"), round_terms)
    parts = []
    for r in range(rounds):
        mine = [(row["item_id"], row["terms"]) for row in asked.filter(F.col("__round") == r).toLocalIterator()]
        vocabulary: dict[bytes, int] = {}
        numbered = [(key, np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in words], dtype=np.int64)) for key, words in mine]
        numbered = [x for x in numbered if len(x[1])]
        found = cut_lineage(postings(docs, vocabulary), "postings")
        documents, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for row in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            weights[row["term"]] = weight(documents, row["df"])
        parts.append(cut_lineage(_ranked(found.filter(F.size("terms") > 0), numbered, weights, documents, max(1, words), k), "best"))
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    first = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    few = best.withColumn("__n", F.row_number().over(Window.partitionBy("item_id", F.floor(F.col("task") / 256)).orderBy(*first))).filter(f"__n <= {k}")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*first))).filter(f"rank <= {k}")
    return ranked.select("item_id", "rank", "doc_id", "score")
