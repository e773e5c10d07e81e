"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles, common word runs that
overlap in neither text, cover at least ``coverage`` of the item's words, in
whatever order they stand, or if one tile has ``long_tile`` words, whatever its
share of the item. The job:

1. Seeds are the hashes of all runs of ``seed`` words of the items (of a whole
   item where it is shorter). A fixed-size bit set of them goes to the tasks.
2. One pass over the documents keeps, of each, the stretches of words whose runs
   may be seeds, as word hashes. Most documents leave nothing.
3. Seeds of documents and items meet in an equi-join; pairs that share too few
   seeds to reach the coverage or a long tile are dropped, which loses none that could.
4. Each remaining pair is tiled: runs of falling length are sought by running
   Karp-Rabin hashes among unmarked words, the longest are marked first, and a
   match that a longer one cut into is tried again with what is left.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text. Defined results: null and empty texts and items match nothing; items with
equal words are one, named by the smallest item_id; repeated documents are
judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import prefilter
from tidemark.llm import text as tx
from tidemark.session import cut_lineage

SEED = 5
COVERAGE = 0.6
#: Words of a verbatim quote that is too long to be chance.
LONG_TILE = 13
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def words(text: str | None) -> np.ndarray:
    return tx.word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), _BREAKS)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item place, document place, length) of tiles of at least ``least`` words, longest first."""
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    found = []
    size = max(least, min(len(item), len(doc)) // 2)
    while True:
        matches, longest = _matches(item, doc, free_i, free_d, size)
        if longest > 2 * size:
            size = longest
            continue
        while matches:
            n, i, d = max(matches, key=lambda m: (m[0], -m[1], -m[2]))
            matches.discard((n, i, d))
            open_words = free_i[i : i + n] & free_d[d : d + n]
            if open_words.all():
                free_i[i : i + n] = free_d[d : d + n] = False
                found.append((i, d, n))
                continue
            # What an earlier tile left of the match is tried again, if it is still long enough.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], open_words.astype(np.int8), [0]))))
            matches.update((int(b - a), i + int(a), d + int(a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= size)
        if size == least:
            return found
        size = max(least, size // 2)


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> tuple[set[tuple[int, int, int]], int]:
    """Maximal common runs of unmarked words of at least ``size``, and the longest length."""
    if min(len(item), len(doc)) < size:
        return set(), 0
    hi, hd = tx.ngram_hashes(item, size), tx.ngram_hashes(doc, size)
    hi_free, hd_free = (np.convolve(f, np.ones(size, dtype=int), "valid") == size for f in (free_i, free_d))
    wanted = np.flatnonzero(hd_free & np.isin(hd, hi[hi_free]))
    by_hash: dict[int, list[int]] = {}
    for i in np.flatnonzero(hi_free).tolist():
        by_hash.setdefault(int(hi[i]), []).append(i)
    out, seen = set(), set()
    for d in wanted.tolist():
        for i in by_hash.get(int(hd[d]), ()):
            # Runs on one diagonal are one match; only its first window extends it.
            if (i - 1, d - 1) in seen:
                seen.add((i, d))
                continue
            seen.add((i, d))
            n = size
            while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if (item[i : i + n] == doc[d : d + n]).all():
                out.add((n, i, d))
    return out, max((m[0] for m in out), default=0)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (hash of the words), item_id, words (64-bit hashes as bytes), n_words of each distinct item."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("words", pa.binary()), ("n_words", pa.int32())])

    @tx.lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tx.rows(batches, "item_id", "text"):
            found = [(k, words(t)) for k, t in zip(ids, texts, strict=True)]
            found = [(k, w) for k, w in found if len(w)]
            if found:
                keys = [int(tx.ngram_hashes(w, len(w)).view(np.int64)[0]) for _, w in found]
                yield tx.batch(schema, keys, [k for k, _ in found], [w.tobytes() for _, w in found], [len(w) for _, w in found])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    read_ = rows.mapInArrow(read, "item long, item_id long, words binary, n_words int")
    return read_.groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"), F.first("n_words").alias("n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, long_tile: int = LONG_TILE) -> DataFrame:
    """row, doc_id, item_id, coverage, n_tiles for each document and item that it holds enough of.

    ``row`` is a hash of doc_id and text. A document that holds several items has a row for each.
    """
    items = cut_lineage(_items(benchmark), "items")
    seed_schema = pa.schema([("seed", pa.int64()), ("item", pa.int64()), ("times", pa.int32()), ("n_words", pa.int32())])

    @tx.lean
    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, sizes in tx.rows(batches, "item", "words", "n_words"):
            for k, w, n in zip(keys, data, sizes, strict=True):
                found, times = np.unique(tx.ngram_hashes(np.frombuffer(w, dtype=np.uint64), min(seed, n)).view(np.int64), return_counts=True)
                yield tx.batch(seed_schema, found, [k] * len(found), times, [n] * len(found))

    seeds = cut_lineage(items.select("item", "words", "n_words").mapInArrow(sow, "seed long, item long, times int, n_words int"), "seeds")
    sizes = sorted({min(seed, r["n_words"]) for r in items.filter(F.col("n_words") <= seed).select("n_words").distinct().collect()} | {seed})
    shared = docs.sparkSession.sparkContext.broadcast(prefilter.bits_of(seeds, "seed"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("seeds", pa.list_(pa.int64())), ("words", pa.binary())])

    @tx.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, texts in tx.rows(batches, "row", "doc_id", "text"):
            out = []
            for row, key, text in zip(rows, ids, texts, strict=True):
                w = words(text)
                cover, hits = np.zeros(len(w) + 1, dtype=np.int64), []
                for size in sizes:
                    grams = tx.ngram_hashes(w, size)
                    at = np.flatnonzero(prefilter.held(shared.value, grams.view(np.int64)))
                    hits.append(grams[at].view(np.int64))
                    cover[at] += 1
                    np.subtract.at(cover, at + size, 1)
                hits = np.unique(np.concatenate(hits))
                if len(hits):
                    kept = np.cumsum(cover[:-1]) > 0
                    # Stretches are set apart by a word that occurs nowhere.
                    last = np.flatnonzero(kept & ~np.append(kept[1:], False))
                    parts = np.insert(w[kept], np.searchsorted(np.flatnonzero(kept), last) + 1, np.arange(1, len(last) + 1, dtype=np.uint64))
                    out.append((row, key, hits.tolist(), parts.tobytes()))
            if out:
                yield tx.batch(schema, *zip(*out, strict=True))

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", F.coalesce(text, F.lit(""))).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    stretches = cut_lineage(rows.mapInArrow(scan, "row long, doc_id long, seeds array<bigint>, words binary"), "stretches").dropDuplicates(["row"])
    met = stretches.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    # A tile of n words holds n - seed + 1 seeds, so at most ``seed`` words are covered for each shared one.
    enough = (F.col("shared") * seed >= F.col("n") * coverage) | (F.col("shared") >= long_tile - seed + 1)
    pairs = met.groupBy("row", "item").agg(F.sum("times").alias("shared"), F.first("n_words").alias("n")).filter(enough)
    joined = pairs.select("row", "item").join(stretches.select("row", "doc_id", F.col("words").alias("doc_words")), "row").join(items, "item")
    tiled_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])

    @tx.lean
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, item_ids, theirs, ours in tx.rows(batches, "row", "doc_id", "item_id", "words", "doc_words"):
            out = []
            for row, key, item_id, a, b in zip(keys, ids, item_ids, theirs, ours, strict=True):
                item, doc = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                found = tiles(item, doc, min(seed, len(item)))
                covered = sum(n for _, _, n in found) / len(item)
                if covered >= coverage or any(n >= long_tile for _, _, n in found):
                    out.append((row, key, item_id, covered, len(found)))
            if out:
                yield tx.batch(tiled_schema, *zip(*out, strict=True))

    columns = joined.select("row", "doc_id", "item_id", "words", "doc_words")
    return columns.mapInArrow(tile, "row long, doc_id long, item_id long, coverage double, n_tiles long")


def row_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``__row`` that ``contaminated`` names them by."""
    return docs.withColumn("__row", F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))


def report(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, long_tile: int = LONG_TILE) -> DataFrame:
    """doc_id, n_items, item_id (the one with the largest coverage, then the smallest id), coverage, n_tiles of each contaminated document."""
    found = contaminated(docs, benchmark, seed, coverage, long_tile)
    best = F.min(F.struct((-F.col("coverage")).alias("less"), "item_id", "coverage", "n_tiles")).alias("best")
    return found.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n_items"), best).select("doc_id", "n_items", "best.item_id", "best.coverage", "best.n_tiles")
