"""Periodic runs of words, as in looped or stuttering text, and texts with each run cut to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) that is at least two periods and ``min_length`` words long and that no
neighbouring word extends keeping period q. They are found per text by descending LCP:

1. Suffixes of the word sequence are sorted by prefix doubling, those alone that
   share enough words with another one to be in a run, and the common prefix
   (LCP) of neighbours in that order is read off the doubling ranks.
2. Kruskal's algorithm takes the neighbours by descending LCP and unites their
   classes; a union-find root holds the ordered positions of its class, and the
   smaller class moves into the larger. Positions that become adjacent when
   classes meet at LCP L have a common prefix of exactly L words.
3. Where the distance d of such positions i < j is at most L, words i to j + L - 1 have
   smallest period d; if the words before i and j differ, that is a whole run.

Every text is one row, so the job is a map: nothing is shuffled, and a task holds
one slice of texts. Positions move at most log n times; a text of one word a
million times over takes some seconds, as its class only grows at the end.

Defined results: words are the stretches of other characters than blanks and
ASCII line or tabulator characters; null and empty texts have no words and no
runs; repeated rows are looked at each; other columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

MIN_LENGTH = 12
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words of the list."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def _paired(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the stretches that start with one of ``rank`` and go on, ``shift`` words on, with another; none beyond the end."""
    n = len(rank)
    after = np.zeros(n, dtype=np.int64)
    after[: n - shift] = rank[shift:] + 1
    return np.unique(rank * (n + 1) + after, return_inverse=True)[1]


def common_prefixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``least`` words with another in the order of a suffix tree's leaves, and the LCP of each with the one before.

    LCPs under ``least`` are given as 0.
    """
    n = len(ids)
    none = np.zeros(0, dtype=np.int64)
    if n <= least:
        return none, none
    levels, reach = [(1, ids)], 1
    while 2 * reach <= least:
        levels.append((2 * reach, _paired(levels[-1][1], reach)))
        reach *= 2
    if reach < least:
        levels.append((least, _paired(levels[-1][1], least - reach)))
        reach = least
    # From here on a rank is the number of suffixes in earlier classes, so that a class is refined in place.
    dense = levels[-1][1]
    counts = np.bincount(dense)
    rank = (np.cumsum(counts) - counts)[dense]
    levels[-1] = (reach, rank)
    active = kept = np.flatnonzero(counts[dense] > 1)
    while len(active):
        after = np.zeros(len(active), dtype=np.int64)
        inside = active + reach < n
        after[inside] = rank[active[inside] + reach] + 1
        old = rank[active]
        by = np.argsort(old * (n + 1) + after, kind="stable")
        old, after, active = old[by], after[by], active[by]
        of_old = np.diff(old, prepend=-1) != 0
        of_new = of_old | (np.diff(after, prepend=-1) != 0)
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(of_new, at, 0))
        rank = rank.copy()
        rank[active] = old + begin - np.maximum.accumulate(np.where(of_old, at, 0))
        reach *= 2
        levels.append((reach, rank))
        active = np.sort(active[~(of_new & np.append(of_new[1:], True))])
    order = kept[np.argsort(rank[kept])]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), dtype=np.int64)
    for width, ranks in reversed(levels):
        padded = np.append(ranks, -1)
        same = padded[a] == padded[b]
        lcp[same] += width
        a[same] += width
        b[same] += width
    lcp[lcp < least] = 0
    return order, np.concatenate(([0], lcp))


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """start, length and period of every run, in order."""
    least = max(1, -(-min_length // 2))
    order, lcp = common_prefixes(ids, least)
    edges = np.flatnonzero(lcp)
    if not len(edges):
        return []
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    root = list(range(len(order)))
    # Positions of a class in order; those of one run join at its end, as the first have most behind them.
    members: list[list[int] | None] = [[p] for p in order.tolist()]
    seeds: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for right, level in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        small, large = find(right - 1), find(right)
        if len(members[small]) > len(members[large]):
            small, large = large, small
        root[small] = large
        moved, held = members[small], members[large]
        members[small] = None
        if len(moved) == 1:
            x = moved[0]
            at = bisect_left(held, x)
            if at and x - held[at - 1] <= level:
                seeds.append((held[at - 1], x, level))
            if at < len(held) and held[at] - x <= level:
                seeds.append((x, held[at], level))
            held.insert(at, x)
            continue
        new = set(moved)
        held += moved
        held.sort()
        for x in moved:
            at = bisect_left(held, x)
            if at and x - held[at - 1] <= level and held[at - 1] not in new:
                seeds.append((held[at - 1], x, level))
            if at + 1 < len(held) and held[at + 1] - x <= level and held[at + 1] not in new:
                seeds.append((x, held[at + 1], level))
    if not seeds:
        return []
    i, j, level = np.array(seeds, dtype=np.int64).T
    whole = (j - i + level >= min_length) & ((i == 0) | (ids[i - 1] != ids[j - 1]))
    return sorted(zip(i[whole].tolist(), (j - i + level)[whole].tolist(), (j - i)[whole].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, with single blanks between."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()])


def detect(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed for each row of ``docs(doc_id, text)``."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in tx.rows(batches, "doc_id", "text", at_once=200):
            out = []
            for key, text in zip(keys, texts, strict=True):
                words = (text or b"").split()
                runs = find_runs(word_ids(words), min_length)
                out.append((key, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapse(words, runs)))
            yield tx.batch(schema, *zip(*out, strict=True))

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(look, FOUND)
