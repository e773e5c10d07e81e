"""Order-preserving packing: a stream of documents is cut into windows of at most ``capacity`` tokens by dynamic programming.

Documents follow each other by doc_id, each with its end id, and windows are consecutive stretches of
that stream. A window of w tokens is padded to the capacity unless w is one of the short lengths (powers of
two), which have sequences of their own. The plan has the least total of

- padding, one per token,
- ``WINDOW`` per window, so that windows are not many and short,
- ``SENTENCE`` per cut behind a sentence inside a document, ``HARD`` per cut anywhere else in one.

Cuts are possible at the end of a document (free) or sentence, and every ``GRID`` tokens in a stretch without
either. With cost f(i) of the best plan up to cut i at place c(i), a padded window gives
f(j) = min f(i) + c(i) + capacity + WINDOW - c(j), over the i within the capacity: a minimum over a sliding range, which
a monotone queue gives in constant time. Windows of a short length have one possible start each, found by its place.

Ids never leave the pass that makes them. It keeps, for each possible cut, its place and the
CRC-32 of all ids before; the checksum of any piece follows from those at its two ends. That table,
a small part of the input, is dealt to tasks by ranges of doc_id and sorted; a task plans one stretch of about ``STRETCH``
tokens after the other, so its memory is bounded. Order holds inside a task and
from one range to the next; only the last window of a stretch is cut short by where the stretch ends.

Defined results: a null or empty text is the end id alone; repeated rows are packed each, next to each other; null
doc_ids come first; other columns are not carried.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import tokenizing
from tidemark.session import cut_lineage

WINDOW, SENTENCE, HARD = 16, 2, 8
#: Tokens between possible cuts where neither a sentence nor a document ends; gaps are kept in a byte.
GRID = 16
#: Tokens planned at once, about.
STRETCH = 1 << 19
#: The shortest window that needs no padding.
SHORTEST = 128
#: Ends of sentences: the last character of a token.
_ENDS = tuple(".!?…。！？")

CUTS = "doc_id long, row long, tokens long, gaps binary, costs binary, checks binary"


@lru_cache(4)
def _sentence_ends(vocabulary: str) -> np.ndarray:
    """Whether each id ends a sentence."""
    names = tokenizing.encoder(vocabulary).library.get_vocab(with_added_tokens=True)
    out = np.zeros(max(names.values()) + 1, dtype=bool)
    for name, number in names.items():
        out[number] = name.removesuffix("</w>").endswith(_ENDS)
    return out


def possible_cuts(ids: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in tokens from the start of all) and costs of the cuts that documents side by side allow; ``stops``: where each ends."""
    n = len(ids)
    can = ends[ids]
    can[stops - 1] = True
    place = np.flatnonzero(can) + 1
    cost = np.full(len(place), SENTENCE, dtype=np.uint8)
    cost[np.searchsorted(place, stops)] = 0
    start = np.append(0, place[:-1])
    more = (place - start - 1) // GRID
    if not more.any():
        return place, cost
    out = np.empty(len(place) + int(more.sum()), dtype=np.int64)
    paid = np.full(len(out), HARD, dtype=np.uint8)
    at = np.cumsum(more + 1) - 1  # where the ends of sentences and documents go; before each, steps of the grid
    out[at], paid[at] = place, cost
    first = np.append(0, at[:-1] + 1)
    step = np.arange(len(out)) - np.repeat(first, more + 1) + 1
    hard = paid == HARD
    out[hard] = (np.repeat(start, more + 1) + GRID * step)[hard]
    return out, paid


def cuts(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, row (a number inside the task), tokens, gaps and costs (bytes) and checks (32-bit integers) of the cuts of each row of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("tokens", pa.int64()), ("gaps", pa.binary()), ("costs", pa.binary()), ("checks", pa.binary())])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, sentence, row = tokenizing.encoder(vocabulary), _sentence_ends(vocabulary), 0
        crc32 = zlib.crc32
        for keys, texts in tx.rows(batches, "doc_id", "text", at_once=200):
            raw = [one.ids(text) + end for text in texts]
            tokens = np.array([len(r) // 4 for r in raw])
            stops = np.cumsum(tokens)
            place, cost = possible_cuts(np.frombuffer(b"".join(raw), dtype="<u4"), stops, sentence)
            gaps = np.diff(place, prepend=0).astype(np.uint8)
            until = np.searchsorted(place, stops) + 1
            after = (4 * (place - np.repeat(stops - tokens, np.diff(until, prepend=0)))).tolist()
            out, begin = [], 0
            for r, stop in zip(raw, until.tolist(), strict=True):
                checks, crc, at = [], 0, 0
                for p in after[begin:stop]:
                    crc = crc32(r[at:p], crc)
                    checks.append(crc)
                    at = p
                out.append((gaps[begin:stop].tobytes(), cost[begin:stop].tobytes(), array("I", checks).tobytes()))
                begin = stop
            yield tx.batch(schema, keys, np.arange(row, row + len(keys)), tokens, *zip(*out, strict=True))
            row += len(keys)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, CUTS)


@lru_cache(1)
def _zero_bytes() -> np.ndarray:
    """For each bit of a length in tokens, what so many zero tokens make of each byte of a CRC-32 register: [bit, byte place, value]."""
    polynomial = 0xEDB88320
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(polynomial), one >> 1)
    tables = np.zeros((32, 4, 256), dtype=np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for place in range(4):
        register = values << np.uint32(8 * place)
        for _ in range(4):
            register = one[register & 255] ^ (register >> np.uint32(8))
        tables[0, place] = register
    for bit in range(1, 32):
        for place in range(4):
            tables[bit, place] = _apply(tables[bit - 1], tables[bit - 1, place])
    return tables


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    return table[0, register & 255] ^ table[1, (register >> 8) & 255] ^ table[2, (register >> 16) & 255] ^ table[3, register >> 24]


def piece_checks(before: np.ndarray, through: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """CRC-32 of the last ``tokens`` ids of a text, from those of all ids before them and of all ids with them."""
    moved = before.astype(np.uint32)
    for bit in range(int(tokens.max(initial=0)).bit_length()):
        on = (tokens >> bit) & 1 == 1
        moved[on] = _apply(_zero_bytes()[bit], moved[on])
    return moved ^ through.astype(np.uint32)


def plan(place: np.ndarray, cost: np.ndarray, capacity: int, shortest: int = SHORTEST) -> np.ndarray:
    """Numbers of the cuts of the best plan, the first (0) and the last among them.

    ``place``: ascending, from 0, with gaps of at most ``capacity``; ``cost``: of a cut there.
    """
    n = len(place)
    starts: dict[int, list[int]] = {}
    width = 1 << (shortest - 1).bit_length()
    while width < capacity:
        at = np.minimum(np.searchsorted(place, place - width), n - 1)
        for j, i in zip((hit := np.flatnonzero(place[at] == place - width)).tolist(), at[hit].tolist(), strict=True):
            starts.setdefault(j, []).append(i)
        width *= 2
    places, costs = place.tolist(), (cost.astype(np.int64) + WINDOW).tolist()
    total, back = [0] * n, [0] * n
    keys, cut, head = [0], [0], 0  # the queue: total + place, ascending, and the cut
    for j in range(1, n):
        here = places[j]
        oldest = here - capacity
        while places[cut[head]] < oldest:
            head += 1
        i = cut[head]
        least = keys[head] - oldest
        if j in starts:
            for s in starts[j]:
                if total[s] < least:
                    least, i = total[s], s
        total[j] = least = least + costs[j]
        back[j] = i
        key = least + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            cut.pop()
        keys.append(key)
        cut.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return np.array(chosen[::-1])


def _laid(rows: list[tuple], capacity: int, first: int) -> tuple[list[np.ndarray], list, int]:
    """Columns of the pieces of one stretch, their doc_ids, and the next sequence number."""
    counts = np.array([len(r[2]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), counts)
    tokens = np.array([r[1] for r in rows])
    base = np.cumsum(tokens) - tokens
    inner = np.concatenate([r[2] for r in rows]).astype(np.int64)
    cost = np.concatenate([r[3] for r in rows]).astype(np.int64)
    check = np.concatenate([r[4] for r in rows])
    place = base[doc] + inner
    chosen = plan(np.append(0, place), np.append(0, cost), capacity)[1:] - 1
    windows = np.zeros(len(place), dtype=bool)
    windows[chosen] = True
    last = np.flatnonzero(windows | (np.diff(doc, append=len(rows)) != 0))  # cuts that end a piece
    stop, owner = inner[last], doc[last]
    fresh = np.diff(owner, prepend=-1) != 0
    start = np.where(fresh, 0, np.append(0, stop[:-1]))
    before = np.where(fresh, 0, np.append(np.uint32(0), check[last][:-1]))
    sequence = np.cumsum(np.append(0, windows[last][:-1]))
    begin = base[owner] + start
    opens = np.flatnonzero(np.diff(sequence, prepend=-1))
    columns = [start, stop - start, piece_checks(before, check[last], stop - start).astype(np.int64), tokens[owner], sequence + first, begin - begin[opens][sequence]]
    return columns, [rows[o][0] for o in owner.tolist()], first + int(sequence[-1]) + 1


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, stretch: int = STRETCH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs(doc_id, text)``."""
    if capacity < GRID:
        raise ValueError(f"a window holds {GRID} tokens at least")
    table = cut_lineage(cuts(docs, vocabulary, end_id), "cuts")
    order = ["doc_id", "tokens", F.xxhash64("checks"), "row"]
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rows, held = TaskContext.get().partitionId() << 36, [], 0
        for columns in tx.rows(batches, "doc_id", "tokens", "gaps", "costs", "checks"):
            for key, n, gaps, costs, checks in zip(*columns, strict=True):
                rows.append((key, n, np.cumsum(np.frombuffer(gaps, dtype=np.uint8), dtype=np.int64), np.frombuffer(costs, dtype=np.uint8), np.frombuffer(checks, dtype="<u4")))
                held += n
                if held >= stretch:
                    laid, owners, sequence = _laid(rows, capacity, sequence)
                    yield tx.batch(schema, owners, *laid)
                    rows, held = [], 0
        if rows:
            laid, owners, _ = _laid(rows, capacity, sequence)
            yield tx.batch(schema, owners, *laid)

    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
