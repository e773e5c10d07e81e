"""Hashing of words, shingles and byte windows in NumPy, shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


#: Called where a worker takes up other work: lets go of what it kept from task to task.
LET_GO: list[Callable[[], None]] = []


def other_work() -> None:
    for free in LET_GO:
        free()
    give_back()


def give_back() -> None:
    """Free memory goes back to the system; a worker that waits for its next task would otherwise keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc alone has it
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives back its memory at the end."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS, _INVERSES = (np.full(size, base, dtype=np.uint64) for base in (BASE, BASE_INVERSE))
        for table in (_POWERS, _INVERSES):
            table[0] = 1
            np.cumprod(table, out=table)
    return _POWERS, _INVERSES


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h[i]`` is the polynomial hash of the first i bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    power, _ = _powers(len(data) + 1)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hash of ``data[start:end]`` for each span, the same wherever the bytes stand."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def word_spans(data: np.ndarray, breaks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~breaks[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, breaks: np.ndarray = BLANKS) -> np.ndarray:
    """A 64-bit hash for each word of lower-cased bytes (A-Z only), in order."""
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    starts, ends = word_spans(raw, breaks)
    return span_hash(prefix_hash(raw), starts, ends)


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; none when there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(BASE) + words[i : i + n]
    return mix(total, size)


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one has none."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(data)
    return np.unique(ngram_hashes(words, min(size, len(words)))) if len(words) else words


def rows(batches: Iterator[pa.RecordBatch], *columns: str, at_once: int = 1000) -> Iterator[tuple[list, ...]]:
    """Columns of slices of the Arrow batches as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield tuple(part.column(c).to_pylist() for c in columns)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
