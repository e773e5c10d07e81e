"""Minimal perfect hash of 64-bit keys: cascaded bit arrays with rank.

Level by level, the keys left over are hashed into a bit array of twice their
number; a place that only one key hits is kept. A key's number is the rank of
its bit over all levels, so n keys get the numbers 0..n-1 in about 4 bits each.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.text import mix

MAX_LEVELS = 64


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all levels (one byte each) and the start of each level; keys are distinct."""
    left = np.asarray(keys).astype(np.int64).view(np.uint64)
    bits, starts = [], [0]
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = 2 * len(left) + 1
        at = (mix(left, level) % np.uint64(size)).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        kept = np.zeros(size, dtype=np.uint8)
        kept[at[alone]] = 1
        bits.append(kept)
        starts.append(starts[-1] + size)
        left = left[~alone]
    if len(left):
        raise ValueError("keys are not distinct")
    return np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8), np.array(starts, dtype=np.int64)


def slots(keys: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each key, or -1 where it hits no bit; a foreign key may get any number, so compare fingerprints."""
    keys = np.asarray(keys).astype(np.int64).view(np.uint64)
    rank = np.cumsum(bits, dtype=np.int64)
    out = np.full(len(keys), -1, dtype=np.int64)
    left = np.arange(len(keys))
    for level in range(len(starts) - 1):
        if not len(left):
            break
        at = starts[level] + (mix(keys[left], level) % np.uint64(starts[level + 1] - starts[level])).astype(np.int64)
        found = bits[at] == 1
        out[left[found]] = rank[at[found]] - 1
        left = left[~found]
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys).astype(np.int64).view(np.uint64), 99) >> np.uint64(32)).astype(np.uint32)
