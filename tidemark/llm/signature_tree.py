"""A signature tree over token sets, and its self join by dual traversal.

Leaves hold up to ``FAN`` sets. Every node keeps the OR of the token bitmaps
below it, the range of set sizes and the largest number of tokens that a set
below it has beyond its own distinct bits. Two nodes can only hold a linked pair
if their size ranges are compatible and if

    min(beyond_A, beyond_B) + popcount(bits_A & bits_B)

which no overlap of their sets exceeds, reaches what the threshold asks of the
smallest sizes below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FAN = 8


@dataclass
class Level:
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    beyond: np.ndarray


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap per set; its width follows the larger sets, so that bits stay sparse."""
    sizes = np.array([len(s) for s in sets])
    width = 1 << int(np.clip(np.ceil(np.log2(max(2 * np.quantile(sizes, 0.9), 256))), 8, 15))
    out = np.zeros((len(sets), width // 8), dtype=np.uint8)
    for i, s in enumerate(sets):
        at = (s & np.uint64(width - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def build(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the sets themselves (one per node) up to the root."""
    levels = [Level(bits, sizes, sizes, sizes - _popcount(bits))]
    while len(levels[-1].low) > 1:
        below = levels[-1]
        cut = np.arange(0, len(below.low), FAN)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.bits, cut, axis=0),
                np.minimum.reduceat(below.low, cut),
                np.maximum.reduceat(below.high, cut),
                np.maximum.reduceat(below.beyond, cut),
            )
        )
    return levels


def _possible(level: Level, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of nodes that may hold a linked pair of sets."""
    fits = (den * level.high[i] >= num * level.low[j]) & (den * level.high[j] >= num * level.low[i])
    at = np.flatnonzero(fits)
    for part in np.array_split(at, max(1, len(at) * level.bits.shape[1] // (1 << 21))):
        shared = _popcount(level.bits[i[part]] & level.bits[j[part]])
        most = np.minimum(level.beyond[i[part]], level.beyond[j[part]]) + shared
        fits[part] = most * (num + den) >= num * (level.low[i[part]] + level.low[j[part]])
    return fits


def leaf_pairs(levels: list[Level], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Surviving pairs of leaves (level 1 nodes), near ones first; pairs are followed down from the root with itself."""
    i = j = np.zeros(1, dtype=np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        keep = _possible(levels[depth], i, j, num, den)
        i, j = i[keep], j[keep]
        if depth == 1:
            break
        n = len(levels[depth - 1].low)
        a = (i[:, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, axis=2).ravel()
        b = (j[:, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, axis=1).ravel()
        inside = (a <= b) & (b < n)
        i, j = a[inside], b[inside]
    order = np.argsort(j - i, kind="stable")
    return zip(i[order].tolist(), j[order].tolist(), strict=True)


def links(sets: list[np.ndarray], group: np.ndarray, known: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between sets that join what was not yet joined: a spanning forest of the linked pairs.

    ``group`` limits links to sets of one group; ``known`` is a component label
    per set from earlier rounds. A pair already in one component is not compared.
    """
    if len(sets) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    first = np.array([s[0] for s in sets])
    order = np.lexsort((first, sizes, group))
    bits = bitmaps([sets[k] for k in order])
    levels = build(bits, sizes[order])
    label = np.unique(known[order], return_inverse=True)[1]
    groups = group[order]
    for a, b in leaf_pairs(levels, num, den):
        x, y = np.arange(a * FAN, min(a * FAN + FAN, len(order))), np.arange(b * FAN, min(b * FAN + FAN, len(order)))
        i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        open_pairs = (i < j) & (label[i] != label[j]) & (groups[i] == groups[j])
        if not open_pairs.any():
            continue
        i, j = i[open_pairs], j[open_pairs]
        keep = _possible(levels[0], i, j, num, den)
        for p, q in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if label[p] == label[q]:
                continue
            s, t = sets[order[p]], sets[order[q]]
            shared = len(s) + len(t) - len(np.union1d(s, t))
            if den * shared >= num * (len(s) + len(t) - shared):
                label[label == label[q]] = label[p]
                yield int(order[p]), int(order[q])
