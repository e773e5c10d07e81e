"""What the steps of suffix_dedup sort and hash, and that they find the same as plain counting."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm import text as tx


def passages(rng, alphabet, length):
    base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 3 * length))) for _ in range(3)]
    return [b"".join(b[rng.randint(0, len(b)) :] for b in rng.choices(base, k=rng.randint(0, 3))) for _ in range(rng.randint(1, 9))]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
@pytest.mark.parametrize("length", [2, 6, 60])
def test_windows_of_any_bytes_and_weights(alphabet, length):
    rng = random.Random(length)
    for _ in range(20):
        texts = passages(rng, alphabet, length)
        weights = [rng.randint(1, 2) for _ in texts]
        seen = Counter()
        for t, w in zip(texts, weights, strict=True):
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] += w
        for t, flags in zip(texts, suffix_dedup.repeated_windows(texts, weights, length), strict=True):
            assert [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] == flags.tolist()


def test_places_are_not_sorted_apart_from_their_keys(monkeypatch):
    """Sorting places by 64-bit keys, once a level, was half of the query's time."""
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(280)) for _ in range(60)]
    slow, plain = [], np.argsort

    def argsort(keys, *args, **kwargs):
        if keys.dtype.itemsize > 2:
            slow.append(len(keys))
        return plain(keys, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", argsort)
    found = suffix_dedup.repeated_windows(texts + texts[:20], [1] * 80)
    assert [bool(f.all()) for f in found] == [True] * 20 + [False] * 40 + [True] * 20
    assert sum(slow) == 0


def test_short_texts_are_hashed_together(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice([0, 199, 200, 201, 700]))) for _ in range(100)]
    calls, plain = [], tx.prefix_hash
    monkeypatch.setattr(tx, "prefix_hash", lambda raw: calls.append(len(raw)) or plain(raw))
    of, *found = suffix_dedup.snippets(texts)
    assert len(calls) == 1
    for i, t in enumerate(texts):
        _, *alone = suffix_dedup.snippets([t])
        assert all((a == f[of == i]).all() and len(a) == (of == i).sum() for a, f in zip(alone, found, strict=True))
        assert sum(alone[3].tolist()) == max(0, len(t) - 199)  # each window start once
