"""Periodic runs, ranked lexical search and window packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import catalog, lexical_search, periodic_runs, window_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def slow_runs(words, min_length):
    ids, found = np.array([words.index(w) for w in words]), []
    for q in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-q] == ids[q:]).astype(int), [0]))))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, 2 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.append((i, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            at, period = rng.randrange(n), rng.randint(1, 8)
            words = [words[i] if i < at else words[min(n - 1, at + (i - at) % period)] for i in range(n)]
        least = rng.choice([12, 12, 4, 2, 7, 1])
        assert periodic_runs.find_runs(np.array(words, dtype=np.int64), least) == slow_runs(words, least)


@pytest.mark.parametrize("period", [1, 7, 60_000])
def test_runs_of_a_long_text(period):
    began = time.perf_counter()
    assert periodic_runs.find_runs(np.arange(200_000) % period) == [(0, 200_000, period)]
    assert time.perf_counter() - began < 20


def reference_looped(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_run_query(spark, docs, corpus, no_docs, tmp_path):
    more = [(1000 + i, " ".join(["so", "it", "goes"] * i) + "\x0bx", "en", "s", 0, "x", "y", 1, "z") for i in range(40)]
    more += [(2000 + i, t, "en", "s", 0, "x", "y", 1, "z") for t in ("", " \n", None, "é \x85 b") for i in range(20)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in catalog.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in corpus + more:
        words = reference_looped(doc_id, text)
        runs = slow_runs(words, 12)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    assert got == sorted(want, key=repr) and any(r[1] > 1 for r in want)
    assert periodic_runs.detect(no_docs).count() == 0


def slow_search(docs, items, k):
    cut = lambda t: "".join(c if c > "\x7f" or c.isalnum() else " " for c in (t or "")).translate({i: i + 32 for i in range(65, 91)}).split(" ")
    said = [(d, [w for w in cut(t) if w]) for d, t in docs]
    said = [(d, w) for d, w in said if w]
    total = sum(len(w) for _, w in said)
    sets = [set(w) for _, w in said]
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(w for w in cut(text) if w)
    out = []
    for item, terms in asked.items():
        scored = []
        for d, words in said:
            m = 10 + 90 * len(words) * len(said) // total
            score = 0
            for t in terms & set(words):
                df = sum(t in s for s in sets)
                tf = words.count(t)
                score += math.floor(1000 * math.log((2 * len(said) + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("round_terms", [lexical_search.ROUND_TERMS, 400])
def test_search(spark, docs, corpus, round_terms, monkeypatch):
    rng = random.Random(4)
    texts = [(r[0], r[1]) for r in corpus]
    pool = " ".join(t for _, t in texts if t and len(t) < 3000).split()
    items = [(i, " ".join(rng.sample(pool, rng.choice([1, 3, 30, 90])))) for i in range(25)]
    items += [(3, "ONE two"), (None, "中文 😀 one"), (40, None), (41, "!"), (42, "unheard-of"), (43, "ÀÉ ß"), (44, "1234 5678"), (45, pool[5]), (45, pool[5])]
    monkeypatch.setattr(lexical_search, "SCORED", 2)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = lexical_search.search(docs, asked, 3, round_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_search(texts, items, 3)


def test_search_of_little(spark, docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_masks_are_left_out():
    rng = np.random.default_rng(3)
    impact = np.where(rng.random((70, 2000)) < rng.random((70, 1)) ** 3, rng.integers(7 * 10**5, 10**6, (70, 2000)), 0).astype(np.int32)
    weights = rng.integers(0, 9000, 70)
    most = impact.max(axis=1).astype(np.int64)
    best = lexical_search.Best(10)
    scored = lexical_search.evaluate(impact, weights, most, list(range(2000)), best)
    scores = weights @ impact.astype(np.int64)
    assert [(-r[0], r[3]) for r in best.rows] == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(2000), -scores))[:10]]
    assert scored < 1500
    masks, order, begin = lexical_search.grouped_by_mask(impact > 0)
    assert len({tuple(m) for m in masks.tolist()}) == len(masks) == len(begin) - 1
    for m, a, b in zip(masks, begin, begin[1:]):
        assert ((impact[:, order[a:b]] > 0).T == m).all()


def slow_plan(place, cost, capacity, shortest):
    total = [0.0]
    for j in range(1, len(place)):
        options = []
        for i in range(j):
            w = place[j] - place[i]
            if w <= capacity:
                free = w == capacity or (w >= shortest and w & (w - 1) == 0)
                options.append(total[i] + (0 if free else capacity - w) + window_packing.WINDOW + cost[j])
        total.append(min(options))
    return total[-1]


def test_plan_is_the_best():
    rng = random.Random(3)
    for _ in range(600):
        capacity, shortest = rng.choice([16, 32, 40, 100]), rng.choice([1, 4, 8])
        place = np.cumsum([0] + [rng.randint(1, rng.choice([3, 10, capacity])) for _ in range(rng.randint(1, 60))])
        cost = np.array([0] + [rng.choice([0, 4, 32]) for _ in place[1:]])
        chosen = window_packing.plan(place, cost, capacity, shortest)
        paid = 0
        for a, b in zip(chosen, chosen[1:]):
            w = place[b] - place[a]
            assert 0 < w <= capacity
            paid += (0 if w == capacity or (w >= shortest and w & (w - 1) == 0) else capacity - w) + window_packing.WINDOW + cost[b]
        assert chosen[0] == 0 and chosen[-1] == len(place) - 1 and paid == slow_plan(place, cost, capacity, shortest)


def test_piece_checks():
    rng = random.Random(1)
    for n in (1, 2, 5, 300, 4096):
        a, b = rng.randbytes(4 * rng.randint(0, 50)), rng.randbytes(4 * n)
        got = window_packing.piece_checks(np.array([zlib.crc32(a)]), np.array([zlib.crc32(a + b)]), np.array([n]))
        assert int(got[0]) == zlib.crc32(b)


@pytest.mark.parametrize("capacity, stretch", [(4096, window_packing.STRETCH), (64, 700)])
def test_windows(spark, docs, corpus, no_docs, capacity, stretch):
    rows = window_packing.pack(docs, WORDS, capacity, 2, stretch).collect()
    library = Tokenizer.from_file(WORDS)
    ids = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus]
    crc = lambda part: zlib.crc32(np.array(part, dtype="<u4").tobytes())
    pieces: dict = {}
    for r in rows:
        assert 0 < r["length"] <= capacity
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for doc_id, mine in ids:
        same = [x for x in ids if x[0] == doc_id and len(x[1]) == len(mine)]
        held = pieces[doc_id, len(mine)]
        assert sum(r["length"] for r in held) == sum(len(x[1]) for x in same)
        assert all(r["ids_crc32"] in {crc(x[1][r["start"] : r["start"] + r["length"]]) for x in same} for r in held)
        if len(same) == 1:
            assert [r["start"] for r in sorted(held, key=lambda r: r["start"])] == [sum(q["length"] for q in held if q["start"] < r["start"]) for r in sorted(held, key=lambda r: r["start"])]
    assert len(pieces) == len({(d, len(x)) for d, x in ids})
    windows: dict = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    for held in windows.values():
        held.sort()
        assert [o for o, _, _ in held] == [sum(n for p, n, _ in held if p < o) for o, _, _ in held] and sum(n for _, n, _ in held) <= capacity
        known = [(d is not None, d or 0) for _, _, d in held]
        assert known == sorted(known)
    assert window_packing.pack(no_docs, WORDS).count() == 0


def test_windows_are_full(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["one", "two,", "three.", "of", "seven"]) for _ in range(int(rng.lognormvariate(5.5, 1)))) for _ in range(3000)]
    rows = window_packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), WORDS)
    sums = np.array([r["n"] for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()])
    padding = np.where(sums & (sums - 1) == 0, 0, 4096 - sums).sum()
    assert padding < 0.01 * sums.sum() and len(sums) < 1.25 * sums.sum() / 4096 + 8
