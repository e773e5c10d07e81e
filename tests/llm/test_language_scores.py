"""Naive-Bayes scores against a recount with plain dictionaries, long texts and very many languages."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id


def hashed(text, features):
    """Features of a text by the definition: runs of other characters are one blank, and so are both ends."""
    letters = [ch if ch.isalpha() else " " for ch in text.lower()]
    if not any(ch != " " for ch in letters):
        return Counter()
    words = "".join(letters).split()
    points = [ord(ch) for ch in " " + " ".join(words) + " "]
    found = Counter()
    for order in language_id.ORDERS:
        for i in range(len(points) - order + 1):
            value = 0
            for p in points[i : i + order]:
                value = (value * 0x01000193 & 0xFFFFFFFF) ^ (p * 0x9E3779B1 & 0xFFFFFFFF)
            value = ((value ^ (value >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
            found[(value ^ (value >> 13)) & (features - 1)] += 1
    return found


@pytest.mark.parametrize("chunk", [7, 64, language_id.CHUNK])
def test_no_ngram_is_lost_at_a_cut(chunk, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcÄß  .,1\n😀中") for _ in range(rng.randint(0, 200)))
        got = Counter(np.concatenate([np.zeros(0, dtype=np.int64), *language_id._text_features(text, 1 << 12)]).tolist())
        assert got == hashed(text, 1 << 12)


def test_scores_equal_a_recount(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BATCH", 300)
    rng = random.Random(1)
    pools = {"aa": "abcd", "bb": "cdef", "cc": "efgh"}
    say = lambda pool: " ".join("".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30)))
    rows = [(say(pool), lang) for lang, pool in pools.items() for _ in range(30)]
    features = 1 << 10
    langs, matrix = language_id.train(spark.createDataFrame(rows, "text string, lang string"), features)
    assert langs == sorted(pools)
    counts = {lang: sum((hashed(t, features) for t, l in rows if l == lang), Counter()) for lang in langs}
    asked = [say("abcdefgh") for _ in range(50)] + ["", None, "1 2 3", "a", " ".join(["abcd efgh"] * 40000)]
    got = language_id.predict(spark.createDataFrame([(t,) for t in asked], "text string"), (langs, matrix)).collect()
    for text, row in zip(asked, got):
        mine = hashed(text or "", features)
        if not mine:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = {k: sum(n * math.log((counts[k][f] + 0.5) / (sum(counts[k].values()) + 0.5 * features)) for f, n in mine.items()) for k in langs}
        best = max(total.values())
        assert total[row["lang_pred"]] >= best - 1e-3 * max(1, abs(best)) * 1e-3
        share = 1 / sum(math.exp(v - best) for v in total.values())
        assert abs(row["score"] - share) < 1e-3


def test_very_many_languages_and_ties(spark, monkeypatch):
    rows = [("abc abd", f"l{i:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    langs, matrix = language_id.train(docs)
    assert len(langs) == 600 and matrix.nbytes <= language_id.MODEL_BYTES and matrix.shape[0] == language_id.FEATURES // 2
    row = language_id.predict(docs.limit(1), (langs, matrix)).first()
    assert row["lang_pred"] == "l000" and abs(row["score"] - 1 / 600) < 1e-9
