"""Quotes of a benchmark item that are less than its coverage."""

from __future__ import annotations

import random

from tidemark.llm import decontaminate


def _words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]


def test_a_long_quote_of_a_longer_item(spark):
    rng = random.Random(1)
    item = _words(rng, 59)
    quotes = {1: item[3:38], 2: item[20:33], 3: item[20:32], 4: item[:5] + ["x"] + item[6:13]}
    docs = [(d, " ".join(_words(rng, 30) + q + _words(rng, 30))) for d, q in quotes.items()]
    # The pair's shared seeds are many, its tiles are short: one of 12 words here and there.
    docs.append((5, " ".join(item[:12] + ["y"] + item[30:41])))
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    rows = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], round(r["coverage"] * 59), r["n_tiles"]) for r in rows} == {(1, 35, 1), (2, 13, 1)}
