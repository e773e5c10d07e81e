from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, row string, key string, bin int, f1 string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and clashing column names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts: list[str | None] = [None, "", "   \n\t", "One", "one two", "ÀÉ ß 中文 😀", "1234 5678", "a" * 5000]
    passage = " ".join(word() for _ in range(60))
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(rng.randint(5, 120))))
    for base in texts[10:16]:
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            near = list(words)
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
        texts.append(base)
        texts.append(base.upper())
    for _ in range(6):
        texts.append(f"{word()} {word()} {passage} {word()} {passage[:150]}")
    texts.append(" ".join(word() for _ in range(6000)))
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0, "x", "y", 1, "z") for i, t in enumerate(texts)]
    rows.append((None, texts[12], "en", "s", 0, "x", "y", 1, "z"))
    rows += [rows[14], rows[14]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
