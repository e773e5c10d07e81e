"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is an aggregation over all labelled rows (counts per language and feature,
summed by Spark), so a language with few rows is learned whatever the size of the
others. The model is a matrix of languages x features whose
size is fixed by ``FEATURES`` and checked before it is sent to the tasks.
Scoring adds up log probabilities of whole texts batch by batch.

Defined results: a null text, an empty one and one without letters get ``und``
with score 0; without any labelled row every text gets ``und``. Rows with a
null language never train. Repeated rows count as often as they occur. Ties
between languages go to the alphabetically first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.session import cut_lineage

FEATURES = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
#: The broadcast matrix is no larger; with very many languages features are folded together instead.
MODEL_BYTES = 64 << 20
#: Characters of a text that are taken at once, and n-grams of a batch that are scored at once.
CHUNK, BATCH = 1 << 18, 1 << 20

UNKNOWN = "und"


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of other characters becomes one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters(points)
    if not letters.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = points[keep]
    return np.concatenate(([np.uint32(32)], points, [np.uint32(32)])) if letters[-1] else np.concatenate(([np.uint32(32)], points))


_BMP: np.ndarray | None = None


def _letters(points: np.ndarray) -> np.ndarray:
    global _BMP
    if _BMP is None:
        _BMP = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)
    found = _BMP[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        found[high] = [chr(p).isalpha() for p in points[high].tolist()]
    return found


def _features(points: np.ndarray, features: int) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, one array per order."""
    value = np.zeros(len(points), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(points) < order:
            return
        n = len(points) - order + 1
        value = (value[:n] * np.uint32(0x01000193)) ^ (points[order - 1 :] * np.uint32(0x9E3779B1))
        if order in ORDERS:
            scrambled = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield ((scrambled ^ (scrambled >> np.uint32(13))) & np.uint32(features - 1)).astype(np.int64)


def _text_features(text: str, features: int) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, which is taken in stretches that end between words.

    The last characters of a stretch go before the next, so that none of the n-grams over a cut is lost.
    """
    carry = max(ORDERS) - 1
    before: np.ndarray | None = None
    start = 0
    while start < len(text):
        stop = min(len(text), start + CHUNK)
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        points = _code_points(text[start:stop])
        start = stop
        if not len(points):
            continue
        if before is None:
            joined, counted = points, 0
        else:  # the blank that ends one stretch is the one that begins the next
            joined, counted = np.concatenate((before, points[1:])), len(before)
        for order, found in zip(ORDERS, _features(joined, features)):
            yield found[max(0, counted - order + 1) :]
        before = joined[-carry:]


def count_features(docs: DataFrame, features: int = FEATURES) -> DataFrame:
    """lang, feature, n over all rows of ``docs(text, lang)`` with a language and a text."""
    schema = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    @tx.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.other_work()
        held: dict[str, np.ndarray] = {}
        for texts, langs in tx.rows(batches, "text", "lang"):
            for text, lang in zip(texts, langs, strict=True):
                if lang not in held and len(held) * features * 8 >= MODEL_BYTES:
                    yield from given(held)
                    held.clear()
                counts = held.setdefault(lang, np.zeros(features, dtype=np.int64))
                for found in _text_features(text, features):
                    counts += np.bincount(found, minlength=features)
        yield from given(held)

    def given(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield tx.batch(schema, [lang] * len(used), used.astype(np.int32), counts[used])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, feature int, n long")
    return counts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, features: int = FEATURES) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log probabilities, one column each; a language without an n-gram is not learned.

    The matrix is bounded by ``MODEL_BYTES``: features that agree in their low bits are added up until it fits.
    """
    counts = cut_lineage(count_features(docs, features), "features")
    languages = counts.select("lang").distinct().count()
    while features > 1 and languages * features * 4 > MODEL_BYTES:
        features //= 2
    folded = counts.groupBy("lang", F.pmod("feature", F.lit(features)).alias("feature")).agg(F.sum("n").alias("n"))
    rows = folded.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("cells"))
    table = {}
    for row in rows.toLocalIterator():
        cells = np.array(row["cells"], dtype=np.int64).reshape(-1, 2)
        column = np.zeros(features)
        column[cells[:, 0]] = cells[:, 1]
        table[row["lang"]] = np.log((column + SMOOTHING) / (column.sum() + SMOOTHING * features)).astype(np.float32)
    langs = sorted(table)
    if not langs:
        return [], np.zeros((features, 0), dtype=np.float32)
    return langs, np.stack([table[lang] for lang in langs], axis=1)


def score_batch(texts: list[str | None], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text (row) under each language, and which texts have an n-gram.

    The batch is a sparse matrix in rows of n-grams, each with the count one per occurrence, times the dense one of ``logs[language, feature]``.
    """
    totals, seen = np.zeros((len(texts), len(logs))), np.zeros(len(texts), dtype=bool)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            indices = np.concatenate(held)
            starts = np.cumsum([0, *(len(h) for h in held[:-1])])
            for k, row in enumerate(logs):
                np.add.at(totals[:, k], rows, np.add.reduceat(row.take(indices), starts, dtype=np.float64))
            held.clear()
            rows.clear()
            size = 0

    for i, text in enumerate(texts):
        for found in _text_features(text or "", logs.shape[1]):
            if len(found):
                seen[i] = True
                held.append(found)
                rows.append(i)
                size += len(found)
        if size >= BATCH:
            flush()
    flush()
    return totals, seen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with a language and the posterior probability of it, from the column ``text`` alone; all languages are as likely beforehand.

    Of languages with equal scores the first in alphabetical order is given.
    """
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    @F.pandas_udf("struct<lang:string,score:double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        if not langs:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
        totals, seen = score_batch(texts.tolist(), shared.value)
        best = totals.argmax(axis=1)
        share = 1.0 / np.exp(totals - totals[np.arange(len(best)), best][:, None]).sum(axis=1)
        names = np.array([*langs, UNKNOWN], dtype=object)[np.where(seen, best, len(langs))]
        tx.give_back()
        return pd.DataFrame({"lang": names, "score": np.where(seen, share, 0.0)})

    found = classify(F.col("text").cast("string"))
    names = [c for c in docs.columns if c not in into]
    return docs.withColumn("__language", found).select(*names, F.col("__language.lang").alias(into[0]), F.col("__language.score").alias(into[1]))


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the keys that never trains; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs(doc_id, text, lang)``."""
    named = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(named.filter("not held_out"))
    return predict(named.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
