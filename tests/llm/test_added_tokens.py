"""Texts that hold the content of an added token, against the library as it is."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_files, tokenizing
from tidemark.session import cut_lineage, scratch_path

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
END, START = "<|endoftext|>", "<|startoftext|>"
TEXTS = [
    f"c {END} d", f"a{START}b {END}", f"{END}{END}", f"  {END}  x \n{END}", f"{END} it's", "<|ENDOFTEXT|> <|endoftext |> <|end oftext|>", f"中 {END} é", f"{END[:-1]}{END}", "plain", None, "",
]


LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE_BPE, WORD_BPE)}


def default_ids(path, text):
    return np.array(LIBRARY[path].encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_known_ids():
    assert np.frombuffer(tokenizing.encoder(BYTE_BPE).ids(TEXTS[0]), dtype="<u4").tolist() == [66, 220, 50256, 288]
    assert np.frombuffer(tokenizing.encoder(WORD_BPE).ids(TEXTS[0]), dtype="<u4").tolist() == [322, 49407, 323]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_tokenizing(path):
    assert [tokenizing.encoder(path).ids(t) for t in TEXTS] == [default_ids(path, t).tobytes() for t in TEXTS]


@pytest.fixture(scope="module")
def added(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_token_files(spark, added):
    path = scratch_path(spark, "files")
    token_files.write(added, path, BYTE_BPE)
    start, expected = 0, set()
    for d, t in enumerate(TEXTS):
        ids = np.append(default_ids(BYTE_BPE, t), 0).astype("<u4")
        expected.add((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in token_files.scan(spark, path).collect()} == expected


def test_packing(added):
    ids = [np.append(default_ids(WORD_BPE, t), 0).astype("<u4") for t in TEXTS]
    expected = {(d, len(i), zlib.crc32(i.tobytes())) for d, i in enumerate(ids)}
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(added, WORD_BPE).collect()} == expected


def test_recount(added):
    trees = cut_lineage(token_counts.build(added, BYTE_BPE, 4), "trees")
    # One edit undoes a token, the other makes one.
    edited = added.withColumn("edits", token_counts.replacements(F.col("text"), "[|]>|end oftext", "|>"))
    rows = token_counts.recount(edited, trees, BYTE_BPE).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((d, len(default_ids(BYTE_BPE, t))) for d, t in enumerate(TEXTS))


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_edits(path):
    """Edits that make and break added tokens, in trees of small leaves."""
    rng = random.Random(3)
    one = tokenizing.encoder(path)
    parts = [END, START, "<|", "endoftext", "|>", " ", "  ", "word", "x", "\n", "'s"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        a, b = sorted(rng.choices(range(len(text) + 1), k=2))
        new = rng.choice(["", " ", "|>", "<|", "endoftext", END])
        tree = token_counts.grow(text, one, 3)
        assert tree.tokens == len(default_ids(path, text))
        assert token_counts.edit(text, tree, [(a, b, new)], one)[0] == len(default_ids(path, text[:a] + new + text[b:]))
