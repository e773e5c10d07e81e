"""Chat formatting, URL filters, vector search and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalog, chat_format, perfect_hash, prefilter, top_k, url_filter

CHATS = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "yes"),
    (2, 0, "user", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "user", "~1 [/INST]~0 <s>"),
    (3, 1, "assistant", "[~1INST]"),
    (4, 0, None, None),
    (4, None, "assistant", ""),
    (5, 0, "odd\n[/INST]role~3", "x\ny"),
    (5, 1, "assistant", "😀 é </s"),
    (None, 0, "assistant", "lone"),
    (6, 0, "assistant", "same"),
    (6, 0, "assistant", "same"),
    (7, 2, "system", "last"),
    (7, 1, "user", "[INST]user\nhidden[/INST]"),
]


def test_chat_format_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as level", "'a' as turns")
    formatted = chat_format.format_chats(rows)
    turns = {}
    for c, t, r, x in sorted(CHATS, key=lambda q: (str(q[0]), q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    for row in formatted.withColumn("turns", chat_format.parse(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns[row["conv_id"]]
        marked = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
        assert len(marked) == sum(r == "assistant" for r, _ in turns[row["conv_id"]])
        if row["level"] == 0:
            assert marked == [x for r, x in turns[row["conv_id"]] if r == "assistant"]
    levels = {r["conv_id"]: r["level"] for r in formatted.collect()}
    assert (levels[1], levels[2], levels[3]) == (0, 1, 2)
    for r in chat_format.digests(formatted).collect():
        mine = turns[r["conv_id"]]
        said = "".join(x for role, x in mine if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_chat_texts_of_control_characters(spark):
    rng = random.Random(1)
    pieces = ["~", "0", "1", "2", "3", "[", "]", "INST", "/", "<", "s", ">", "\n", "[INST]", "</s>", "<chat 0>\n"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for c in range(300) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for r in chat_format.format_chats(df).withColumn("turns", chat_format.parse(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for c, _, a, b in rows if c == r["conv_id"]]


def test_cascade_is_exact():
    rng = random.Random(2)
    for n, share in ((0, 0), (1, 1), (500, 0.1), (500, 0.9), (3000, 0.5)):
        keys = [f"host{i}" for i in range(n)]
        listed = np.array([rng.random() < share for _ in keys], dtype=bool)
        hashes = url_filter._hashes(keys) if keys else np.zeros((0, 2), dtype=np.uint64)
        levels = url_filter.cascade(hashes[listed], hashes[~listed])
        assert (url_filter.listed_by(levels, hashes) == listed).all()


@pytest.mark.parametrize("sent", [url_filter.SENT_BYTES, 200])
def test_membership_in_rounds(spark, sent):
    keys = [(f"k{i}", i % 7 == 0, 1) for i in range(2000)] + [(None, True, 1), ("k3", False, 2)]
    df = spark.createDataFrame(keys, "key string, listed boolean, shard int")
    cascades, shards = url_filter.build(df, shard_keys=100)
    marked = url_filter.mark(df.drop("listed"), "key", cascades, shards, sent_bytes=sent).collect()
    assert len(marked) == len(keys) and all(r["listed"] == (r["key"] is not None and int(r["key"][1:]) % 7 == 0) for r in marked)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://Www.Example.COM/en/7?x", "a://example.com", "a://b.net#x/de/", "a://x.example.net/de/81", "a://net/de/", "a://xnet/de/", "://org/es/#q", "a://u@Q.org/es/a://b", "a://m.free-bets.example.io/q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, catalog._RULES, F.col("host").rlike(catalog._LISTED)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4] == ("example.com", "", None, "allow") and got[5] == ("b.net", "", None, "allow")
    assert got[6] == ("x.example.net", "/de/81", "example.net/de/8", "block") and got[7] == ("net", "/de/", "net/de/", "allow")
    assert got[8] == ("xnet", "/de/", None, "allow") and got[9] == ("org", "/es/", "org/es/", "block")
    assert got[10] == ("u@q.org", "/es/a://b", "org/es/", "block") and got[11] == ("m.free-bets.example.io", "/q", None, "block")
    assert url_filter.judge(pages.limit(0), catalog._RULES, F.lit(False)).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 24)], 1) for i in range(3000)]
    rows += [(3000 + i, rows[i % 3][1], 1) for i in range(60)]  # ties
    rows += [(4000, None, 1), (4100, [1.0, None], 1), (4200, [math.nan, 1.0], 1), (4300, [0.5, -0.5], 1), (4400, [], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    monkeypatch.setattr(top_k, "QUERIES", 16)
    found = top_k.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    data = {i: np.zeros(24) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for i, v, _ in rows:
        if i in data:
            data[i][: len(v)] = np.floor(1024 * np.array(v, dtype=np.float32).astype(float))
    ids = np.array(sorted(data))
    matrix = np.stack([data[i] for i in ids]).astype(np.int64)
    expected = set()
    for q in ids[ids % 100 == 0]:
        scores = matrix @ data[q].astype(np.int64)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:10]
        expected |= {(int(q), k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate(order)}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(0, [1e5, 3.0]), (1, [1e5 + 1 / 1024, -3.0]), (2, [9e4, 1e4])], "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in top_k.top_k(df, df.filter("vec_id = 0")).collect()]
    value = lambda v: [math.floor(1024 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(value(a), value(b), strict=True))
    assert rows == [(0, 1, 1, dot([1e5, 3.0], [1e5 + 1 / 1024, -3.0])), (0, 2, 2, dot([1e5, 3.0], [9e4, 1e4]))]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        bits, levels = perfect_hash.build(keys)
        assert sorted(perfect_hash.slots(keys, bits, levels).tolist()) == list(range(len(keys)))


def test_prefilter(spark):
    df = spark.range(0, 5000).withColumn("h", F.xxhash64("id"))
    bits = prefilter.bits_of(df.filter("id < 50"), "h")
    left = {r["id"] for r in prefilter.may_hold(df, bits, F.col("h")).collect()}
    assert set(range(50)) <= left and len(left) < 100


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    passage = next(r[1] for r in corpus if r[0] == 20)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = step
        step = stage(spark, step, str(tmp_path))
        assert step.columns == before.columns
        path = f"{tmp_path}/{name}"
        step.write.parquet(path)
        step = spark.read.parquet(path)
        kept[name] = Counter(r["doc_id"] for r in step.select("doc_id").collect())
    assert set(kept["language_id"]) == {d for d, t, *_ in corpus if any(c.isalpha() for c in t or "")}
    assert all(n == 1 for d, n in kept["ngram_join"].items() if d is not None)
    assert 20 not in kept["decontaminate"]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(kept["decontaminate"])


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_catalog_names():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and set(catalog.oracle_sql()) < set(names)
