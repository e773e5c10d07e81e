"""What the near-copy join leaves and sends: shuffle files of finished steps, bytes of a signature."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.llm import text as tx
from tidemark.session import cut_lineage


def test_a_written_table_keeps_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    table = cut_lineage(spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_signatures_travel_packed():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    sets = np.repeat(rng.integers(0, 1 << 48, 250).astype(np.uint64), 200)
    keys[200:400] = keys[:200]  # the second set is a copy of the first but for its name
    sent = list(ngram_join._packed(keys, sets, 64))
    size = sum(c.nbytes for b in sent for c in b.columns)
    assert size < 9 * len(keys)  # one row a signature took 24 bytes and more
    got = []
    for row in sent[0].to_pylist():
        key, node = ngram_join._wide(row["keys"], 5), ngram_join._wide(row["sets"], 6)
        got += zip([row["bucket"]] * len(key), key.tolist(), np.repeat(node, np.frombuffer(row["runs"], "<u4")).tolist(), strict=True)
    first = min(sets[0], sets[200])
    kept = [(int(k >> np.uint64(40)) % 64, int(k) % (1 << 40), int(s)) for k, s in zip(keys, sets, strict=True) if s not in (sets[0], sets[200]) or s == first]
    assert sorted(got) == sorted(kept)
    edge = sent[1].to_pylist()
    assert [(ngram_join._wide(e["sets"], 6).tolist(), ngram_join._wide(e["others"], 6).tolist()) for e in edge] == [([first], [max(sets[0], sets[200])])]


def test_sets_with_a_signature_in_common_hang_together(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(3, 60))]
        texts += [" ".join(words), " ".join([*words[:-1], "z"]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    frequent = np.packbits(np.zeros(ngram_join.CELLS, dtype=bool))
    for shingles in (0, 1 << 30):
        edges = {tuple(r) for r in ngram_join.candidate_edges(docs, 3, 80, 100, frequent, shingles).collect()}
        held = {}
        for t in texts:
            s = tx.shingle_set(t.encode(), 3)
            node = int(ngram_join._total(s, 1)) & ((1 << 48) - 1)
            for k in ngram_join._signatures(s, 80, 100).tolist():
                held.setdefault(k, set()).add(node)
        wanted = {(min(v), max(v)) for v in held.values() if len(v) == 2}
        assert wanted and edges == wanted
