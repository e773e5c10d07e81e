"""What a stream leaves on disk: landed files, shuffle files of its batches, written rows."""

from __future__ import annotations

import time

from tidemark.plans import streams


def test_landed_files_are_compressed_and_batches_keep_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: str(tmp_path / name))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    result = streams.stream_normalize(spark, "/root/testdata/sf0.001")
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    # What remains is the count of a batch's datasets, some rows a task.
    assert sum(p.stat().st_size for p in map(_found(files), left) if p.exists()) < 20_000
    landed = [p.name for p in (tmp_path / "landing").glob("part-*")]
    assert landed and all(name.endswith(".json.gz") for name in landed)
    assert all(".zstd." in p.name for p in (tmp_path / "normalized").rglob("part-*"))
    assert {r.dataset for r in result.collect()} == {"quotes", "movers", "rejected"}


def _found(files):
    from pathlib import Path

    at = {}
    for root in files.localDirsString():
        at |= {p.name: p for p in Path(root).rglob("shuffle_*")}
    return lambda name: at.get(name, Path("/nonexistent"))
