"""The stream of envelopes: which batches are held against what has been written."""

from __future__ import annotations

import json

import pytest

from tidemark.streaming import ingest


def quote(record_id, payload='{"s": {"quote": {"mark": 1.0}}}'):
    fields = ("schema_version", "source", "dataset", "captured_at_utc", "request_sha256", "payload_sha256", "request")
    return json.dumps(dict.fromkeys(fields, "x") | {"dataset": "quotes", "record_id": record_id, "payload": payload})


@pytest.fixture
def landed(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()

    def run(checkpoint="ckpt", **files):
        for name, lines in files.items():
            (landing / f"{name}.json").write_text("\n".join(lines))
        ingest.stream_normalize(ingest.read_envelopes(spark, str(landing), max_files=1), out, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r.raw_record_id for r in spark.read.parquet(f"{out}/quotes").collect())

    run.rejected = lambda: sorted((r.record_id or "", r.payload) for r in spark.read.parquet(f"{out}/rejected").collect())
    return run


def test_batches_of_a_run_do_not_read_what_was_written(landed, monkeypatch):
    read = []
    monkeypatch.setattr(ingest, "new_rows", lambda *a: read.append(a) or pytest.fail("history was read"))
    assert landed(a=[quote("r1"), quote("r2")], b=[quote("r2"), quote("r3")], c=[quote("r1"), quote("r4")]) == ["r1", "r2", "r3", "r4"]
    assert not read


def test_a_batch_written_in_part_is_completed(landed, monkeypatch):
    whole = ingest._append

    def fails(rows, path, keys):
        if path.endswith("rejected"):
            raise RuntimeError("stopped")
        whole(rows, path, keys)

    monkeypatch.setattr(ingest, "_append", fails)
    with pytest.raises(Exception, match="stopped"):
        landed(a=[quote("r1"), quote("bad", "{"), quote(None, "1"), quote(None, "2"), quote(None, "2")])
    monkeypatch.setattr(ingest, "_append", whole)
    assert landed() == ["r1"]
    assert landed.rejected() == [("", "1"), ("", "2"), ("bad", "{")]
    assert landed(b=[quote("r1"), quote("r2")]) == ["r1", "r2"]


def test_output_older_than_the_checkpoint_counts(landed):
    landed(a=[quote("r1")], b=[quote("r2")])
    assert landed("other", c=[quote("r3")]) == ["r1", "r2", "r3"]
    assert landed("other", d=[quote("r2")], e=[quote("r1"), quote("r4")]) == ["r1", "r2", "r3", "r4"]
