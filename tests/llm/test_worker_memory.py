"""What reused Python workers keep, and how many of them a task takes."""

from __future__ import annotations

import os
import subprocess
import sys

from tidemark.llm import ngram_join

HELD = """
import numpy as np
from tidemark.llm import text as tx

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

@tx.lean
def task(batches):
    arrays = [np.ones(8000) for _ in range(3000)]
    kept.append(bytearray(5000))  # above them in the heap
    yield from batches

kept, before = [], mb()
assert list(task(iter([1, 2]))) == [1, 2]
print(mb() - before)
"""


def test_a_finished_task_gives_its_memory_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert float(done.stdout) < 60


def test_member_sets_take_one_worker_for_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "doc_id long, text string")
    members = spark.createDataFrame([(1, 2, 5, 5)], "doc_id long, n long, f1 long, block long")
    rows = ngram_join._member_sets(docs, members, 3)
    rows.collect()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
