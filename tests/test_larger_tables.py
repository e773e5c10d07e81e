"""Steps that failed or grew too fast on larger tables: plans without their cause, and the same results."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import audit, option_features, tiles
from tidemark.plans import common, options, structures
from tidemark.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_sends_no_table_out(spark):
    have = spark.createDataFrame([("1", "a"), ("1", None), ("2", "B"), (None, "a")], "run_id string, symbol string")
    expected = spark.createDataFrame(
        [("1", "A"), ("1", "B"), ("1", "B"), ("1", None), ("2", "B"), (None, "A")], "run_id string, symbol string"
    )
    missing = audit.coverage(have, ["run_id"], expected, "ERROR", "GONE")
    assert {(r.run_id, r["count"]) for r in missing.collect()} == {("1", 3), (None, 1)}
    assert "Join" not in plan(missing) and "Broadcast" not in plan(missing)


def test_tiles_stay_few_as_assets_grow(spark):
    """A block travels once per tile of its universe."""
    rows = [("A", dt.date(2024, 1, 1 + s), f"{a:04d}", a * 0.01 + s) for a in range(300) for s in range(2)]
    returns = spark.createDataFrame(rows, "universe_id string, session date, asset string, ret double")
    sent = tiles._dealt(returns, F.trunc("session", "year"), 4, [])
    cells = sent.select(F.sum(F.aggregate("cells", F.lit(0), lambda n, c: n + F.size(c["ret"]))).alias("n")).first()["n"]
    assert cells == len(rows) * tiles.FEW
    sums = tiles.pair_sums(returns, tile=4)
    assert sums.count() == 300 * 301 // 2 and sums.agg(F.min("n"), F.max("n")).first()[:] == (2, 2)


def test_missing_symbols_joins_each_symbol_once(spark):
    matrix = spark.createDataFrame([("RUN", day, "A", 1.0) for day in range(50)], "universe_id string, session int, asset string, close double")
    missing = tables.missing_symbols(matrix, spark.createDataFrame([("A",), ("B",), (None,)], "symbol string"))
    assert [r.symbol for r in missing.orderBy("symbol").collect()] == [None, "B"]
    assert "Aggregate(keys=[symbol" in plan(missing).replace("HashAggregate", "Aggregate")


def test_write_once_rerun_is_not_held_to_three_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(structures.tables, "write_once", lambda table, *rest: seen.append(plan(table)) or "EXISTS")
    monkeypatch.setattr(structures.tables, "changed_since", lambda table, *rest: table)
    structures.write_once_ranges(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("REPARTITION_BY_NUM" in p for p in seen)


def test_manifests_are_joined_once_for_all_their_codes(spark, tmp_path):
    raw = spark.createDataFrame([("1", "q", "a"), ("2", "", "b"), ("3", "q", "c"), ("4", "q", "d")], "record_id string, relative_path string, payload_sha256 string")
    norm = spark.createDataFrame([("1", "n", "x", "a"), ("5", None, "y", "b")], "raw_record_id string, relative_path string, normalized_sha256 string, source_payload_sha256 string")
    read = spark.createDataFrame([("1", "a", None, True, "9"), ("3", "c", "z", True, "3")], "record_id string, envelope_sha256 string, actual_sha256 string, readable boolean, envelope_record_id string")
    issues = audit.verify_manifests(raw, norm, read, spark.createDataFrame([("1", "w")], "raw_record_id string, actual_sha256 string"))
    assert {(r.record_id, r.code) for r in issues.collect()} == {
        ("1", "RAW_RECORD_ID_MISMATCH"), ("1", "RAW_PAYLOAD_INVALID"), ("2", "RAW_PATH_MISSING"), ("3", "RAW_PAYLOAD_HASH_MISMATCH"),
        ("4", "RAW_FILE_MISSING"), ("1", "NORMALIZED_HASH_MISMATCH"), ("5", "NORMALIZED_PATH_MISSING"), ("5", "NORMALIZED_WITHOUT_RAW"),
        ("2", "RAW_NOT_NORMALIZED"), ("3", "RAW_NOT_NORMALIZED"), ("4", "RAW_NOT_NORMALIZED"),
    }
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4


def test_contracts_are_prepared_once(spark):
    """Expressions of a contract are not written out again in the checks, and later steps read the kept rows."""
    prepared = options.prepared(spark, "/root/testdata/sf0.001")
    checks = prepared.filter("eligible_contract and is_atm")._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[0]
    assert "l_quantity" not in checks
    assert "lineitem" not in plan(option_features.atm_iv_by_bucket(prepared))


def test_pairs_with_gaps_are_not_taken_one_by_one(spark, monkeypatch):
    """Assets with a gap anywhere: pairs without one in the window are one product, the others go together."""
    rng, days = np.random.default_rng(4), [dt.date(2020 + m // 12, 1 + m % 12, 1) for m in range(30)]
    held = [(d, f"{a:03d}", round(rng.random(), 3)) for a in range(40) for m, d in enumerate(days) if (m * 7 + a) % 19 and (m < 29 or a % 2)]
    returns = spark.createDataFrame([("A", *row) for row in held], "universe_id string, session date, asset string, ret double").coalesce(1)
    marks = spark.createDataFrame([("A", days[m]) for m in (5, 14, 28, 29)], "universe_id string, session date")
    got = {(r.session, r.asset_i, r.asset_j): r.corr for r in tiles.trailing_correlations(returns, 12, marks, tile=64).collect()}
    of = {}
    for d, a, v in held:
        of.setdefault(a, {})[d] = v
    want = {}
    for d in (days[m] for m in (5, 14, 28, 29)):
        for a in of:
            for b in of:
                common = sorted(x for x in of[a] if x in of[b] and x <= d)
                if a < b and d in of[a] and d in of[b]:
                    use = common[-12:]
                    want[d, a, b] = np.corrcoef([of[a][x] for x in use], [of[b][x] for x in use])[0, 1] if len(use) == 12 else None
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())
    shapes, alone = [], tiles._correlations
    monkeypatch.setattr(tiles, "_correlations", lambda x, y: shapes.append((x.shape[1], y.shape[1])) or alone(x, y))
    x = rng.random((30, 9000))
    m = (rng.random(x.shape) < 0.7).astype(float)
    value = tiles._with_gaps(x * m, m, x[:, ::-1] * m, m, 12)
    assert (np.isnan(value) == (m.sum(axis=0) < 12)).all() and not np.isnan(value).all() and not shapes


def test_a_wide_universe_has_few_tiles(spark):
    """Tiles hold as many assets as their returns allow; each part of the pairs is worked out on its own."""
    returns = spark.range(20000).select(F.lit("A").alias("universe_id"), F.lit(dt.date(2024, 1, 1)).alias("session"), F.col("id").cast("string").alias("asset"), F.lit(1.0).alias("ret"))
    sent = tiles._dealt(returns, F.trunc("session", "year"), 16, [])
    assert sent.agg(F.sum(F.size("cells"))).first()[0] == 20000 * tiles.FEW
    pair = tiles._Pair([_block("x", 1500), _block("y", 700)])
    sizes = [(a.stop - a.start) * (b.stop - b.start) for a, b in pair.parts()]
    assert max(sizes) <= tiles.SUB**2 and sum(sizes) == 1500 * 700


def _block(name, assets):
    block = tiles.Block.__new__(tiles.Block)
    block.assets, block.sessions, block.marked = [f"{name}{a}" for a in range(assets)], np.arange(2), None
    block.value = block.there = np.ones((2, assets))
    return block


def test_quick_rounding_is_that_of_the_sql(spark):
    values = [None, 0.0, -0.0, 1.0, -1.0, 0.0078125, -0.0078125, 0.1234565, 0.99999949, -2.5e-7, 5e-7, -5e-7, *np.random.default_rng(2).uniform(-1, 1, 500).tolist()]
    got = [r.v for r in common.rounded_small(spark.createDataFrame([(v,) for v in values], "v double"), 6, "v").collect()]
    want = [r[0] for r in duckdb.sql(f"select round(v, 6) + 0.0::double from (values {', '.join(f'({v!r}::double)' if v is not None else '(null)' for v in values)}) t(v)").fetchall()]
    assert got == want and all(str(v) != "-0.0" for v in got)
