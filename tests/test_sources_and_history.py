from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, nested
from tidemark.operators import candidates, history, rebalance
from tidemark.sources import accounts, macro_files, payloads, tables
from tidemark.streaming import ingest

ENVELOPE_FIELDS = [f.name for f in payloads.ENVELOPE.fields]


def envelope(dataset, payload, record_id="r1", captured="2026-01-05T15:00:00Z", **changes):
    body = {
        "schema_version": "1", "source": "provider", "dataset": dataset, "captured_at_utc": captured, "record_id": record_id,
        "request_sha256": "q", "payload_sha256": "p", "request": {}, "payload": payload,
    }
    body.update(changes)
    return body


def frame(spark, *bodies):
    rows = [tuple(json.dumps(b[c]) if isinstance(b.get(c), (dict, list)) else b.get(c) for c in ENVELOPE_FIELDS) for b in bodies]
    return spark.createDataFrame(rows, payloads.ENVELOPE)


def test_envelope_files_are_checked(spark, tmp_path):
    good = envelope("quotes", {"spy": {"quote": {"mark": 500.0}}})
    bad = envelope("quotes", {"a": 1}, "r2")
    del bad["request_sha256"]
    odd = envelope("other", {"a": 1}, "r3")
    for i, body in enumerate((good, bad, odd)):
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
    usable, rejected = payloads.scan_raw_envelopes(spark, str(tmp_path), multiline=True)
    assert [r.record_id for r in usable.collect()] == ["r1"]
    assert {r.record_id: r.reject_reason for r in rejected.collect()} == {
        "r2": "missing request_sha256", "r3": "unsupported dataset other"
    }
    row = payloads.normalize_quotes(usable).first()
    assert row.symbol == "SPY" and row["quote__mark"] == 500.0 and row.raw_record_id == "r1"


def test_option_chain_rows(spark):
    payload = {
        "symbol": "spy",
        "callExpDateMap": {"2026-11-20:42": {"500.0": [{"bid": 1.0, "openInterest": 3}, {"bid": 2.0}], "x": [{"bid": 3.0}]}},
        "putExpDateMap": {"2026-11-20": {"480.0": [{"bid": 4.0}]}},
    }
    rows = payloads.normalize_option_chain(frame(spark, envelope("option_chains", payload))).orderBy("bid").collect()
    assert [(r.put_call, r.expiration_date, r.expiration_dte, r.strike, r.contract_index) for r in rows] == [
        ("CALL", "2026-11-20", 42, 500.0, 0), ("CALL", "2026-11-20", 42, 500.0, 1), ("CALL", "2026-11-20", 42, None, 0),
        ("PUT", "2026-11-20", None, 480.0, 0),
    ]
    assert rows[0].underlying_symbol == "SPY" and rows[0].openInterest == 3


def test_market_hours_shapes(spark):
    payload = {
        "equity": {"EQ": {"isOpen": True, "sessionHours": {"preMarket": [{"start": "1", "end": "2"}], "regularMarket": [{"start": "3", "end": "4"}, {"start": "5", "end": "6"}]}},
                   "EQX": {"isOpen": False}},
        "bond": {"isOpen": False, "sessionHours": {"regularMarket": []}},
    }
    rows = payloads.normalize_market_hours(frame(spark, envelope("market_hours", payload))).collect()
    found = sorted((r.market_group, r.market_key, r.session_type or "", -1 if r.session_index is None else r.session_index) for r in rows)
    assert found == [
        ("bond", "bond", "", -1), ("equity", "EQ", "preMarket", 0), ("equity", "EQ", "regularMarket", 0),
        ("equity", "EQ", "regularMarket", 1), ("equity", "EQX", "", -1),
    ]


def test_schema_inference_and_canonical_text(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"c": "x"}}',), ('{"b": 2, "d": 1.5}',), ("nope",)], "t string")
    assert payloads.infer_record_schema(df, "t").lower().startswith("struct<")
    texts = [r.c for r in df.select(nested.canonical_json(F.col("t")).alias("c")).collect()]
    assert texts == ['{"a":{"c":"x"},"b":1}', '{"b":2,"d":1.5}', None]


def account(spark, *positions, cash=100.0):
    body = {"securitiesAccount": {"currentBalances": {"cashBalance": cash}, "positions": list(positions)}}
    return spark.createDataFrame([("a", json.dumps(body))], "account_id string, payload string")


def position(symbol, long=0.0, short=0.0, value=None, kind="EQUITY", price=None):
    return {"instrument": {"symbol": symbol, "assetType": kind}, "longQuantity": long, "shortQuantity": short, "marketValue": value, "averagePrice": price}


def test_positions(spark):
    df = account(spark, position("aaa ", 5, 2, 30.0), position("AAA", 1, 0, 10.0), position("BBB"), position("CCC", 0, 4, -8.0))
    rows = {r.symbol: (r.quantity, r.market_value) for r in accounts.normalize_positions(df).collect()}
    assert rows == {"AAA": (4.0, 40.0), "CCC": (-4.0, -8.0)}
    assert accounts.normalize_positions_long_only(df).isEmpty()
    assert {r.reason for r in accounts.position_problems(df).collect()} == {"short position", "missing market value"}
    clean = account(spark, position("AAA", 4, 0, None, price=2.5), position("BOND1", 1, 0, 90.0, kind="BOND"))
    held = accounts.normalize_positions_long_only(clean)
    assert {r.symbol: r.market_value for r in held.collect()} == {"AAA": 10.0, "BOND1": 90.0, "CASH": 100.0}
    weights = accounts.priceable(held).collect()
    assert {r.symbol: r.weight for r in weights} == {"AAA": pytest.approx(10 / 110), "CASH": pytest.approx(100 / 110)}
    assert weights[0].pricing_coverage == pytest.approx(110 / 200)


def test_epoch_units(spark):
    out = spark.range(1).select(accounts.epoch_time(F.lit(1767625200)).alias("s"), accounts.epoch_time(F.lit(1767625200000)).alias("ms")).first()
    assert out.s == out.ms


def test_macro_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,VALUE\n2026-01-05,4.5\n2026-01-06,.\nbad,1\n2026-01-07,x\n2026-01-08,4.75\n")
    rows = macro_files.scan_series(spark, str(tmp_path / "s.csv"), "yield_2y").collect()
    assert [(str(r.obs_date), r.value) for r in rows] == [("2026-01-05", 4.5), ("2026-01-08", 4.75)]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, f"s{i % 7}", None if i % 5 == 0 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    base = hashing.table_fingerprint(df, ["a", "b", "c"]).first()
    assert hashing.table_fingerprint(df.repartition(7).orderBy(F.desc("a")), ["a", "b", "c"]).first() == base
    for other in (df.filter("a > 0"), df.union(df.filter("a = 3")), df.withColumn("c", F.when(F.col("a") == 9, 0.0).otherwise(F.col("c")))):
        assert hashing.table_fingerprint(other, ["a", "b", "c"]).first() != base


def test_appends(spark, tmp_path):
    path = str(tmp_path / "history")
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v double, t string")
    assert history.idempotent_append(path, make((1, 1.0, "a"), (2, 2.0, "b")), ["k"]) == history.AppendReport("APPENDED", 2, 2)
    assert history.idempotent_append(path, make((2, 2.0 + 1e-13, "b"), (3, 3.0, "c")), ["k"]).appended_rows == 1
    assert history.idempotent_append(path, make((1, 1.0, "a")), ["k"]).status == "EXISTS"
    assert history.idempotent_append(path, make((9, 1.0, "a")), ["k"], dry_run=True).status == "DRY_RUN"
    with pytest.raises(history.HistoryConflict):
        history.idempotent_append(path, make((1, 1.5, "a"), (7, 1.0, "z")), ["k"])
    with pytest.raises(history.HistoryConflict):
        history.idempotent_append(path, make((8, 1.0, "a"), (8, 1.0, "a")), ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert history.ledger_append(path, make((1, 1.0, "a")).withColumnRenamed("t", "generated_at_utc").withColumn("t", F.lit("a")).drop("generated_at_utc"), ["k"]).status == "EXISTS"


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "once")
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    assert tables.write_once(df, path) == "CREATED"
    assert tables.write_once(df.orderBy(F.desc("id")), path) == "EXISTS"
    with pytest.raises(tables.ContentChanged):
        tables.write_once(df.withColumn("v", F.col("id")), path)
    assert tables.write_matrix(df, str(tmp_path / "m")) == {"rows": 50, "columns": 2}


def test_execution_targets_case(spark):
    allocation = spark.createDataFrame([("s", "AAA", 1, 0.6, 100.0), ("s", "BBB", 2, 0.4, 90000.0)], "k string, symbol string, scanner_rank int, target_weight double, close double")
    held = spark.createDataFrame([("s", "aaa", 40, 99.0), ("s", "CCC", 5, 50.0)], "k string, symbol string, current_position int, reference_price double")
    capital = spark.createDataFrame([("s", 10000.0)], "k string, portfolio_capital double")
    out = {r.symbol: r for r in rebalance.execution_targets(allocation, held, capital, ["k"]).collect()}
    assert (out["AAA"].target_shares, out["AAA"].trade_side, out["AAA"].reference_price) == (60, "BUY", 100.0)
    assert (out["BBB"].target_status, out["BBB"].trade_side) == ("ROUNDING_TO_ZERO", "HOLD")
    assert (out["CCC"].target_status, out["CCC"].share_delta, out["CCC"].reference_price_source) == ("EXIT", -5, "position_snapshot")


def plan_loop(shares, cash, prices, weights, bps):
    """Step-by-step repair used as the check: one share at a time."""
    names = sorted(prices)
    value = sum(shares[a] * prices[a] for a in names) + cash
    target = {a: int(weights[a] * value // prices[a]) for a in names}

    def left():
        trade = {a: target[a] - shares[a] for a in names}
        return cash - sum(trade[a] * prices[a] for a in names) - sum(abs(trade[a]) * prices[a] for a in names) * bps / 1e4

    while left() < -1e-8:
        buys = [a for a in names if target[a] > shares[a]]
        pick = min(buys, key=lambda a: (abs(weights[a] * value - (target[a] - 1) * prices[a]) - abs(weights[a] * value - target[a] * prices[a]), a))
        target[pick] -= 1
    return target, left()


def test_repair_matches_the_one_share_loop(spark):
    rng = random.Random(4)
    books = {}
    for k in range(60):
        # Quarter-dollar prices keep the one-share error of an asset exactly its price.
        prices_k = {a: rng.randint(8, 400) / 4 for a in "ABCDE"}
        books[f"acc{k}"] = ({a: rng.choice([0, rng.randint(0, 3000)]) for a in "ABCDE"}, rng.choice([0.0, 1.0, 40.0]), prices_k)
    prices = {a: books["acc0"][2][a] for a in "ABCDE"}
    weights = {"A": 0.25, "B": 0.125, "C": 0.25, "D": 0.125, "E": 0.25}
    out = rebalance.rebalance_plan(
        spark.createDataFrame([(n, a, s) for n, (h, _, _) in books.items() for a, s in h.items()], "account_id string, asset string, shares int"),
        spark.createDataFrame([(n, c) for n, (_, c, _) in books.items()], "account_id string, cash double"),
        spark.createDataFrame(list(prices.items()), "asset string, price double"),
        spark.createDataFrame([(n, a, w) for n in books for a, w in weights.items()], "account_id string, asset string, target_weight double"),
        200.0,
    )
    rows = out.collect()
    assert sum(r.removed_shares for r in rows) > 0
    for name, (held, cash, _) in books.items():
        if not any(held.values()) and cash == 0.0:
            # Nothing to plan with.
            assert all(r.account_id != name for r in rows)
            continue
        target, left = plan_loop(held, cash, prices, weights, 200.0)
        mine = {r.asset: r.target_shares for r in rows if r.account_id == name}
        assert mine == target, name
        assert next(r.cash_after for r in rows if r.account_id == name) == pytest.approx(left, abs=1e-6)
    assert rebalance.plan_violations(out).isEmpty()
    summary, detail = rebalance.plan_tables(out, {"model_version": "v1"})
    planned = len({r.account_id for r in rows})
    assert summary.count() == planned and detail.count() == 5 * planned
    assert summary.select("order_plan_hash").distinct().count() == planned


def candidate_rows(n=3, **changes):
    rows = []
    for i in range(1, n + 1):
        row = dict(zip(candidates.CANDIDATE_COLUMNS, [
            candidates.HANDOFF_VERSION, candidates.ALPHA_SPEC_VERSION, "provider", "2026-01-05", "2026-01-05 22:00:00", "snap", "m",
            "2026-01-05 20:00:00", f"S{i}", i, 1.0 * i, 90.0, "true", 10.0, candidates.PRIMARY_SIGNAL, 0.5, None]))
        rows.append(row)
    for key, value in changes.items():
        rows[-1][key] = value
    return rows


CANDIDATE_DDL = ", ".join(
    f"{c} {'int' if c == 'scanner_rank' else 'double' if c in ('scanner_score', 'scanner_percentile', 'close', 'primary_signal_value', 'ema_50_to_200') else 'string'}"
    for c in candidates.CANDIDATE_COLUMNS
)


@pytest.mark.parametrize("change,codes", [
    ({}, set()),
    ({"symbol": "s1"}, {"DUPLICATE_SYMBOL"}),
    ({"scanner_rank": 5}, {"RANKS_NOT_CONTIGUOUS"}),
    ({"scanner_rank": 2}, {"DUPLICATE_RANK", "RANKS_NOT_CONTIGUOUS"}),
    ({"close": -1.0}, {"CLOSE_NOT_POSITIVE"}),
    ({"scanner_percentile": 101.0}, {"PERCENTILE_OUT_OF_RANGE"}),
    ({"scanner_eligible": "no"}, {"NOT_ELIGIBLE"}),
    ({"source_timestamp_utc": "2026-01-05 23:00:00"}, {"TIMESTAMP_AFTER_GENERATION"}),
    ({"source_timestamp_utc": "2026-01-04 20:00:00"}, {"TIMESTAMP_OUTSIDE_SESSION"}),
    ({"scanner_score": float("nan")}, {"SCORE_NOT_FINITE"}),
])
def test_candidate_rules(spark, change, codes):
    df = spark.createDataFrame([tuple(r[c] for c in candidates.CANDIDATE_COLUMNS) for r in candidate_rows(**change)], CANDIDATE_DDL)
    assert candidates.column_violations(df) == []
    assert {r.rule for r in candidates.validate_candidates(df).collect()} == codes


def test_stream_keeps_late_records_and_drops_repeats(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    quote = lambda i, at: json.dumps(envelope("quotes", {f"s{i}": {"quote": {"mark": 1.0 * i}}}, f"r{i}", at) | {"payload": {f"s{i}": {"quote": {"mark": 1.0 * i}}}})
    (landing / "1.json").write_text("\n".join([quote(1, "2026-01-05T15:00:00Z"), quote(2, "2026-01-05T15:01:00Z"), quote(1, "2026-01-05T15:00:00Z")]))

    def run():
        ingest.stream_normalize(ingest.read_envelopes(spark, str(landing)), out, str(tmp_path / "ckpt")).awaitTermination()
        return sorted(r.raw_record_id for r in spark.read.parquet(f"{out}/quotes").collect())

    assert run() == ["r1", "r2"]
    # A record captured days earlier and a repeat of a known one arrive together.
    (landing / "2.json").write_text("\n".join([quote(3, "2026-01-01T15:00:00Z"), quote(2, "2026-01-05T15:01:00Z")]))
    assert run() == ["r1", "r2", "r3"]


def test_stream_history_sets_conflicts_aside(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "hist")
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v double")
    for part in (make((1, 1.0), (2, 2.0)), make((2, 2.0), (3, 3.0)), make((1, 9.0), (4, 4.0))):
        part.coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema("k int, v double").parquet(landing)
        ingest.stream_append_history(source, path, str(tmp_path / "ckpt"), ["k"]).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]
    assert [r.k for r in spark.read.parquet(f"{path}_conflicts").collect()] == [1]
