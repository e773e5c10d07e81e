from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, option_features, option_quality, option_run, profiling, quantiles, validation

CONTRACT = (
    "run_id string, underlying_symbol string, put_call string, strike double, expiration_date date, expiration_dte int, "
    "bid double, ask double, mark double, volatility double, delta double, gamma double, theta double, vega double, "
    "openInterest long, totalVolume long, quoteTimeInLong long, raw_captured_at_utc string, contract_index int"
)
CAPTURED, MILLIS = "2026-01-05 15:00:00", 1767625200000


def contract(day, symbol="SPY", side="CALL", strike=500.0, dte=14, iv=20.0, delta=0.25, index=0, **changes):
    row = dict(
        run_id="R", underlying_symbol=symbol, put_call=side, strike=strike, expiration_date=day("2026-01-19"), expiration_dte=dte,
        bid=1.0, ask=1.1, mark=1.05, volatility=iv, delta=delta, gamma=0.01, theta=-0.1, vega=0.2, openInterest=10,
        totalVolume=5, quoteTimeInLong=MILLIS - 60_000, raw_captured_at_utc=CAPTURED, contract_index=index,
    )
    row.update(changes)
    return tuple(row[c.split()[0]] for c in CONTRACT.split(", "))


def prepare(spark, rows, quotes=(("R", "SPY", 500.0, 0), ("R", "TLT", 100.0, 1))):
    spots = option_features.spot_map(spark.createDataFrame(quotes, "run_id string, symbol string, quote__mark double, quote_row int"))
    return option_features.prepare_contracts(spark.createDataFrame(rows, CONTRACT), spots)


def test_contract_checks(spark, day):
    rows = [
        contract(day),
        contract(day, index=1, bid=0.0),
        contract(day, index=2, ask=0.9),
        contract(day, index=3, dte=0, quoteTimeInLong=MILLIS - 31 * 60_000),
        contract(day, index=4, symbol="XXX", delta=1.5, volatility=None),
        contract(day, index=5, side="PUT", strike=520.0, delta=-0.3),
    ]
    out = {r.contract_index: r for r in prepare(spark, rows).collect()}
    assert out[0].eligible_contract and out[0].ineligibility_reasons == "" and out[0].quote_age_minutes == pytest.approx(1.0)
    assert out[1].ineligibility_reasons == "bid|spread"
    assert out[2].ineligibility_reasons == "ask|mark"
    assert out[3].ineligibility_reasons == "quote_age|dte"
    assert out[4].ineligibility_reasons == "spot|volatility|delta"
    assert out[5].canonical_intrinsic_value == 20.0 and out[5].signed_moneyness_pct == pytest.approx(4.0)


def test_spot_choice_is_by_schema_and_last_duplicate_wins(spark):
    table = spark.createDataFrame(
        [("R", "spy", 1.0, 500.0, 0), ("R", "SPY ", 2.0, 501.0, 1), ("R", "TLT", None, 100.0, 2)],
        "run_id string, symbol string, quote__lastPrice double, quote__closePrice double, quote_row int",
    )
    assert option_features.price_column(table) == "quote__lastPrice"
    rows = option_features.spot_map(table).collect()
    assert [(r.underlying_symbol, r.spot) for r in rows] == [("SPY", 2.0)]
    assert option_features.duplicate_quote_symbols(table).count() == 1


def test_matched_skew_does_not_mix_maturities(spark, day):
    near, far = day("2026-01-19"), day("2026-06-19")
    rows = [
        contract(day, iv=20.0, delta=0.25, index=0, expiration_date=near),
        contract(day, iv=99.0, delta=0.40, index=1, expiration_date=near),
        contract(day, side="PUT", iv=26.0, delta=-0.26, index=2, expiration_date=near),
        contract(day, iv=30.0, delta=0.20, index=3, expiration_date=far, dte=165),
    ]
    out = option_features.symbol_option_features(prepare(spark, rows)).first()
    assert out.delta_25_put_call_iv_skew_matched_median == pytest.approx(6.0)
    assert out.delta_25_expiration_pair_count == 1
    assert out.delta_25_put_call_iv_skew_dte_8_30 == pytest.approx(6.0) and out.delta_25_pair_count_dte_91_365 == 0
    assert out.delta_25_put_call_iv_skew_dte_91_365 is None
    assert out.atm_iv_term_spread_91_365_minus_8_30 == pytest.approx(30.0 - 26.0)


def test_nearest_delta_tie_takes_the_first_row(spark, day):
    rows = [
        contract(day, iv=40.0, delta=0.30, index=1),
        contract(day, iv=50.0, delta=0.30, index=0),
        contract(day, side="PUT", iv=60.0, delta=-0.25, index=2),
    ]
    out = option_features.matched_delta_skew(prepare(spark, rows)).filter("scope = 'all'").first()
    assert out.call_iv == 50.0


def feature_row(**changes):
    row = {"run_id": "R", "underlying_symbol": "SPY", "eligible_contract_ratio": 0.9, "contract_count_eligible": 200,
           "eligible_expiration_count": 12, "atm_contract_count_dte_8_30": 25, "atm_contract_count_dte_91_365": 25}
    for name, (support, minimum, _) in option_quality.FEATURE_RULES.items():
        row.setdefault(support, minimum)
    for name in option_quality.MODEL_FEATURES:
        row[name] = 1.5
    row.update(changes)
    return row


def test_quality_gates(spark):
    rows = [
        feature_row(),
        feature_row(underlying_symbol="TLT", eligible_contract_ratio=0.7, atm_contract_count_dte_91_365=19),
        feature_row(underlying_symbol="GLD", contract_count_eligible=49),
    ]
    df = spark.createDataFrame(rows)
    masked = {r.underlying_symbol: r for r in option_quality.feature_support_mask(df).collect()}
    assert (masked["SPY"].quality_symbol_status, masked["TLT"].quality_symbol_status) == ("PASS", "CAUTION")
    assert masked["TLT"].quality_symbol_reasons == "eligible_contract_ratio_below_pass"
    assert masked["GLD"].quality_symbol_status == "SUPPRESS" and masked["GLD"].iv_median is None
    assert masked["SPY"].atm_iv_term_spread_91_365_minus_8_30 == 1.5
    # The term spread needs both buckets, the far bucket's own feature just its own.
    assert masked["TLT"].atm_iv_term_spread_91_365_minus_8_30 is None and masked["TLT"].atm_iv_median_dte_91_365 is None
    assert masked["TLT"].atm_iv_median_dte_8_30 == 1.5
    quality = option_quality.feature_quality(df)
    assert quality.count() == 3 * len(option_quality.MODEL_FEATURES)
    bad = quality.filter("underlying_symbol = 'TLT' and not usable").collect()
    assert {r.reason for r in bad} == {"insufficient_feature_support", "insufficient_term_structure_support"}


def test_percentiles_of_skewed_and_null_groups(spark):
    rng = np.random.default_rng(1)
    heavy = [("hot", float(x)) for x in np.round(rng.lognormal(0, 2, 20000), 3)]
    rows = heavy + [("hot", 1.0)] * 7000 + [("one", 5.0)] + [("two", 1.0), ("two", 2.0)] + [("none", None)] + [(None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.99, 1.0]
    out = {r.k: r.percentiles for r in quantiles.grouped_percentiles(df, ["k"], "v", probs).collect()}
    hot = np.array([v for k, v in rows if k == "hot"])
    assert np.allclose(out["hot"], np.quantile(hot, probs), atol=1e-12)
    assert out["one"] == [5.0] * 5 and out["two"][2] == pytest.approx(1.5) and "none" not in out
    assert out[None][2] == pytest.approx(6.0)
    medians = {r.k: r.m for r in quantiles.grouped_medians(df, ["k"], {"m": F.col("v")}).collect()}
    assert medians["two"] == pytest.approx(1.5) and medians["none"] is None and medians[None] == pytest.approx(6.0) and medians["hot"] == pytest.approx(np.median(hot))


def test_validation_rules_and_status(spark, day):
    rows = [contract(day, index=i) for i in range(3)] + [contract(day, index=9, bid=2.0, ask=1.0, mark=1.5, gamma=-1.0)]
    issues = validation.validate_options(prepare(spark, rows))
    codes = {r.code: (r.level, r["count"]) for r in issues.collect()}
    assert codes["CROSSED_OPTION_MARKET"] == ("ERROR", 1) and codes["NEGATIVE_OPTION_GAMMA"] == ("ERROR", 1)
    assert "CONSTANT_OPTION_RESEARCH_FIELD" in codes
    assert validation.validation_status(issues, ["run_id"]).first().status == "FAIL"
    runs = spark.createDataFrame([("R",), ("S",)], "run_id string")
    assert {r.run_id: r.status for r in validation.gated_runs(issues, runs).collect()} == {"R": "FAIL", "S": "PASS"}


def test_audit_finds_disorder(spark):
    rows = [("r", "A", 2, 10.0, 11.0, 9.0, 10.0, 5, 0), ("r", "A", 1, 10.0, 9.0, 11.0, 10.0, -5, 1), ("r", "A", 1, 10.0, 11.0, 9.0, 10.0, 5, 2)]
    df = spark.createDataFrame(
        rows, "raw_record_id string, symbol string, datetime long, open double, high double, low double, close double, volume long, candle_index int"
    ).withColumn("run_id", F.lit("x"))
    codes = {r.code: r["count"] for r in audit.audit_price_history(df, ["run_id"]).collect()}
    assert codes == {"DUPLICATE_CANDLE_TIMESTAMP": 1, "OHLC_INVARIANT_VIOLATION": 1, "NEGATIVE_VOLUME": 1, "CANDLES_NOT_CHRONOLOGICAL": 1}


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", "2026-01-05"), (2, None, "2026-01-06"), (2, "b", "x")], "n int, t string, seen_date string")
    profile = {r.column: r for r in profiling.column_profile(df).collect()}
    assert (profile["n"].unique_count, profile["n"].median, profile["t"].null_count) == (2, 2.0, 1)
    assert [r.column for r in profiling.sparse_columns(profiling.column_profile(df)).collect()] == ["t"]
    assert profiling.datetime_profile(df).count() == 0
    assert profiling.datetime_profile(df.filter("n = 1")).first().parse_rate_pct == 100.0


def test_option_run_is_gated_and_appended_once(spark, day, tmp_path):
    rows = [contract(day, index=i, iv=20.0 + i, side=("CALL", "PUT")[i % 2], delta=0.25 if i % 2 == 0 else -0.25) for i in range(6)]
    bad = [contract(day, index=i, run_id="BAD", bid=5.0) for i in range(2)]
    table = spark.createDataFrame(rows + bad, CONTRACT)
    quotes = spark.createDataFrame(
        [("R", "SPY", 500.0, 499.0, 501.0, 1.0, 0), ("BAD", "SPY", 500.0, 499.0, 501.0, 1.0, 0)],
        "run_id string, symbol string, quote__mark double, quote__bidPrice double, quote__askPrice double, quote_age_minutes double, quote_row int",
    )
    masked, status = option_run.build_option_features(table, quotes)
    assert {r.run_id: r.status for r in status.collect()}["BAD"] == "FAIL"
    assert [r.run_id for r in masked.collect()] == ["R"]
    path = str(tmp_path / "history")
    assert option_run.append_option_history(masked, CAPTURED, path).status == "APPENDED"
    assert option_run.append_option_history(masked, CAPTURED, path).status == "EXISTS"


def test_manifest_and_run_codes(spark):
    raw = spark.createDataFrame([(k, f"q/{k}", "h") for k in "abcde"], "record_id string, relative_path string, payload_sha256 string")
    normalized = spark.createDataFrame(
        [(k, f"n/{k}", "t", "h") for k in "abcd"], "raw_record_id string, relative_path string, normalized_sha256 string, source_payload_sha256 string"
    )
    envelopes = spark.createDataFrame(
        [("a", "h", "h", True, "a"), ("b", "h", "h", True, "z"), ("c", None, None, False, None), ("d", "h", None, True, "d")],
        "record_id string, envelope_sha256 string, actual_sha256 string, readable boolean, envelope_record_id string",
    )
    tables = spark.createDataFrame([(k, "t") for k in "abc"], "raw_record_id string, actual_sha256 string")
    codes = sorted((r.record_id, r.code) for r in audit.verify_manifests(raw, normalized, envelopes, tables).collect())
    assert codes == [
        ("b", "RAW_RECORD_ID_MISMATCH"), ("c", "RAW_FILE_INVALID"), ("d", "NORMALIZED_FILE_MISSING"), ("d", "RAW_PAYLOAD_INVALID"),
        ("e", "RAW_FILE_MISSING"), ("e", "RAW_NOT_NORMALIZED"),
    ]
    artifact = "struct<dataset: string, scope: string, raw_record_id: string, normalized_record_id: string, relative_path: string>"
    summary = spark.createDataFrame(
        [("run", 5, [("quotes", "s", "a", "a", "n/a"), ("quotes", "s", "d", "d", "n/d"), ("quotes", "s", None, "a", "n/a"), None])],
        f"run_id string, artifact_count int, artifacts array<{artifact}>",
    )
    found = {r.code: r["count"] for r in audit.audit_run(summary, raw, normalized, ["quotes"], tables).collect()}
    assert found == {
        "RUN_ARTIFACT_COUNT_MISMATCH": 1, "RUN_ARTIFACT_INVALID": 1, "RUN_ARTIFACT_PROVENANCE_INVALID": 1, "RUN_NORMALIZED_FILE_MISSING": 1,
    }
    assert audit.unsummarised_captures(raw, summary).isEmpty()
    assert audit.unsummarised_captures(raw, summary.filter("false")).first().code == "NO_CAPTURE_RUN_SUMMARY"


def test_schema_and_empty_codes(spark):
    quotes = spark.createDataFrame([("R", "SPY")], "run_id string, symbol string")
    assert audit.required_columns(quotes, ["run_id"], "quotes").first().code == "MISSING_COLUMNS"
    assert audit.required_columns(quotes.withColumn("raw_record_id", F.lit("r")), ["run_id"], "quotes").isEmpty()
    runs = spark.createDataFrame([("R",), ("S",)], "run_id string")
    assert [r.run_id for r in validation.empty_dataset(runs, quotes, "quotes").collect()] == ["S"]
    assert validation.price_history_columns(quotes).first().code == "PRICE_HISTORY_REQUIRED_COLUMNS_MISSING"
    assert validation.price_history_columns(quotes.withColumn("datetime_utc", F.lit("x"))) is None
