"""Queries on profiles, validation and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import audit, option_features, profiling, validation
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.plans.options import PREPARED_SQL, features, prepared
from tidemark.session import cut_lineage
from tidemark.sources import harness, harness_options, harness_payloads, payloads

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_LINE]
_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]
_PROBS = dict(zip(profiling.PROBABILITY_NAMES, profiling.PROBABILITIES))


def _line_long(columns) -> str:
    return " union all ".join(f"select '{c}' as column_name, {c}::double as v from lineitem" for c in columns)


@register(
    "quantile_profile",
    f"""with long as ({_line_long(_PROFILED)})
    select column_name as "column", {", ".join(r(f"quantile_cont(v, {p})", 6, n) for n, p in _PROBS.items())}
    from long group by column_name""",
)
def quantile_profile(spark, sf):
    rows = profiling.quantile_profile(harness.read(spark, sf, "lineitem"), _PROFILED)
    return rounded(rows, 6, *_PROBS)


@register(
    "quantile_profile_sliced",
    f"""with long as (
      select o_orderstatus, 'o_totalprice' as c, o_totalprice as v from orders)
    select o_orderstatus, c as "column", {", ".join(r(f"quantile_cont(v, {p})", 6, n) for n, p in _PROBS.items())}
    from long group by o_orderstatus, c""",
)
def quantile_profile_sliced(spark, sf):
    """A group key with few, very large groups."""
    rows = profiling.quantile_profile(harness.read(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus"])
    return rounded(rows, 6, *_PROBS)




@register(
    "column_profile",
    f"""with long as ({_line_long(_PROFILED)}),
    n as (
      select column_name, count(*) as rows, count(v) as non_null_count, count(distinct v) as unique_count, min(v) as min,
             max(v) as max, avg(v) as mean, median(v) as median from long group by column_name
      union all select 'l_returnflag', count(*), count(l_returnflag), count(distinct l_returnflag), null, null, null, null from lineitem
      union all select 'l_linestatus', count(*), count(l_linestatus), count(distinct l_linestatus), null, null, null, null from lineitem
      union all select 'l_shipdate', count(*), count(l_shipdate), count(distinct l_shipdate), null, null, null, null from lineitem)
    select column_name as "column", rows, non_null_count, unique_count, {", ".join(r(c, 4) for c in ("min", "max", "mean", "median"))},
           round(100.0::double * non_null_count / rows, 4) as non_null_pct, rows - non_null_count as null_count,
           false as is_provenance from n""",
)
def column_profile(spark, sf):
    table = harness.read(spark, sf, "lineitem").select(*_PROFILED, *_TEXTS)
    return rounded(profiling.column_profile(table), 4, "min", "max", "mean", "median")


@register(
    "sparse_columns",
    """select 'bid_or_null' as "column", round(100.0::double * count(case when l_linenumber <> 7 then l_quantity end) / count(*), 4)
              as non_null_pct from lineitem
       union all select 'half', round(100.0::double * count(case when l_returnflag <> 'A' then 1 end) / count(*), 4) from lineitem""",
)
def sparse_columns(spark, sf):
    lineitem = harness.read(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("bid_or_null"),
        F.when(F.col("l_returnflag") != "A", F.lit(1)).alias("half"),
        "l_tax",
    )
    return profiling.sparse_columns(profiling.column_profile(lineitem))


@register(
    "datetime_profile",
    """with t as (
      select 'order_date' as c, count(*) as n, count(o_orderdate) as k, min(o_orderdate) as lo, max(o_orderdate) as hi from orders
      union all select 'epoch_time', count(*), count(*), min(o_orderdate), max(o_orderdate) from orders)
    select c as "column", round(100.0::double * k / n, 4) as parse_rate_pct, lo as min_utc, hi as max_utc from t""",
)
def datetime_profile(spark, sf):
    table = harness.read(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        (F.unix_timestamp("o_orderdate") * 1000).alias("epoch_time"),
        F.col("o_custkey").alias("lead_time"),
        F.col("o_orderpriority").alias("update_text"),
    )
    rows = profiling.datetime_profile(table)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_utc", "max_utc")})


@register(
    "option_dataset_summary",
    f"""with {harness_options.CONTRACTS_SQL}
    select underlying_symbol as symbol, put_call, count(*) as rows, count(distinct expiration_date) as expiration_count,
      min(expiration_date) as expiration_min, max(expiration_date) as expiration_max, min(expiration_dte) as dte_min,
      max(expiration_dte) as dte_max, min(strike) as strike_min, max(strike) as strike_max,
      100.0::double as bid_non_null_pct, 100.0::double as volatility_non_null_pct from contracts group by all""",
)
def option_dataset_summary(spark, sf):
    return profiling.option_dataset_summary(harness_options.contracts(spark, sf), ["bid", "volatility", "rho"])


@register(
    "price_dataset_summary",
    """select 'L' || l_linenumber as symbol, count(*) as rows, min(l_shipdate) as start_utc, max(l_shipdate) as end_utc,
              count(*) filter (l_partkey % 10 = 0) as zero_volume_count,
              round(100.0::double * (count(*) filter (l_partkey % 10 = 0)) / count(*), 6) + 0.0::double as zero_volume_pct
       from lineitem group by l_linenumber""",
)
def price_dataset_summary(spark, sf):
    history = harness.read(spark, sf, "lineitem").select(
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("datetime_utc"),
        (F.col("l_partkey") % 10).alias("volume"),
    )
    return rounded(profiling.price_dataset_summary(history), 6, "zero_volume_pct")


def _options(spark, sf):
    return harness_options.contracts(spark, sf)


def _issue_sql(rules: list[tuple[str, str, str]], source: str, dataset: str) -> str:
    return " union all ".join(
        f"""select run_id, '{level}' as level, '{code}' as code, '{dataset}' as dataset,
        count(*) filter ({cond}) as count, 100.0::double * (count(*) filter ({cond})) / count(*) as percentage
        from {source} group by run_id having count(*) filter ({cond}) > 0"""
        for level, code, cond in rules
    )


_OPTION_RULES = [
    ("ERROR", "NEGATIVE_OPTION_BID_ASK", "bid < 0 or ask < 0"),
    ("ERROR", "CROSSED_OPTION_MARKET", "bid > ask"),
    ("WARNING", "OPTION_MARK_OUTSIDE_BID_ASK", "mark < bid - 1e-8 or mark > ask + 1e-8"),
    ("WARNING", "WIDE_OPTION_SPREAD", "spread > 25"),
    ("WARNING", "ZERO_OPTION_BID", "bid = 0"),
    ("ERROR", "NONPOSITIVE_OPTION_IV", "volatility <= 0"),
    ("ERROR", "OPTION_DELTA_OUT_OF_RANGE", "abs(delta) > 1.000001"),
    ("ERROR", "NEGATIVE_OPTION_GAMMA", "gamma < 0"),
    ("ERROR", "NEGATIVE_OPTION_VEGA", "vega < 0"),
    ("WARNING", "ZERO_DTE_OPTIONS_PRESENT", "expiration_dte = 0"),
    ("WARNING", "STALE_OPTION_QUOTE", "quote_age_minutes > 30"),
    ("WARNING", "EXTREME_OPTION_PERCENT_CHANGE", "abs(percent_change) > 1000"),
]
_OPTION_ISSUES_SQL = f"""{PREPARED_SQL}, issues as ({_issue_sql(_OPTION_RULES, "prepared", "option_chains")})"""


@register(
    "validate_options",
    f"with {_OPTION_ISSUES_SQL} select run_id, level, code, dataset, count, {r('percentage', 6)} from issues",
)
def validate_options(spark, sf):
    return rounded(validation.validate_options(_options(spark, sf)), 6, "percentage")


@register(
    "validate_options_with_errors",
    f"""with {PREPARED_SQL},
    bent as (
      select * replace (case when contract_index = 6 then -ask else ask end as ask,
                        case when contract_index = 5 then delta * 3 else delta end as delta,
                        case when contract_index = 4 then -gamma else gamma end as gamma) from prepared),
    issues as ({_issue_sql([x for x in _OPTION_RULES if x[1] in (
        "NEGATIVE_OPTION_BID_ASK", "CROSSED_OPTION_MARKET", "OPTION_MARK_OUTSIDE_BID_ASK", "OPTION_DELTA_OUT_OF_RANGE",
        "NEGATIVE_OPTION_GAMMA")], "bent", "option_chains")})
    select run_id, level, code, count from issues""",
)
def validate_options_with_errors(spark, sf):
    """The same rules on rows bent by their own line number, so that the error rules fire."""
    bent = _options(spark, sf).withColumns(
        {
            "ask": F.when(F.col("contract_index") == 6, -F.col("ask")).otherwise(F.col("ask")),
            "delta": F.when(F.col("contract_index") == 5, F.col("delta") * 3).otherwise(F.col("delta")),
            "gamma": F.when(F.col("contract_index") == 4, -F.col("gamma")).otherwise(F.col("gamma")),
        }
    )
    wanted = [
        "NEGATIVE_OPTION_BID_ASK", "CROSSED_OPTION_MARKET", "OPTION_MARK_OUTSIDE_BID_ASK", "OPTION_DELTA_OUT_OF_RANGE",
        "NEGATIVE_OPTION_GAMMA",
    ]
    return validation.validate_options(bent).filter(F.col("code").isin(wanted)).select("run_id", "level", "code", "count")


@register(
    "validate_quotes",
    """with q as (
      select o_orderstatus as run_id, o_totalprice - (o_custkey % 7) * 100000 as mark, o_custkey % 5 as bid, o_orderkey % 5 as ask,
             o_custkey % 60 as age from orders),
    i as (
      select run_id, 'ERROR' as level, 'CROSSED_UNDERLYING_QUOTE' as code, count(*) filter (bid > ask) as count, count(*) as n from q group by run_id
      union all select run_id, 'ERROR', 'NONPOSITIVE_UNDERLYING_MARK', count(*) filter (mark <= 0), count(*) from q group by run_id
      union all select run_id, 'WARNING', 'STALE_UNDERLYING_QUOTE', count(*) filter (age > 30), count(*) from q group by run_id)
    select run_id, level, code, 'quotes' as dataset, count, round(100.0::double * count / n, 6) + 0.0::double as percentage
    from i where count > 0""",
)
def validate_quotes(spark, sf):
    quotes = harness.read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("run_id"),
        (F.col("o_totalprice") - (F.col("o_custkey") % 7) * 100000).alias("quote__mark"),
        (F.col("o_custkey") % 5).alias("quote__bidPrice"),
        (F.col("o_orderkey") % 5).alias("quote__askPrice"),
        (F.col("o_custkey") % 60).cast("double").alias("quote_age_minutes"),
    )
    return rounded(validation.validate_quotes(quotes), 6, "percentage")


@register(
    "validate_price_history",
    """select l_returnflag as run_id, 'L' || l_linenumber as symbol, count(*) as rows, min(l_shipdate) as start_utc,
              max(l_shipdate) as end_utc, count(*) filter (l_partkey % 10 = 0) as zero_volume_count,
              round(100.0::double * (count(*) filter (l_partkey % 10 = 0)) / count(*), 6) + 0.0::double as zero_volume_pct
       from lineitem group by l_returnflag, l_linenumber""",
)
def validate_price_history(spark, sf):
    history = harness.read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run_id"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("datetime_utc"),
        (F.col("l_partkey") % 10).alias("volume"),
    )
    return rounded(validation.validate_price_history(history), 6, "zero_volume_pct")


_PCTS = ["zero_bid", "zero_volume", "zero_open_interest", "wide_spread", "stale_quote"]


def _bucket_text(expr: str, labels: list[str]) -> str:
    """Counts per bucket as the text Spark prints for a map cast to JSON, empty buckets left out."""
    cells = ", ".join(
        f"case when count(*) filter ({expr} = '{b}') > 0 then '\"{b}\":' || count(*) filter ({expr} = '{b}') end" for b in labels
    )
    return f"'{{' || concat_ws(',', {cells}) || '}}'"


_DTE_SQL = """case when expiration_dte <= 0 then '0_dte' when expiration_dte <= 7 then '1_7' when expiration_dte <= 30 then '8_30'
  when expiration_dte <= 90 then '31_90' when expiration_dte <= 365 then '91_365' else '366_plus' end"""
_MONEY_SQL = """case when moneyness <= -10 then 'deep_otm' when moneyness < -2 then 'otm' when moneyness <= 2 then 'atm'
  when moneyness < 10 then 'itm' else 'deep_itm' end"""


@register(
    "option_coverage",
    f"""with {PREPARED_SQL}, b as (select *, {_DTE_SQL} as dte_b, {_MONEY_SQL} as money_b from prepared)
    select run_id, underlying_symbol, count(*) as contracts, count(*) filter (put_call = 'CALL') as calls,
      count(*) filter (put_call = 'PUT') as puts, count(distinct expiration_date) as expiration_count,
      min(expiration_dte)::double as dte_min, max(expiration_dte)::double as dte_max,
      {", ".join(f"count(*) filter ({c}) as {n}_count, round(100.0::double * (count(*) filter ({c})) / count(*), 6) + 0.0::double as {n}_pct"
                 for n, c in zip(_PCTS, ["bid = 0", "volume = 0", "oi = 0", "spread > 25", "quote_age_minutes > 30"]))},
      {_bucket_text("dte_b", ["0_dte", "1_7", "8_30", "31_90", "91_365", "366_plus"])} as contracts_by_dte_bucket,
      {_bucket_text("money_b", ["deep_otm", "otm", "atm", "itm", "deep_itm"])} as contracts_by_moneyness
    from b group by run_id, underlying_symbol""",
)
def option_coverage(spark, sf):
    rows = rounded(validation.option_coverage(prepared(spark, sf)), 6, *[f"{p}_pct" for p in _PCTS])
    return rows.withColumns({c: F.to_json(c) for c in ("contracts_by_dte_bucket", "contracts_by_moneyness")})


@register(
    "validation_status",
    f"""with {_OPTION_ISSUES_SQL}
    select run_id, count(*) filter (level = 'ERROR') as error_count, count(*) filter (level = 'WARNING') as warning_count,
      case when count(*) filter (level = 'ERROR') > 0 then 'FAIL' when count(*) > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as status
    from issues group by run_id""",
)
def validation_status(spark, sf):
    return validation.validation_status(validation.validate_options(_options(spark, sf)), ["run_id"])


@register(
    "option_feature_run",
    f"""with {_OPTION_ISSUES_SQL}, failed as (select run_id from issues where level = 'ERROR')
    select run_id, underlying_symbol, count(*) as contract_count_total, count(*) filter (eligible) as contract_count_eligible,
           {r("median(volatility) filter (eligible)", 6, "iv_median")}, 'PASS_WITH_WARNINGS' as status
    from prepared where run_id not in (select run_id from failed) group by run_id, underlying_symbol""",
)
def option_feature_run(spark, sf):
    """Validation gate, features and their run status in one job per run."""
    issues = validation.validate_options(_options(spark, sf))
    table = features(spark, sf)
    gate = validation.gated_runs(issues, table).filter("status <> 'FAIL'").select("run_id", "status")
    kept = table.join(gate, "run_id")
    return rounded(kept, 6, "iv_median").select(
        "run_id", "underlying_symbol", "contract_count_total", "contract_count_eligible", "iv_median", "status"
    )


_RUN = ["run_id"]


def _with_run(rows, text="raw_record_id"):
    """One audit scope per last digit of the record id."""
    return rows.withColumn("run_id", F.substring(text, -1, 1))


@register(
    "audit_price_history",
    """with c as (
      select substr(cast(l_orderkey as varchar), -1) as run_id, l_orderkey, l_shipdate, l_quantity, l_discount, l_tax, l_extendedprice,
             l_linenumber, l_partkey from lineitem),
    d as (select run_id, sum(n - 1) as count from (select run_id, l_orderkey, l_shipdate, count(*) as n from c group by all) where n > 1 group by run_id),
    v as (select run_id, count(*) filter (l_linenumber = 3) as count, count(*) filter (l_linenumber = 2) as neg from c group by run_id)
    select run_id, 'ERROR' as level, 'DUPLICATE_CANDLE_TIMESTAMP' as code, count::bigint as count from d
    union all select run_id, 'ERROR', 'OHLC_INVARIANT_VIOLATION', count from v where count > 0
    union all select run_id, 'ERROR', 'NEGATIVE_VOLUME', neg from v where neg > 0""",
)
def audit_price_history(spark, sf):
    lineitem = harness.read(spark, sf, "lineitem")
    record = F.col("l_orderkey").cast("string")
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate")) - 1
    history = lineitem.select(
        record.alias("raw_record_id"),
        record.alias("symbol"),
        index.alias("candle_index"),
        F.unix_timestamp("l_shipdate").alias("datetime"),
        F.col("l_extendedprice").alias("open"),
        F.when(F.col("l_linenumber") == 3, F.col("l_extendedprice") - 1).otherwise(F.col("l_extendedprice") + 1).alias("high"),
        (F.col("l_extendedprice") - 1).alias("low"),
        F.col("l_extendedprice").alias("close"),
        F.when(F.col("l_linenumber") == 2, -1).otherwise(F.col("l_partkey")).alias("volume"),
    )
    return audit.audit_price_history(_with_run(history), _RUN)


@register(
    "audit_option_chain",
    f"""with {harness_options.CONTRACTS_SQL},
    bent as (
      select *, case when contract_index = 7 then 'STRADDLE' else put_call end as side,
             case when contract_index = 6 then 0 else strike end as k from contracts),
    d as (
      select run_id, sum(n - 1) as count from (
        select run_id, underlying_symbol, side, expiration_date, k, contract_index, count(*) as n from bent group by all)
      where n > 1 group by run_id)
    select run_id, 'ERROR' as level, 'DUPLICATE_OPTION_CONTRACT' as code, count::bigint as count from d
    union all select run_id, 'ERROR', 'INVALID_OPTION_SIDE', count(*) from bent where side = 'STRADDLE' group by run_id
    union all select run_id, 'ERROR', 'INVALID_OPTION_STRIKE', count(*) from bent where k <= 0 group by run_id""",
)
def audit_option_chain(spark, sf):
    bent = _options(spark, sf).withColumns(
        {
            "put_call": F.when(F.col("contract_index") == 7, "STRADDLE").otherwise(F.col("put_call")),
            "strike": F.when(F.col("contract_index") == 6, 0.0).otherwise(F.col("strike")),
            "underlying_symbol": F.upper("underlying_symbol"),
        }
    )
    return audit.audit_option_chain(bent, _RUN)


@register(
    "audit_dataset",
    """with q as (select substr(cast(o_orderkey as varchar), -1) as run_id, o_orderkey, o_custkey from orders),
    e as (
      select substr(cast(l_orderkey as varchar), -1) as run_id, sum(n - 1) as count
      from (select l_orderkey, strftime(l_shipdate, '%Y-%m-%d') as d, count(*) as n from lineitem group by all) group by 1),
    x as (
      select run_id, count(*) - count(distinct strftime(l_shipdate, '%Y-%m-%d')) as count
      from (select substr(cast(l_orderkey as varchar), -1) as run_id, l_shipdate from lineitem) group by run_id),
    dup as (select run_id, count(*) - count(distinct o_custkey) as count from q group by run_id)
    select run_id, 'ERROR' as level, 'DUPLICATE_EXPIRATION' as code, count from x where count > 0
    union all select run_id, 'ERROR', 'DUPLICATE_QUOTE_SYMBOL', count from dup where count > 0
    union all
    select run_id, 'ERROR', 'QUOTE_SYMBOL_COVERAGE', count(*) from (
      select r.run_id, c_custkey from (select distinct run_id from q) r cross join customer
      where not exists (select 1 from q where q.run_id = r.run_id and q.o_custkey = c_custkey)) group by run_id
    union all
    select run_id, 'WARNING', 'INSTRUMENT_SYMBOL_COVERAGE', count(*) from (
      select r.run_id, c_custkey from (select distinct run_id from q) r cross join customer
      where c_custkey not in (select p_partkey from part)) group by run_id
    union all select run_id, 'WARNING', 'EMPTY_MOVERS', 1 from (select distinct run_id from q)""",
)
def audit_dataset(spark, sf):
    orders = harness.read(spark, sf, "orders")
    quotes = _with_run(orders.select(F.col("o_orderkey").cast("string").alias("raw_record_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("symbol")))
    runs = quotes.select("run_id").distinct()
    customers = harness.read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    expected = customers.withColumn("run_id", F.explode(F.array(*[F.lit(str(i)) for i in range(10)])))
    expected = expected.join(runs, "run_id", "left_semi")
    instruments = harness.read(spark, sf, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("symbol"))
    instruments = instruments.withColumn("run_id", F.explode(F.array(*[F.lit(str(i)) for i in range(10)])))
    chain = _with_run(
        harness.read(spark, sf, "lineitem").select(
            F.col("l_orderkey").cast("string").alias("raw_record_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("expirationDate")
        )
    )
    level, code = audit.EMPTY_CODES["movers"]
    no_movers = quotes.filter("symbol is null")
    parts = [
        audit.audit_quotes(quotes, _RUN, expected),
        audit.audit_expiration_chain(chain, _RUN),
        audit.audit_instruments(instruments, _RUN, expected),
        audit.empty_scopes(runs, no_movers, _RUN, level, code),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _manifests(spark, sf):
    """Raw and normalised manifests of the order captures, bent by the orders' own values."""
    orders = harness.read(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    raw = orders.filter("o_orderpriority <> '5-LOW' or o_orderstatus <> 'P'").select(
        key.alias("record_id"),
        F.when(F.col("o_custkey") % 50 == 1, "").otherwise(F.concat(F.lit("q/"), key)).alias("relative_path"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("payload_sha256"),
    )
    again = orders.filter("o_orderpriority = '2-HIGH' and o_orderstatus = 'P'").select(key.alias("record_id"))
    raw = raw.unionByName(raw.join(again, "record_id", "left_semi"))
    normalized = orders.filter("o_totalprice < 450000").select(
        key.alias("raw_record_id"),
        F.concat(F.lit("n/"), key).alias("relative_path"),
        F.sha2(key, 256).alias("normalized_sha256"),
        F.sha2(F.when(F.col("o_custkey") % 30 == 2, F.lit("x")).otherwise(F.col("o_custkey").cast("string")), 256).alias("source_payload_sha256"),
    )
    envelopes = orders.filter("o_totalprice > 20000").select(
        key.alias("record_id"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("envelope_sha256"),
        F.sha2(F.when(F.col("o_custkey") % 35 == 5, F.lit("y")).otherwise(F.col("o_custkey").cast("string")), 256).alias("actual_sha256"),
    )
    tables = orders.select(
        key.alias("raw_record_id"),
        F.sha2(F.when(F.col("o_custkey") % 60 == 6, F.lit("z")).otherwise(key), 256).alias("actual_sha256"),
    )
    return raw, normalized, envelopes, tables


_MANIFEST_SQL = """
o as (select *, not (o_orderpriority = '5-LOW' and o_orderstatus = 'P') as in_raw, o_totalprice < 450000 as in_norm from orders),
issues as (
  select o_orderkey, 'ERROR' as level, 'DUPLICATE_RAW_RECORD_ID' as code, 2 as count from o where o_orderpriority = '2-HIGH' and o_orderstatus = 'P'
  union all select o_orderkey, 'ERROR', 'RAW_PATH_MISSING', 1 from o where in_raw and o_custkey % 50 = 1
  union all select o_orderkey, 'ERROR', 'RAW_FILE_MISSING', 1 from o where in_raw and o_custkey % 50 <> 1 and not o_totalprice > 20000
  union all select o_orderkey, 'ERROR', 'RAW_PAYLOAD_HASH_MISMATCH', 1 from o
            where in_raw and o_custkey % 50 <> 1 and o_totalprice > 20000 and o_custkey % 35 = 5
  union all select o_orderkey, 'ERROR', 'NORMALIZED_WITHOUT_RAW', 1 from o where in_norm and not in_raw
  union all select o_orderkey, 'ERROR', 'NORMALIZED_HASH_MISMATCH', 1 from o where in_norm and o_custkey % 60 = 6
  union all select o_orderkey, 'ERROR', 'RAW_NORMALIZED_LINK_MISMATCH', 1 from o where in_norm and in_raw and o_custkey % 30 = 2
  union all select o_orderkey, 'WARNING', 'RAW_NOT_NORMALIZED', 1 from o where in_raw and not in_norm)"""


@register(
    "verify_hashes",
    f"with {_MANIFEST_SQL} select cast(o_orderkey as varchar) as record_id, level, code, count::bigint as count from issues",
)
def verify_hashes(spark, sf):
    return audit.verify_manifests(*_manifests(spark, sf))


def _summary(spark, sf):
    """One run per order; a run lists the artifact of its own order."""
    key = F.col("o_orderkey").cast("string")
    artifact = F.struct(
        F.when(F.col("o_orderstatus") == "P", "odd").otherwise("quotes").alias("dataset"),
        F.col("o_orderpriority").alias("scope"),
        key.alias("raw_record_id"),
        F.when(F.col("o_totalprice") < 15000, F.lit("other")).otherwise(key).alias("normalized_record_id"),
        F.concat(F.lit("n/"), key).alias("relative_path"),
    )
    extra = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 1).otherwise(0)
    return harness.read(spark, sf, "orders").select(
        key.alias("run_id"), F.array(artifact).alias("artifacts"), (F.lit(1) + extra).alias("artifact_count")
    )


_RUN_SQL = f"""{_MANIFEST_SQL},
run_issues as (
  select o_orderkey, 'ERROR' as level, 'RUN_ARTIFACT_COUNT_MISMATCH' as code, 1 as count from o where o_orderpriority = '4-NOT SPECIFIED'
  union all select o_orderkey, 'ERROR', 'RUN_RAW_RECORD_MISSING', 1 from o where not in_raw
  union all select o_orderkey, 'ERROR', 'RUN_NORMALIZED_RECORD_MISSING', 1 from o where not in_norm or o_totalprice < 15000
  union all select o_orderkey, 'ERROR', 'RUN_RAW_NORMALIZED_ID_MISMATCH', 1 from o where o_totalprice < 15000
  union all select o_orderkey, 'WARNING', 'UNKNOWN_RUN_DATASET', 1 from o where o_orderstatus = 'P')"""


def _run_issues(spark, sf):
    raw, normalized, _, _ = _manifests(spark, sf)
    summary = cut_lineage(_summary(spark, sf))
    return summary, audit.audit_run(summary, raw, normalized, list(payloads.DATASETS))


@register(
    "audit_run",
    f"with {_RUN_SQL} select cast(o_orderkey as varchar) as run_id, level, code, count::bigint as count from run_issues",
)
def audit_run(spark, sf):
    return _run_issues(spark, sf)[1]


@register(
    "audit_status",
    f"""with {_RUN_SQL}, runs as (select o_orderkey from orders)
    select cast(o_orderkey as varchar) as run_id, count(*) filter (level = 'ERROR') as error_count,
           count(*) filter (level = 'WARNING') as warning_count,
           case when count(*) filter (level = 'ERROR') = 0 then 'PASS' else 'FAIL' end as status
    from runs left join run_issues using (o_orderkey) group by o_orderkey""",
)
def audit_status(spark, sf):
    summary, issues = _run_issues(spark, sf)
    return audit.audit_status(issues, summary, ["run_id"])


@register(
    "run_totals",
    """select cast(o_orderkey as varchar) as run_id, case when o_orderstatus = 'P' then 'odd' else 'quotes' end as dataset,
              count(*) as artifacts, coalesce(sum(n), 0)::bigint as rows
       from orders left join (select l_orderkey, count(*) as n from lineitem group by all) on l_orderkey = o_orderkey group by all""",
)
def run_totals(spark, sf):
    rows = harness.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("raw_record_id")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return audit.run_totals(_summary(spark, sf), rows)
