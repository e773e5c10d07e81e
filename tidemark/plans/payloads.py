"""Queries on raw envelopes and payload normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions.nested import flatten_struct
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.sources import harness, harness_payloads, payloads

_HIDDEN = ["raw_dataset", "raw_captured_at_utc", "raw_request_sha256", "raw_payload_sha256"]


def _short(rows):
    """Leave out constant provenance and the columns the derived payloads never fill."""
    return rows.drop(*_HIDDEN)


@register(
    "scan_raw_envelopes",
    """select case event_type when 'error' then 'missing dataset' when 'view' then 'unsupported dataset other' else 'usable' end
                as status, count(*) as n, count(distinct event_id) as records
       from events group by all""",
)
def scan_raw_envelopes(spark, sf):
    usable, rejected = payloads.split_envelopes(harness_payloads.event_envelopes(spark, sf))
    rows = usable.select("record_id", F.lit("usable").alias("status")).unionByName(
        rejected.select("record_id", F.col("reject_reason").alias("status"))
    )
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("records"))


@register(
    "payload_hash_mismatches",
    """select cast(event_id as varchar) as record_id, props as payload from events
       where event_type not in ('error', 'view') and sha256(props) <> sha256(replace(props, ' ', ''))""",
)
def payload_hash_mismatches(spark, sf):
    usable, _ = payloads.split_envelopes(harness_payloads.event_envelopes(spark, sf))
    return payloads.payload_hash_mismatches(usable).select("record_id", "payload")


@register(
    "restrict_to_run",
    """select 'run-' || o_orderpriority as run_id, 'quotes-' || o_orderkey as record_id, 'quotes' as dataset
       from orders where o_orderstatus = 'F'""",
)
def restrict_to_run(spark, sf):
    orders = harness.read(spark, sf, "orders").filter("o_orderstatus = 'F'")
    artifact = F.struct(
        F.concat(F.lit("quotes-"), F.col("o_orderkey").cast("string")).alias("record_id"), F.lit("quotes").alias("dataset")
    )
    # A run's list may be cut into any number of rows; here every row lists one artifact.
    summary = orders.select(F.concat(F.lit("run-"), F.col("o_orderpriority")).alias("run_id"), F.array(artifact).alias("artifacts"))
    kept = payloads.restrict_to_run(harness_payloads.quotes(spark, sf), summary)
    return kept.select("run_id", "record_id", "dataset")


@register(
    "flatten_struct",
    """select event_id, event_type as meta__type, cast(user_id as bigint) as meta__user__id,
              '["' || event_type || '","' || user_id || '"]' as tags, cast(props->>'$.k' as bigint) as props__k from events""",
)
def flatten_columns(spark, sf):
    events = harness.read(spark, sf, "events")
    nested = events.select(
        "event_id",
        F.struct(
            F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("meta"),
            F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
            F.from_json("props", "k bigint").alias("props"),
        ).alias("record"),
    )
    return nested.select("event_id", *flatten_struct(nested.schema["record"].dataType, "record"))


@register(
    "normalize_quotes",
    f"""select 'quotes-' || o_orderkey as raw_record_id, 'S' || o_orderkey as symbol, o_orderpriority as "assetType",
               {r("o_totalprice", 4, "quote__mark")},
               round(case when o_orderstatus <> 'P' then o_totalprice + 1 end, 4) + 0.0::double as "quote__lastPrice",
               o_custkey as "quote__totalVolume" from orders""",
)
def normalize_quotes(spark, sf):
    rows = payloads.normalize_quotes(harness_payloads.quotes(spark, sf))
    return rounded(rows, 4, "quote__mark", "quote__lastPrice").select(
        "raw_record_id", "symbol", "assetType", "quote__mark", "quote__lastPrice", "quote__totalVolume"
    )


_CANDLE = ["open", "high", "low", "close"]


@register(
    "normalize_price_history",
    f"""with c as (
      select l_orderkey, cast(epoch(l_shipdate) * 1000 as bigint) as datetime, l_shipdate as datetime_utc, l_extendedprice as open,
             l_extendedprice + l_quantity as high, l_extendedprice - l_discount as low, l_extendedprice + l_tax as close,
             l_partkey as volume from lineitem)
    select 'price_history-' || l_orderkey as raw_record_id, 'S' || l_orderkey as symbol,
      cast(row_number() over (partition by l_orderkey order by datetime, open, high, low, close, volume) - 1 as integer) as candle_index,
      datetime, datetime_utc, {", ".join(r(c, 4) for c in _CANDLE)}, volume from c""",
)
def normalize_price_history(spark, sf):
    rows = payloads.normalize_price_history(harness_payloads.price_history(spark, sf))
    return rounded(_short(rows), 4, *_CANDLE).withColumn("datetime_utc", F.col("datetime_utc").cast("timestamp_ntz"))


@register(
    "normalize_option_chain",
    f"""with c as (
      select l_orderkey, case when l_partkey % 2 = 0 then 'CALL' else 'PUT' end as put_call,
             strftime(l_shipdate, '%Y-%m-%d') as expiration_date, cast(l_linenumber as integer) as expiration_dte,
             printf('%.1f', l_quantity) as strike_key, l_quantity as strike, l_suppkey as oi, l_extendedprice as mark,
             l_discount * 100 as volatility, l_tax as delta from lineitem)
    select 'option_chains-' || l_orderkey as raw_record_id, 'S' || l_orderkey as underlying_symbol, put_call,
      expiration_date || ':' || expiration_dte as expiration_key, expiration_date, expiration_dte, strike_key, strike,
      cast(row_number() over (partition by l_orderkey, put_call, expiration_date, expiration_dte, strike_key
                              order by oi, mark, volatility, delta) - 1 as integer) as contract_index,
      oi as "openInterest", {r("mark", 4)}, {r("volatility", 4)}, {r("delta", 4)} from c""",
)
def normalize_option_chain(spark, sf):
    rows = payloads.normalize_option_chain(harness_payloads.option_chains(spark, sf))
    return rounded(rows, 4, "mark", "volatility", "delta").select(
        "raw_record_id", "underlying_symbol", "put_call", "expiration_key", "expiration_date", "expiration_dte",
        "strike_key", "strike", "contract_index", "openInterest", "mark", "volatility", "delta",
    )


@register(
    "parse_expiration_key",
    """with k as (
      select distinct case o_orderstatus when 'F' then strftime(o_orderdate, '%Y-%m-%d') || ':' || (o_custkey % 400)
             when 'O' then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') || ':x' end as expiration_key from orders)
    select expiration_key, split_part(expiration_key, ':', 1) as expiration_date,
           try_cast(case when expiration_key like '%:%' then split_part(expiration_key, ':', 2) end as integer) as expiration_dte from k""",
)
def parse_expiration_key(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = (
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit(":"), (F.col("o_custkey") % 400).cast("string")))
        .when(F.col("o_orderstatus") == "O", day)
        .otherwise(F.concat(day, F.lit(":x")))
    )
    keys = harness.read(spark, sf, "orders").select(key.alias("expiration_key")).distinct()
    date, dte = payloads.expiration_parts(F.col("expiration_key"))
    return keys.select("expiration_key", date.alias("expiration_date"), dte.alias("expiration_dte"))


@register(
    "normalize_expiration_chain",
    """with c as (
      select l_orderkey, strftime(l_shipdate, '%Y-%m-%d') as d, cast(l_linenumber as integer) as n, l_returnflag as t,
             l_linestatus = 'O' as s from lineitem)
    select 'expiration_chains-' || l_orderkey as raw_record_id, d as "expirationDate", n as "daysToExpiration",
           t as "expirationType", s as standard,
           cast(row_number() over (partition by l_orderkey order by d, n, t, s) - 1 as integer) as expiration_index from c""",
)
def normalize_expiration_chain(spark, sf):
    return _short(payloads.normalize_expiration_chain(harness_payloads.expiration_chains(spark, sf)))


@register(
    "normalize_movers",
    f"""with c as (
      select l_orderkey, 'P' || l_partkey as symbol, l_suppkey as volume, l_extendedprice as p, l_tax as t from lineitem)
    select 'movers-' || l_orderkey as raw_record_id, symbol, volume, {r("p", 4, '"lastPrice"')}, {r("t", 4, '"netChange"')},
           cast(row_number() over (partition by l_orderkey order by symbol, volume, p, t) - 1 as integer) as mover_index from c""",
)
def normalize_movers(spark, sf):
    rows = payloads.normalize_movers(harness_payloads.movers(spark, sf))
    return rounded(_short(rows), 4, "lastPrice", "netChange").drop("description", "netPercentChange")


@register(
    "normalize_market_hours",
    """with m as (
      select cast(ts as date) as day, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as s,
             strftime(max(ts), '%Y-%m-%d %H:%M:%S') as e from events group by all)
    select 'market_hours-' || day as raw_record_id, event_type as market_group,
      case when event_type = 'view' then 'view' else 'X' || event_type end as market_key,
      strftime(day, '%Y-%m-%d') as date, upper(event_type) as "marketType", true as "isOpen",
      case when event_type <> 'error' then 'regularMarket' end as session_type,
      cast(case when event_type <> 'error' then 0 end as integer) as session_index,
      case when event_type <> 'error' then s end as session__start, case when event_type <> 'error' then e end as session__end
    from m""",
)
def normalize_market_hours(spark, sf):
    return _short(payloads.normalize_market_hours(harness_payloads.market_hours(spark, sf))).drop("product")


@register(
    "normalize_instruments",
    """select 'instruments-' || p_partkey as raw_record_id, 0 as instrument_index, 'P' || p_partkey as symbol,
              p_name as description, p_brand as exchange, p_type as "assetType" from part""",
)
def normalize_instruments(spark, sf):
    return _short(payloads.normalize_instruments(harness_payloads.instruments(spark, sf))).drop("cusip")


@register(
    "normalize_run",
    """select 'quotes' as dataset, count(*) as n, count(distinct o_orderkey) as records from orders
       union all select 'price_history', count(*), count(distinct l_orderkey) from lineitem
       union all select 'option_chains', count(*), count(distinct l_orderkey) from lineitem
       union all select 'expiration_chains', count(*), count(distinct l_orderkey) from lineitem
       union all select 'movers', count(*), count(distinct l_orderkey) from lineitem
       union all select 'instruments', count(*), count(distinct p_partkey) from part
       union all select 'market_hours', count(distinct (cast(ts as date), event_type)), count(distinct cast(ts as date)) from events""",
)
def normalize_run(spark, sf):
    tables = payloads.normalize_run(harness_payloads.envelopes(spark, sf))
    parts = [t.select(F.lit(name).alias("dataset"), "raw_record_id") for name, t in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw_record_id").alias("records"))
