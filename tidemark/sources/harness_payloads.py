"""Capture envelopes built by Spark from the provided tables.

One payload per order, part, event type and day: every payload is bounded by
its own key (an order has a handful of line items), whatever the table size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.nested import json_digest
from tidemark.sources.harness import read

CAPTURED = "2002-01-01T00:00:00Z"


def _envelope(rows: DataFrame, dataset: str, key: Column, payload: Column) -> DataFrame:
    text = rows.select(F.concat(F.lit(f"{dataset}-"), key.cast("string")).alias("record_id"), payload.alias("payload"))
    return text.select(
        F.lit("1").alias("schema_version"),
        F.lit("provider").alias("source"),
        F.lit(dataset).alias("dataset"),
        F.lit(CAPTURED).alias("captured_at_utc"),
        "record_id",
        F.sha2("record_id", 256).alias("request_sha256"),
        json_digest(F.col("payload")).alias("payload_sha256"),
        F.lit("{}").alias("request"),
        "payload",
    )


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    symbol = F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))
    body = F.struct(
        F.col("o_orderpriority").alias("assetType"),
        F.struct(
            F.col("o_totalprice").alias("mark"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") + 1).alias("lastPrice"),
            F.col("o_custkey").alias("totalVolume"),
        ).alias("quote"),
    )
    return _envelope(orders, "quotes", F.col("o_orderkey"), F.to_json(F.create_map(symbol, body)))


def price_history(spark: SparkSession, sf: str) -> DataFrame:
    candle = F.struct(
        (F.unix_timestamp("l_shipdate") * 1000).alias("datetime"),
        F.col("l_extendedprice").alias("open"),
        (F.col("l_extendedprice") + F.col("l_quantity")).alias("high"),
        (F.col("l_extendedprice") - F.col("l_discount")).alias("low"),
        (F.col("l_extendedprice") + F.col("l_tax")).alias("close"),
        F.col("l_partkey").alias("volume"),
    )
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(candle)).alias("candles"))
    payload = F.to_json(F.struct(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("symbol"), "candles"))
    return _envelope(rows, "price_history", F.col("l_orderkey"), payload)


def option_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with an even part number are calls; shipping month gives the expiration, quantity the strike."""
    lineitem = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    key = F.concat(F.to_date("l_shipdate").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    contract = F.struct(
        F.col("l_suppkey").alias("openInterest"),
        F.col("l_extendedprice").alias("mark"),
        (F.col("l_discount") * 100).alias("volatility"),
        F.col("l_tax").alias("delta"),
    )
    line = F.struct(
        (F.col("l_partkey") % 2 == 0).alias("call"),
        key.alias("expiration"),
        F.format_string("%.1f", "l_quantity").alias("strike"),
        contract.alias("contract"),
    )
    # One list per order, sorted once; its sides, expirations and strikes are nested inside the row.
    rows = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def nested(lines: Column, name: str, inner: Callable[[Column], Column]) -> Column:
        """Map of each different value of a field to ``inner`` of the lines that have it."""
        keys = F.array_distinct(lines[name])
        return F.map_from_arrays(keys, F.transform(keys, lambda k: inner(F.filter(lines, lambda x: x[name] == k))))

    def side(call: bool) -> Column:
        lines = F.filter("lines", lambda x: x["call"] == F.lit(call))
        chain = nested(lines, "expiration", lambda group: nested(group, "strike", lambda same: same["contract"]))
        return F.when(F.size(lines) > 0, chain)

    rows = rows.select("l_orderkey", side(True).alias("callExpDateMap"), side(False).alias("putExpDateMap"))
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("symbol"), "callExpDateMap", "putExpDateMap"
        )
    )
    return _envelope(rows, "option_chains", F.col("l_orderkey"), payload)


def _list_payload(rows: DataFrame, key: str, field: str, record: Column) -> tuple[DataFrame, Column]:
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(record)).alias(field))
    return packed, F.to_json(F.struct(field))


def expiration_chains(spark: SparkSession, sf: str) -> DataFrame:
    record = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("expirationDate"),
        F.col("l_linenumber").alias("daysToExpiration"),
        F.col("l_returnflag").alias("expirationType"),
        (F.col("l_linestatus") == "O").alias("standard"),
    )
    rows, payload = _list_payload(read(spark, sf, "lineitem"), "l_orderkey", "expirationList", record)
    return _envelope(rows, "expiration_chains", F.col("l_orderkey"), payload)


def movers(spark: SparkSession, sf: str) -> DataFrame:
    record = F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_suppkey").alias("volume"),
        F.col("l_extendedprice").alias("lastPrice"),
        F.col("l_tax").alias("netChange"),
    )
    rows, payload = _list_payload(read(spark, sf, "lineitem"), "l_orderkey", "screeners", record)
    return _envelope(rows, "movers", F.col("l_orderkey"), payload)


def market_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Per day: event types as market groups; one type is flat, one has no sessions."""
    text = "yyyy-MM-dd HH:mm:ss"
    per_type = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.date_format(F.min("ts"), text).alias("start"), F.date_format(F.max("ts"), text).alias("end")
    )
    sessions = F.create_map(F.lit("regularMarket"), F.array(F.struct("start", "end")))
    market = F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.upper("event_type").alias("marketType"),
        F.lit(True).alias("isOpen"),
        F.when(F.col("event_type") != "error", sessions).alias("sessionHours"),
    )
    body = F.when(F.col("event_type") == "view", F.to_json(market)).otherwise(
        F.to_json(F.create_map(F.concat(F.lit("X"), F.col("event_type")), market))
    )
    entry = F.concat(F.lit('"'), F.col("event_type"), F.lit('":'), body)
    rows = per_type.groupBy("day").agg(F.concat_ws(",", F.sort_array(F.collect_list(entry))).alias("entries"))
    return _envelope(rows, "market_hours", F.col("day"), F.concat(F.lit("{"), F.col("entries"), F.lit("}")))


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    record = F.struct(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("exchange"),
        F.col("p_type").alias("assetType"),
    )
    return _envelope(part, "instruments", F.col("p_partkey"), F.to_json(F.struct(F.array(record).alias("instruments"))))


BUILDERS = (quotes, price_history, option_chains, expiration_chains, movers, market_hours, instruments)


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [build(spark, sf) for build in BUILDERS])


def event_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw rows: the properties are the payload and the dataset comes from the event type."""
    events = read(spark, sf, "events")
    return events.select(
        F.lit("1").alias("schema_version"),
        F.lit("provider").alias("source"),
        F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", "other").otherwise("quotes").alias("dataset"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at_utc"),
        F.col("event_id").cast("string").alias("record_id"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("request_sha256"),
        F.sha2("props", 256).alias("payload_sha256"),
        F.lit("{}").alias("request"),
        F.col("props").alias("payload"),
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """One brokerage account per customer: orders summed by priority play the positions (five at most)."""
    orders = read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    by_asset = orders.groupBy(F.col("o_custkey").alias("account_id"), F.substring("o_orderpriority", 3, 20).alias("symbol")).agg(
        F.floor(F.sum(cents) / F.lit(100000)).alias("units"), F.count(F.lit(1)).alias("n")
    )
    position = F.struct(
        F.struct("symbol", F.when(F.col("symbol") == "LOW", "BOND").otherwise("EQUITY").alias("assetType")).alias("instrument"),
        F.col("units").cast("double").alias("longQuantity"),
        F.when((F.col("n") > 5) & (F.col("symbol") == "HIGH"), 3.0).otherwise(0.0).alias("shortQuantity"),
        F.when(F.col("n") % 4 != 0, F.col("units") * 2.5).alias("marketValue"),
        F.lit(2.0).alias("averagePrice"),
    )
    packed = by_asset.groupBy("account_id").agg(F.sort_array(F.collect_list(position)).alias("positions"))
    customer = read(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), "c_acctbal")
    rows = customer.join(packed, "account_id", "left")
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("c_acctbal").alias("cashBalance")).alias("currentBalances"), "positions"
            ).alias("securitiesAccount")
        )
    )
    return rows.select("account_id", payload.alias("payload"))
