"""Queries on hashes, fingerprints, appends and write-once tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import history
from tidemark.plans.catalog import register
from tidemark.plans.common import r, rounded
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import harness, harness_payloads, payloads, tables

_PLAIN = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
# Measures are hashed in hundredths and dates as text, so that every engine writes the same characters.
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FIELDS = [*_PLAIN, *(f"{c}_hundredths" for c in _MEASURES), "shipped_on"]
_LINES_SQL = (
    "lines as (select *, "
    + ", ".join(f"cast(round({c} * 100) as bigint) as {c}_hundredths" for c in _MEASURES)
    + ", strftime(l_shipdate, '%Y-%m-%d') as shipped_on from lineitem)"
)
_HASH_SQL = "sha256(to_json({" + ", ".join(f"'{c}': {c}" for c in _FIELDS) + "}))"


def _lines(spark, sf):
    exact = {f"{c}_hundredths": F.round(F.col(c) * 100).cast("long") for c in _MEASURES}
    return harness.read(spark, sf, "lineitem").withColumns(exact | {"shipped_on": F.date_format("l_shipdate", "yyyy-MM-dd")})


@register("row_record_hash", f"with {_LINES_SQL} select {', '.join(_FIELDS)}, {_HASH_SQL} as record_sha256 from lines")
def row_record_hash(spark, sf):
    """Every column of a row goes into its hash."""
    return _lines(spark, sf).select(*_FIELDS, hashing.record_hash(_FIELDS).alias("record_sha256"))


_SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint) as s{i}" for i in range(2))


@register(
    "table_fingerprint",
    f"""with {_LINES_SQL}, h as (select l_shipdate, {_HASH_SQL} as h from lines),
    s as (select year(l_shipdate)::integer as year, count(*) as rows, {_SUMS} from h group by 1)
    select year, rows, sha256(concat_ws('|', rows, s0, s1)) as fingerprint from s""",
)
def table_fingerprint(spark, sf):
    lineitem = _lines(spark, sf).withColumn("year", F.year("l_shipdate"))
    return hashing.table_fingerprint(lineitem, _FIELDS, ["year"])


# Days 1-20 are on record; days 15-30 arrive, those of one user in nine with another value.
_KEY = ["event_id"]
_BATCH_SQL = """
existing as (select event_id, user_id, value from events where day(ts) <= 20),
incoming as (
  select event_id, user_id, case when user_id % 9 = 4 then value + 1 else value end as value, cast(ts as date) as day
  from events where day(ts) >= 15)"""


def _batches(spark, sf):
    events = harness.read(spark, sf, "events")
    existing = events.filter(F.dayofmonth("ts") <= 20).select("event_id", "user_id", "value")
    changed = F.when(F.col("user_id") % 9 == 4, F.col("value") + 1).otherwise(F.col("value"))
    incoming = events.filter(F.dayofmonth("ts") >= 15).select(
        "event_id", "user_id", changed.alias("value"), F.to_date("ts").alias("day")
    )
    return existing, incoming


@register(
    "classify_append",
    f"""with {_BATCH_SQL}
    select i.event_id, i.day, case when e.event_id is null then 'NEW' when abs(e.value - i.value) > 1e-12 then 'CONFLICT'
           else 'MATCH' end as append_status
    from incoming i left join existing e using (event_id)""",
)
def classify_append(spark, sf):
    existing, incoming = _batches(spark, sf)
    return history.classify(existing, incoming, _KEY, ["user_id", "value"]).select("event_id", "day", "append_status")


@register(
    "append_conflicts",
    f"""with {_BATCH_SQL}
    select i.event_id, 'value' as changed from incoming i join existing e using (event_id)
    where abs(e.value - i.value) > 1e-12""",
)
def append_conflicts(spark, sf):
    existing, incoming = _batches(spark, sf)
    rows = history.conflicts(existing, incoming, _KEY, ["user_id", "value"])
    return rows.select("event_id", F.concat_ws(",", "changed_fields").alias("changed"))


@register(
    "idempotent_append",
    f"""select event_type, count(*) as events, {r("sum(value)", 4, "total")} from events group by event_type""",
)
def idempotent_append(spark, sf):
    """Two overlapping batches and a repeated one leave exactly one row per key."""
    path = scratch_path(spark, "history")
    events = harness.read(spark, sf, "events").select("event_id", "event_type", "value", F.dayofmonth("ts").alias("day"))
    for part in (events.filter("day <= 20"), events.filter("day >= 15"), events.filter("day <= 20")):
        history.idempotent_append(path, part, _KEY)
    stored = spark.read.parquet(path)
    rows = stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return rounded(rows, 4, "total")


@register(
    "ledger_append",
    """select event_type as model_version, cast(ts as date) as information_date, count(*) as state,
              'first' as generated_at_utc from events group by all""",
)
def ledger_append(spark, sf):
    """A rerun that differs in its generation time only changes nothing."""
    path = scratch_path(spark, "ledger")
    signals = (
        harness.read(spark, sf, "events")
        .groupBy(F.col("event_type").alias("model_version"), F.to_date("ts").alias("information_date"))
        .agg(F.count(F.lit(1)).alias("state"))
    )
    signals = cut_lineage(signals)
    for stamp in ("first", "second"):
        history.ledger_append(path, signals.withColumn("generated_at_utc", F.lit(stamp)), history.SIGNAL_KEY)
    return spark.read.parquet(path)


@register(
    "duplicate_keys",
    """select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return history.duplicate_keys(harness.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "write_once",
    """select o_orderpriority, count(*) as n, 'CREATED,EXISTS' as outcomes from orders group by all""",
)
def write_once(spark, sf):
    path = scratch_path(spark, "once")
    table = harness.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    outcomes = [tables.write_once(table, path), tables.write_once(table.repartition(3), path)]
    return spark.read.parquet(path).withColumn("outcomes", F.lit(",".join(outcomes)))


@register(
    "write_matrix",
    f"""with {harness.PRICES_SQL}
    select asset, count(close) as closes, (select count(distinct session) from prices) as rows, 7 as columns
    from prices group by asset""",
)
def write_matrix(spark, sf):
    assets = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    path = scratch_path(spark, "matrix")
    report = tables.write_matrix(tables.wide_matrix(harness.prices(spark, sf), assets), path)
    long = spark.read.parquet(path).unpivot(["session"], assets, "asset", "close").filter("close is not null")
    return long.groupBy("asset").agg(F.count("close").alias("closes")).withColumns(
        {"rows": F.lit(report["rows"]).cast("long"), "columns": F.lit(report["columns"])}
    )


@register(
    "price_file_round_trip",
    f"""with {harness.PRICES_SQL} select universe_id, session, asset, {r("close", 8)} from prices""",
)
def price_file_round_trip(spark, sf):
    """Closes written as a wide CSV file and scanned back into long rows."""
    assets = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    path = scratch_path(spark, "prices-csv")
    wide = tables.wide_matrix(harness.prices(spark, sf), assets).select("session", *assets)
    wide.write.option("header", True).csv(path)
    return rounded(tables.scan_prices(spark, path, assets).filter("close is not null"), 8, "close")


# The expected symbols are the finished orders; the others are captured and left out.
@register(
    "price_matrix_from_run",
    f"""select 'RUN' as universe_id, cast(l_shipdate as date) as session, 'S' || l_orderkey as asset,
              round(max_by(l_extendedprice + l_tax, (l_shipdate, l_extendedprice, l_extendedprice + l_quantity,
                    l_extendedprice - l_discount, l_extendedprice + l_tax, l_partkey)), 6) + 0.0::double as close
       from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by l_shipdate, l_orderkey""",
)
def price_matrix_from_run(spark, sf):
    symbol = F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("symbol")
    expected = harness.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(symbol)
    candles = payloads.normalize_price_history(harness_payloads.price_history(spark, sf))
    return rounded(tables.price_matrix_from_run(candles, expected), 6, "close")


@register(
    "missing_symbols",
    """select 'S' || o_orderkey as symbol from orders where o_orderkey not in (select l_orderkey from lineitem)""",
)
def missing_symbols(spark, sf):
    """Orders without any candle."""
    symbol = F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("symbol")
    expected = harness.read(spark, sf, "orders").select(symbol)
    candles = payloads.normalize_price_history(harness_payloads.price_history(spark, sf))
    return tables.missing_symbols(tables.price_matrix_from_run(candles, expected), expected)
