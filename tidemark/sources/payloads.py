"""Raw capture envelopes and their normalisation into seven tables.

An envelope row carries the payload as JSON text. Each dataset parses its own
payload with one ``from_json`` and explodes it, so normalising is a narrow,
shuffle-free job whatever the number of captures; no array leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.nested import flatten_struct, json_digest

# Dataset names, required envelope fields, provenance column names.
DATASETS = (
    "quotes", "price_history", "option_chains", "expiration_chains", "movers", "market_hours", "instruments",
)
ENVELOPE_FIELDS = (
    "schema_version", "source", "dataset", "captured_at_utc", "record_id", "request_sha256", "payload_sha256", "request",
    "payload",
)
ENVELOPE = T.StructType([T.StructField(name, T.StringType()) for name in ENVELOPE_FIELDS])
REQUIRED = [
    "schema_version", "dataset", "captured_at_utc", "record_id", "request_sha256", "payload_sha256", "request", "payload",
]
PROVENANCE = {
    "raw_record_id": "record_id",
    "raw_dataset": "dataset",
    "raw_captured_at_utc": "captured_at_utc",
    "raw_request_sha256": "request_sha256",
    "raw_payload_sha256": "payload_sha256",
}

QUOTE = (
    "assetType string, quote struct<mark double, lastPrice double, bidPrice double, askPrice double, closePrice double, "
    "totalVolume bigint, quoteTime bigint>, regular struct<regularMarketLastPrice double>"
)
CANDLE = "open double, high double, low double, close double, volume bigint, datetime bigint"
CONTRACT = (
    "symbol string, bid double, ask double, mark double, volatility double, delta double, gamma double, theta double, "
    "vega double, rho double, openInterest bigint, totalVolume bigint, quoteTimeInLong bigint, "
    "percentChange double, markPercentChange double"
)
EXPIRATION = "expirationDate string, daysToExpiration int, expirationType string, standard boolean"
MOVER = "symbol string, description string, volume bigint, lastPrice double, netChange double, netPercentChange double"
MARKET = "date string, marketType string, product string, isOpen boolean, sessionHours map<string, array<struct<start: string, end: string>>>"
INSTRUMENT = "symbol string, cusip string, description string, exchange string, assetType string"


def scan_raw_envelopes(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable envelopes, rejected rows with a reason) from capture files; nested request and payload stay JSON text.

    Files hold one envelope a line and can be split; ``multiline`` is for files of one indented envelope each.
    """
    raw = spark.read.schema(ENVELOPE).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
    return split_envelopes(raw)


def check_envelopes(raw: DataFrame) -> DataFrame:
    """``raw`` with ``reject_reason``, null for usable envelopes."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    reason = (
        F.when(missing != "", F.concat(F.lit("missing "), missing))
        .when(~F.col("dataset").isin(*DATASETS), F.concat(F.lit("unsupported dataset "), F.col("dataset")))
        .when(F.try_parse_json("payload").isNull(), "payload is not JSON")
    )
    return raw.withColumn("reject_reason", reason)


def split_envelopes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_envelopes(raw)
    return checked.filter("reject_reason is null").drop("reject_reason"), checked.filter("reject_reason is not null")


def payload_hash_mismatches(envelopes: DataFrame) -> DataFrame:
    """Envelopes whose stored payload hash differs from the hash of the canonical payload."""
    return envelopes.withColumn("actual_sha256", json_digest(F.col("payload"))).filter(
        F.coalesce(F.col("actual_sha256"), F.lit("")) != F.col("payload_sha256")
    )


def restrict_to_run(envelopes: DataFrame, summary: DataFrame) -> DataFrame:
    """Only the artifacts a run summary lists. ``summary`` holds ``run_id, artifacts array<struct<record_id, dataset>>``."""
    listed = summary.select("run_id", F.explode("artifacts").alias("a")).select("run_id", "a.record_id", "a.dataset")
    return envelopes.join(listed, ["record_id", "dataset"])


def _provenance() -> list[Column]:
    return [F.col(source).alias(name) for name, source in PROVENANCE.items()]


def attach_provenance(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Envelope columns next to the row's own columns, all in sorted order."""
    table = rows.select(*_provenance(), *columns)
    return table.select(*sorted(table.columns))


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _of(envelopes: DataFrame, dataset: str) -> DataFrame:
    return envelopes.filter(F.col("dataset") == dataset)


def normalize_quotes(envelopes: DataFrame, record: str = QUOTE) -> DataFrame:
    """One row per symbol key of a quote payload."""
    parsed = F.from_json("payload", T.MapType(T.StringType(), _struct(record)))
    rows = _of(envelopes, "quotes").select("*", F.explode(parsed).alias("symbol_key", "record"))
    return attach_provenance(rows, [F.upper("symbol_key").alias("symbol"), *flatten_struct(_struct(record), "record")])


def normalize_price_history(envelopes: DataFrame, record: str = CANDLE) -> DataFrame:
    """One row per candle with its index and UTC time."""
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("candles", T.ArrayType(_struct(record)))])
    rows = (
        _of(envelopes, "price_history")
        .withColumn("p", F.from_json("payload", schema))
        .select("*", F.posexplode("p.candles").alias("candle_index", "record"))
    )
    return attach_provenance(
        rows,
        [
            F.upper("p.symbol").alias("symbol"),
            "candle_index",
            F.timestamp_millis("record.datetime").alias("datetime_utc"),
            *flatten_struct(_struct(record), "record"),
        ],
    )


def expiration_parts(key: Column) -> tuple[Column, Column]:
    """(date text, days to expiration) of a key such as 2026-11-20:42; an unreadable number is NULL."""
    date = F.when(key != "", F.split_part(key, F.lit(":"), F.lit(1)))
    rest = F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", -1))
    whole = F.substring(key, F.length(F.split_part(key, F.lit(":"), F.lit(1))) + 2, F.length(key))
    return F.when(date != "", date), F.when(rest.isNotNull(), F.trim(whole).try_cast("int"))


def normalize_option_chain(envelopes: DataFrame, record: str = CONTRACT) -> DataFrame:
    """Call and put maps: expiration to strike to contracts, one row per contract; one parse for both sides."""
    chain = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(_struct(record))))
    schema = T.StructType(
        [
            T.StructField("symbol", T.StringType()),
            T.StructField("callExpDateMap", chain),
            T.StructField("putExpDateMap", chain),
        ]
    )
    sides = F.array(
        F.struct(F.lit("CALL").alias("side"), F.col("p.callExpDateMap").alias("chain")),
        F.struct(F.lit("PUT").alias("side"), F.col("p.putExpDateMap").alias("chain")),
    )
    rows = (
        _of(envelopes, "option_chains")
        .withColumn("p", F.from_json("payload", schema))
        .select(*PROVENANCE.values(), F.col("p.symbol").alias("chain_symbol"), F.explode(sides).alias("s"))
        .select("*", F.explode("s.chain").alias("expiration_key", "strikes"))
        .select("*", F.explode("strikes").alias("strike_key", "contracts"))
        .select("*", F.posexplode("contracts").alias("contract_index", "record"))
    )
    date, dte = expiration_parts(F.col("expiration_key"))
    return attach_provenance(
        rows,
        [
            F.upper("chain_symbol").alias("underlying_symbol"),
            F.col("s.side").alias("put_call"),
            F.col("expiration_key"),
            date.alias("expiration_date"),
            dte.alias("expiration_dte"),
            F.col("strike_key"),
            F.col("strike_key").try_cast("double").alias("strike"),
            F.col("contract_index"),
            *flatten_struct(_struct(record), "record"),
        ],
    )


def _indexed(envelopes: DataFrame, dataset: str, field: str, index: str, record: str) -> DataFrame:
    schema = T.StructType([T.StructField(field, T.ArrayType(_struct(record)))])
    rows = _of(envelopes, dataset).select("*", F.posexplode(F.from_json("payload", schema)[field]).alias(index, "record"))
    return attach_provenance(rows, [F.col(index), *flatten_struct(_struct(record), "record")])


def normalize_expiration_chain(envelopes: DataFrame, record: str = EXPIRATION) -> DataFrame:
    return _indexed(envelopes, "expiration_chains", "expirationList", "expiration_index", record)


def normalize_movers(envelopes: DataFrame, record: str = MOVER) -> DataFrame:
    return _indexed(envelopes, "movers", "screeners", "mover_index", record)


def normalize_instruments(envelopes: DataFrame, record: str = INSTRUMENT) -> DataFrame:
    return _indexed(envelopes, "instruments", "instruments", "instrument_index", record)


def normalize_market_hours(envelopes: DataFrame, record: str = MARKET) -> DataFrame:
    """One row per session interval; a market without sessions still yields one row.

    A group is either a market itself (it has sessionHours or isOpen) or a map
    of markets; the two shapes are told apart by parsing the group as text.
    """
    market = _struct(record)
    own = T.StructType([f for f in market.fields if f.name != "sessionHours"])
    groups = _of(envelopes, "market_hours").select(
        "*", F.explode(F.from_json("payload", "map<string, string>")).alias("market_group", "body")
    )
    direct = F.get_json_object("body", "$.sessionHours").isNotNull() | F.get_json_object("body", "$.isOpen").isNotNull()
    markets = F.when(direct, F.create_map(F.col("market_group"), F.from_json("body", market))).otherwise(
        F.from_json("body", T.MapType(T.StringType(), market))
    )
    sessions = (
        groups.select("*", F.explode(markets).alias("market_key", "record"))
        .filter("record is not null")
        .select("*", F.explode_outer("record.sessionHours").alias("session_type", "intervals"))
    )
    # A market whose sessions hold no interval keeps a single bare row.
    rows = sessions.select("*", F.posexplode_outer("intervals").alias("session_index", "interval"))
    total = F.aggregate(
        F.map_values(F.coalesce(F.col("record.sessionHours"), F.create_map().cast("map<string, array<struct<start: string, end: string>>>"))),
        F.lit(0),
        lambda acc, x: acc + F.greatest(F.size(x), F.lit(0)),
    )
    first = F.coalesce(F.col("session_type") == F.array_min(F.map_keys("record.sessionHours")), F.lit(True))
    rows = rows.withColumn("intervals_in_market", total).filter(
        F.col("session_index").isNotNull() | ((F.col("intervals_in_market") == 0) & first)
    )
    filled = F.col("session_index").isNotNull()
    return attach_provenance(
        rows,
        [
            "market_group",
            "market_key",
            *flatten_struct(own, "record"),
            F.when(filled, F.col("session_type")).alias("session_type"),
            "session_index",
            F.col("interval.start").alias("session__start"),
            F.col("interval.end").alias("session__end"),
        ],
    )


NORMALIZERS = {
    "quotes": normalize_quotes,
    "price_history": normalize_price_history,
    "option_chains": normalize_option_chain,
    "expiration_chains": normalize_expiration_chain,
    "movers": normalize_movers,
    "market_hours": normalize_market_hours,
    "instruments": normalize_instruments,
}


def normalize_run(envelopes: DataFrame, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """All datasets of a run. A manifest ``record_id, dataset`` restricts and must match the envelopes it names."""
    kept = envelopes
    if manifest is not None:
        kept = envelopes.join(manifest.select("record_id", "dataset"), ["record_id", "dataset"], "left_semi")
    return {name: normalize(kept) for name, normalize in NORMALIZERS.items()}


def unmatched_manifest_rows(envelopes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries with no envelope of the same record id and dataset."""
    return manifest.join(envelopes.select("record_id", "dataset"), ["record_id", "dataset"], "left_anti")


def infer_record_schema(rows: DataFrame, column: str) -> str:
    """DDL of the records in a JSON text column, merged over all rows by one distributed aggregate."""
    merged = rows.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    return merged.replace("OBJECT<", "struct<")
