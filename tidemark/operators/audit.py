"""Structural audits of normalised tables, manifests and capture runs as issue rows.

Issue rows are ``scope keys..., level, code, count``. Duplicates are rows
beyond the first of a key, counted as rows minus distinct keys, never by
comparing rows of a group with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profiling import symbol_column

ERROR, WARNING = "ERROR", "WARNING"


def _stack(sums: DataFrame, keys: list[str], codes: list[tuple[str, str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(code).cast("long").alias("count"))
        for level, code in codes
    ]
    return sums.select(*keys, F.explode(F.array(*cells)).alias("i")).select(*keys, "i.*").filter("count > 0")


def _count_issues(table: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    sums = table.groupBy(*keys).agg(*[value.alias(code) for _, code, value in rules])
    return _stack(sums, keys, [(level, code) for level, code, _ in rules])


def duplicates(table: DataFrame, keys: list[str], columns: list[str], level: str, code: str) -> DataFrame:
    """Rows beyond the first of each (keys, columns) combination; NULLs count as values."""
    repeated = table.groupBy(*keys, *columns).agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")
    return repeated.groupBy(*keys).agg(F.sum("extra").alias("count")).select(
        *keys, F.lit(level).alias("level"), F.lit(code).alias("code"), "count"
    )


def coverage(table: DataFrame, keys: list[str], expected: DataFrame, level: str, code: str, column: str = "symbol") -> DataFrame:
    """Expected symbols per scope that have no row. ``expected`` holds the keys and ``symbol``; what has a null in them is missing.

    Both sides are counted in one aggregate: a table of captured symbols may look small to the planner and be far too large to send out.
    """
    names = [*keys, "symbol"]
    have = table.select(*keys, F.upper(column).alias("symbol")).dropna(subset=names)
    both = expected.select(*names, F.lit(1).alias("wanted")).unionByName(have.withColumn("wanted", F.lit(0)))
    met = both.groupBy(*names).agg(F.sum("wanted").alias("wanted"), F.min("wanted").alias("least"))
    return (
        met.filter("least > 0")
        .groupBy(*keys)
        .agg(F.sum("wanted").alias("count"))
        .select(*keys, F.lit(level).alias("level"), F.lit(code).alias("code"), "count")
    )


def empty_scopes(scopes: DataFrame, table: DataFrame, keys: list[str], level: str, code: str) -> DataFrame:
    """Scopes that should hold the dataset and have no row."""
    return scopes.select(*keys).distinct().join(table.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(1).cast("long").alias("count")
    )


def required_columns(table: DataFrame, keys: list[str], dataset: str) -> DataFrame:
    """MISSING_COLUMNS per scope of a table whose schema lacks columns of its dataset."""
    gone = [c for c in REQUIRED_COLUMNS.get(dataset, []) if c not in table.columns]
    scopes = table.select(*keys).distinct().filter(F.lit(bool(gone)))
    return scopes.select(
        *keys, F.lit(ERROR).alias("level"), F.lit("MISSING_COLUMNS").alias("code"), F.lit(len(gone)).cast("long").alias("count")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_quotes(quotes: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    parts = [duplicates(quotes.withColumn("u", F.upper("symbol")), keys, ["u"], ERROR, "DUPLICATE_QUOTE_SYMBOL")]
    if expected is not None:
        parts.append(coverage(quotes, keys, expected, ERROR, "QUOTE_SYMBOL_COVERAGE"))
    return _union(parts)


def audit_price_history(history: DataFrame, keys: list[str], order: str = "candle_index") -> DataFrame:
    """Numbers, OHLC order, volume, duplicate and out-of-order candles.

    Chronology follows the capture order: a candle older than its predecessor in
    the same record breaks it. One capture record is one provider response.
    """
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in ("open", "high", "low", "close", "volume", "datetime")}
    o, h, lo, c, v = (number[k] for k in ("open", "high", "low", "close", "volume"))
    whole = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & v.isNotNull()
    broken = (lo > h) | (o < lo) | (o > h) | (c < lo) | (c > h)
    before = F.lag("datetime").over(Window.partitionBy(*keys, "raw_record_id").orderBy(order))
    rules = [
        (ERROR, "INVALID_CANDLE_NUMERIC", F.count_if(~whole)),
        (ERROR, "OHLC_INVARIANT_VIOLATION", F.count_if(whole & broken)),
        (ERROR, "NEGATIVE_VOLUME", F.count_if(whole & (v < 0))),
        (ERROR, "INVALID_CANDLE_TIMESTAMP", F.count_if(number["datetime"].isNull())),
        (
            WARNING,
            "CANDLES_NOT_CHRONOLOGICAL",
            F.when(F.count_if(number["datetime"].isNull()) == 0, F.count_if(F.col("datetime") < F.col("earlier"))).otherwise(0),
        ),
    ]
    return _union(
        [
            duplicates(history, keys, ["symbol", "datetime"], ERROR, "DUPLICATE_CANDLE_TIMESTAMP"),
            _count_issues(history.withColumn("earlier", before), keys, rules),
        ]
    )


def audit_option_chain(chain: DataFrame, keys: list[str]) -> DataFrame:
    side = F.upper("put_call")
    strike = F.expr("try_cast(strike as double)")
    rules = [
        (ERROR, "INVALID_OPTION_SIDE", F.count_if(side.isNotNull() & ~side.isin("CALL", "PUT"))),
        (
            WARNING,
            "OPTION_SIDE_COVERAGE",
            F.when(F.count_if(side == "CALL") == 0, 1).otherwise(0) + F.when(F.count_if(side == "PUT") == 0, 1).otherwise(0),
        ),
        (ERROR, "INVALID_OPTION_STRIKE", F.count_if(strike.isNull() | (strike <= 0))),
        (ERROR, "INVALID_OPTION_EXPIRATION", F.count_if(F.expr("try_cast(expiration_date as date) is null"))),
    ]
    if "expiration_dte" in chain.columns:
        rules.append((ERROR, "NEGATIVE_OPTION_DTE", F.count_if(F.expr("try_cast(expiration_dte as double) < 0"))))
    if "symbol" in chain.columns:
        repeated = duplicates(chain.filter("symbol is not null"), keys, ["symbol"], ERROR, "DUPLICATE_OPTION_CONTRACT")
    else:
        columns = ["underlying_symbol", "put_call", "expiration_date", "strike", "contract_index"]
        kept = [c for c in columns if c in chain.columns and c not in keys]
        repeated = duplicates(chain, keys, kept, ERROR, "DUPLICATE_OPTION_CONTRACT")
    return _union([_count_issues(chain, keys, rules), repeated])


def audit_expiration_chain(chain: DataFrame, keys: list[str]) -> DataFrame:
    rules = [(ERROR, "INVALID_EXPIRATION_DATE", F.count_if(F.expr("try_cast(expirationDate as date) is null")))]
    return _union(
        [_count_issues(chain, keys, rules), duplicates(chain, keys, ["expirationDate"], ERROR, "DUPLICATE_EXPIRATION")]
    )


def audit_instruments(instruments: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    name = symbol_column(instruments)
    if name is None:
        return instruments.select(*keys).distinct().select(
            *keys, F.lit(ERROR).alias("level"), F.lit("INSTRUMENT_SYMBOL_COLUMN_MISSING").alias("code"),
            F.lit(1).cast("long").alias("count"),
        )
    return coverage(instruments, keys, expected, WARNING, "INSTRUMENT_SYMBOL_COVERAGE", name)


# Dataset, level and code of an empty table.
EMPTY_CODES = {
    "quotes": (ERROR, "EMPTY_QUOTES"),
    "price_history": (ERROR, "EMPTY_PRICE_HISTORY"),
    "option_chains": (ERROR, "EMPTY_OPTION_CHAIN"),
    "expiration_chains": (ERROR, "EMPTY_EXPIRATION_CHAIN"),
    "instruments": (ERROR, "EMPTY_INSTRUMENTS"),
    "market_hours": (ERROR, "EMPTY_MARKET_HOURS"),
    "movers": (WARNING, "EMPTY_MOVERS"),
}
REQUIRED_COLUMNS = {
    "quotes": ["symbol", "raw_record_id"],
    "price_history": ["symbol", "open", "high", "low", "close", "volume", "datetime"],
    "option_chains": ["underlying_symbol", "put_call", "expiration_date", "strike"],
    "expiration_chains": ["expirationDate"],
    "market_hours": ["market_group"],
    "movers": ["mover_index"],
}


def verify_manifests(raw: DataFrame, normalized: DataFrame, envelopes: DataFrame, tables: DataFrame) -> DataFrame:
    """Provenance of every record: ``record_id, level, code, count``.

    ``raw``: record_id, relative_path, payload_sha256. ``normalized``:
    raw_record_id, relative_path, normalized_sha256, source_payload_sha256.
    ``envelopes``: record_id, envelope_sha256, actual_sha256 of what was read,
    and optionally readable (the file is JSON) and envelope_record_id.
    ``tables``: raw_record_id, actual_sha256 of the normalised rows.
    """
    def issue(rows: DataFrame, key: str, level: str, code: str | Column, count: Column | None = None) -> DataFrame:
        return rows.select(
            F.col(key).alias("record_id"), F.lit(level).alias("level"), F.lit(code).alias("code"),
            (count if count is not None else F.lit(1)).cast("long").alias("count"),
        )

    def repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
        counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return issue(counted, key, ERROR, code, F.col("n"))

    def each(rows: DataFrame, key: str, cases: list[tuple[Column, str]]) -> DataFrame:
        """Issues of all cases that a row meets, from one pass over a join that all of them need."""
        met = F.array_compact(F.array(*[F.when(case, F.lit(code)) for case, code in cases]))
        found = rows.select(key, met.alias("codes")).filter(F.size("codes") > 0).select(key, F.explode("codes").alias("code"))
        return issue(found, key, ERROR, F.col("code"))

    if "readable" not in envelopes.columns:
        envelopes = envelopes.withColumn("readable", F.lit(True))
    if "envelope_record_id" not in envelopes.columns:
        envelopes = envelopes.withColumn("envelope_record_id", F.col("record_id"))
    # Only what is compared goes into the shuffles and sorts.
    path = (F.coalesce(F.col("relative_path"), F.lit("")) == "").alias("no_path")
    one_raw = raw.select("record_id", path, "payload_sha256").dropDuplicates(["record_id"])
    one_norm = normalized.select("raw_record_id", path, "normalized_sha256", "source_payload_sha256").dropDuplicates(["raw_record_id"])
    read = envelopes.select(
        "record_id", "readable", "actual_sha256", (F.col("actual_sha256") != F.col("envelope_sha256")).alias("other_sha256"),
        F.col("envelope_record_id").eqNullSafe(F.col("record_id")).alias("same_id"),
    )
    raw_read = one_raw.filter(~F.col("no_path")).join(read, "record_id", "left")
    norm_raw = one_norm.select("raw_record_id", "source_payload_sha256").join(
        one_raw.select(F.col("record_id").alias("raw_record_id"), F.col("payload_sha256").alias("raw_sha"), F.lit(True).alias("known")),
        "raw_record_id", "left",
    )
    norm_read = one_norm.filter(~F.col("no_path")).select("raw_record_id", "normalized_sha256").join(
        tables.select("raw_record_id", "actual_sha256"), "raw_record_id", "left"
    )
    found, readable = F.col("actual_sha256").isNotNull(), F.col("readable")
    return _union(
        [
            repeated(raw, "record_id", "DUPLICATE_RAW_RECORD_ID"),
            repeated(normalized, "raw_record_id", "DUPLICATE_NORMALIZED_RECORD_ID"),
            issue(one_raw.filter("no_path"), "record_id", ERROR, "RAW_PATH_MISSING"),
            each(
                raw_read, "record_id",
                [
                    (readable.isNull(), "RAW_FILE_MISSING"),
                    (~readable, "RAW_FILE_INVALID"),
                    (readable & ~F.col("same_id"), "RAW_RECORD_ID_MISMATCH"),
                    (readable & ~found, "RAW_PAYLOAD_INVALID"),
                    (readable & found & (F.col("other_sha256") | (F.col("actual_sha256") != F.col("payload_sha256"))), "RAW_PAYLOAD_HASH_MISMATCH"),
                ],
            ),
            issue(one_norm.filter("no_path"), "raw_record_id", ERROR, "NORMALIZED_PATH_MISSING"),
            each(
                norm_read, "raw_record_id",
                [
                    (~found, "NORMALIZED_FILE_MISSING"),
                    (
                        found & (F.coalesce(F.col("normalized_sha256"), F.lit("")) != "") & (F.col("actual_sha256") != F.col("normalized_sha256")),
                        "NORMALIZED_HASH_MISMATCH",
                    ),
                ],
            ),
            each(
                norm_raw, "raw_record_id",
                [
                    (F.col("known").isNull(), "NORMALIZED_WITHOUT_RAW"),
                    (F.col("known") & ~F.col("source_payload_sha256").eqNullSafe(F.col("raw_sha")), "RAW_NORMALIZED_LINK_MISMATCH"),
                ],
            ),
            issue(
                one_raw.select("record_id").join(one_norm.select(F.col("raw_record_id").alias("record_id")), "record_id", "left_anti"),
                "record_id", WARNING, "RAW_NOT_NORMALIZED",
            ),
        ]
    )


def audit_run(
    summary: DataFrame, raw: DataFrame, normalized: DataFrame, datasets: list[str], tables: DataFrame | None = None
) -> DataFrame:
    """Capture-run summaries against the manifests: ``run_id, level, code, count``.

    ``summary``: run_id, artifact_count, artifacts array<struct<dataset, scope,
    raw_record_id, normalized_record_id, relative_path>>. ``tables`` holds the
    raw_record_id of every normalised table that can be read.
    """
    declared = summary.filter(
        F.col("artifact_count").isNotNull() & (F.col("artifact_count") != F.size("artifacts"))
    ).select("run_id", F.lit(ERROR).alias("level"), F.lit("RUN_ARTIFACT_COUNT_MISMATCH").alias("code"), F.lit(1).cast("long").alias("count"))
    items = summary.select("run_id", F.explode("artifacts").alias("a")).select("run_id", "a.*")
    raw_ids = raw.select(F.col("record_id").alias("raw_record_id")).distinct().withColumn("raw_known", F.lit(True))
    norm_ids = normalized.select(F.col("raw_record_id").alias("normalized_record_id")).distinct().withColumn("norm_known", F.lit(True))
    linked = items.join(raw_ids, "raw_record_id", "left").join(norm_ids, "normalized_record_id", "left")
    if tables is None:
        linked = linked.withColumn("stored", F.lit(True))
    else:
        stored = tables.select(F.col("raw_record_id").alias("normalized_record_id")).distinct().withColumn("stored", F.lit(True))
        linked = linked.join(stored, "normalized_record_id", "left")
    path = F.coalesce(F.col("relative_path"), F.lit(""))
    both = F.col("raw_record_id").isNotNull() & F.col("normalized_record_id").isNotNull()
    rules = [
        (ERROR, "RUN_ARTIFACT_INVALID", F.count_if(F.col("dataset").isNull() & ~both)),
        (ERROR, "RUN_ARTIFACT_PROVENANCE_INVALID", F.count_if(F.col("dataset").isNotNull() & ~both)),
        (ERROR, "RUN_RAW_RECORD_MISSING", F.count_if(both & F.col("raw_known").isNull())),
        (ERROR, "RUN_NORMALIZED_RECORD_MISSING", F.count_if(both & F.col("norm_known").isNull())),
        (ERROR, "RUN_RAW_NORMALIZED_ID_MISMATCH", F.count_if(both & (F.col("raw_record_id") != F.col("normalized_record_id")))),
        (ERROR, "RUN_NORMALIZED_PATH_MISSING", F.count_if(both & (path == ""))),
        (ERROR, "RUN_NORMALIZED_FILE_MISSING", F.count_if(both & (path != "") & F.col("stored").isNull())),
        (WARNING, "UNKNOWN_RUN_DATASET", F.count_if(~F.col("dataset").isin(*datasets))),
    ]
    return declared.unionByName(_count_issues(linked, ["run_id"], rules))


def unsummarised_captures(raw: DataFrame, summary: DataFrame) -> DataFrame:
    """NO_CAPTURE_RUN_SUMMARY when there are raw records and no run summary at all."""
    summaries = summary.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return summaries.select(
        F.lit("").alias("run_id"), F.lit(WARNING).alias("level"), F.lit("NO_CAPTURE_RUN_SUMMARY").alias("code"), F.lit(1).cast("long").alias("count")
    ).filter(F.lit(not raw.isEmpty()))


def run_totals(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Artifacts and rows per run and dataset. ``rows`` holds raw_record_id and its row count."""
    items = summary.select("run_id", F.explode("artifacts").alias("a")).select("run_id", "a.dataset", "a.raw_record_id")
    return (
        items.join(rows, "raw_record_id", "left")
        .groupBy("run_id", "dataset")
        .agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    )


def audit_status(issues: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """PASS or FAIL per scope; warnings do not fail."""
    counts = issues.groupBy(*keys).agg(
        F.count_if(F.col("level") == ERROR).alias("error_count"), F.count_if(F.col("level") == WARNING).alias("warning_count")
    )
    joined = scopes.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["error_count", "warning_count"])
    return joined.withColumn("status", F.when(F.col("error_count") == 0, "PASS").otherwise("FAIL"))
