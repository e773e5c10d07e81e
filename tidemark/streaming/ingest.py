"""Continuous normalisation of landed envelopes and continuous history appends.

Both jobs keep their state in the checkpoint and in the output tables. A micro
batch may run again after a failure, so its writes are keyed: rows of a record
or key already present are filtered out by an anti-join before the append. Where
the records seen are held in the stream's state, only the first batch of a run
can be such a one, and the others do not read what has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.history import conflicts, new_rows, null_in, same_partitions, table_exists
from tidemark.session import FREES_SHUFFLES, settings
from tidemark.sources.payloads import ENVELOPE, NORMALIZERS, check_envelopes


def read_envelopes(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """JSON-lines envelopes as a stream with an event time."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(landing)


def _append(rows: DataFrame, path: str, keys: list[str]) -> None:
    # Most bytes are digests in hex, which only an entropy coder halves.
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def _append_unseen(rows: DataFrame, path: str, keys: list[str]) -> None:
    spark = rows.sparkSession
    fresh = new_rows(spark.read.parquet(path), rows, keys) if table_exists(spark, path) else rows
    _append(fresh, path, keys)


#: The state holds every record id ever seen: on the executors' disks, and of each batch only what it adds goes to the checkpoint.
#: A batch's shuffle files go with the batch.
STATE = FREES_SHUFFLES | {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def stream_normalize(
    envelopes: DataFrame, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write each dataset's normalised rows below ``output``; unusable envelopes go to ``output/rejected``.

    Repeats of a record id are removed by the state of the stream, which has no
    watermark, so late records are kept whatever their capture time; rows without
    a record id are told apart by their content. The first batch of a run, which may
    have been written in part before, is also held against the output. If there
    was output before the checkpoint, so is every batch.
    """
    spark = envelopes.sparkSession
    names, older = [*NORMALIZERS, "rejected"], f"{checkpoint}/older_output"
    resumed: list[int] = []
    key = F.coalesce("record_id", F.concat(F.lit("no id "), F.sha2(F.to_json(F.struct(*envelopes.columns)), 256)))

    def write(batch: DataFrame, number: int) -> None:
        # The whole batch is computed here, once: its state with it, and which datasets it has.
        batch = batch.drop("__record").persist()
        try:
            counted = batch.groupBy(F.when(F.col("reject_reason").isNull(), F.col("dataset")).otherwise("rejected").alias("name")).count()
            present = {row["name"] for row in counted.collect()}
            session = batch.sparkSession
            if number == 0 and not resumed and any(table_exists(session, f"{output}/{name}") for name in names):
                session.range(0).write.mode("overwrite").parquet(older)
            append = _append_unseen if not resumed or table_exists(session, older) else _append
            resumed.append(number)
            usable = batch.filter("reject_reason is null").drop("reject_reason")
            for name, normalize in NORMALIZERS.items():
                if name in present:
                    append(normalize(usable), f"{output}/{name}", ["raw_record_id"])
            if "rejected" in present:
                append(batch.filter("reject_reason is not null"), f"{output}/rejected", ["record_id"])
        finally:
            batch.unpersist()

    seen_once = check_envelopes(envelopes.withColumn("__record", key).dropDuplicates(["__record"]))
    writer = seen_once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with settings(spark, STATE):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_append_history(
    incoming: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True,
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Append rows with unseen keys; repeats must match the stored row, late or not.

    What cannot be appended is kept aside in ``path``_conflicts with the reason and
    never overwrites history: rows with a null in the key, all rows of a key that
    comes with different content in one batch, and rows that differ from the
    stored one. ``partition_by`` (key columns) lays the table out so that a batch
    reads only the partitions it touches.
    """

    def save(rows: DataFrame) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        distinct = batch.distinct().persist()
        try:
            named = distinct.filter(~null_in(keys))
            several = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
            aside = distinct.filter(null_in(keys)).withColumn("reason", F.lit("NULL_KEY"))
            aside = aside.unionByName(named.join(several, keys, "left_semi").select(*columns).withColumn("reason", F.lit("CONFLICT_IN_BATCH")))
            one = named.join(several, keys, "left_anti").select(*columns)
            fresh = one
            if table_exists(spark, path):
                existing = same_partitions(spark.read.parquet(path), one, partition_by)
                clash = conflicts(existing, one, keys).select(*keys)
                aside = aside.unionByName(one.join(clash, keys, "left_semi").select(*columns).withColumn("reason", F.lit("CONFLICT_WITH_HISTORY")))
                fresh = new_rows(existing, one, keys).select(*columns)
            # A batch that runs again replaces what it set aside before, and finds its own rows in the history.
            aside.write.mode("overwrite").parquet(f"{path}_conflicts/batch={number}")
            save(fresh)
        finally:
            distinct.unpersist()

    writer = incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
