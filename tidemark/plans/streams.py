"""Queries that run a stream over the provided tables to completion and read its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import register
from tidemark.session import FREES_SHUFFLES, scratch_path, settings
from tidemark.sources import harness, harness_payloads
from tidemark.streaming import ingest


@register(
    "stream_normalize",
    """select 'quotes' as dataset, count(*) as n, count(distinct o_orderkey) as records from orders
       union all select 'movers', count(*), count(distinct l_orderkey) from lineitem
       union all select 'rejected', count(*), count(distinct event_id) from events where event_type in ('error', 'view')""",
)
def stream_normalize(spark, sf):
    """Landed envelopes with repeats, read as a stream; each record is normalised once."""
    landing, output = scratch_path(spark, "landing"), scratch_path(spark, "normalized")
    quotes, movers = harness_payloads.quotes(spark, sf), harness_payloads.movers(spark, sf)
    bad = harness_payloads.event_envelopes(spark, sf).filter("dataset is null or dataset = 'other'")
    # As plain text the landed files are many times the tables that they are made of.
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    with settings(spark, FREES_SHUFFLES):
        for part in (quotes.unionByName(movers), bad.unionByName(quotes)):
            part.write.mode("append").options(**packed).json(landing)
    ingest.stream_normalize(ingest.read_envelopes(spark, landing, max_files=8), output, scratch_path(spark, "offsets")).awaitTermination()
    parts = [
        spark.read.parquet(f"{output}/{name}").select(F.lit(name).alias("dataset"), F.col(key).alias("record"))
        for name, key in (("quotes", "raw_record_id"), ("movers", "raw_record_id"), ("rejected", "record_id"))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record").alias("records"))


@register(
    "stream_append_history",
    """select event_type,
         count(*) filter (where not (event_id % 50 = 0 and day(ts) <= 20)) as events,
         count(distinct event_id) filter (where not (event_id % 50 = 0 and day(ts) <= 20)) as keys,
         2 * count(*) filter (where event_id % 50 = 0 and day(ts) <= 20)
           + count(*) filter (where event_id % 50 = 1 and day(ts) between 10 and 20) as conflicts
       from events group by event_type""",
)
def stream_append_history(spark, sf):
    """Event batches that overlap by key, appended as a stream; history holds each undisputed key once.

    Every fiftieth event of the first batch comes twice with different values,
    and its neighbour comes with another value in the second.
    """
    path, checkpoint = scratch_path(spark, "stream-history"), scratch_path(spark, "offsets")
    events = harness.read(spark, sf, "events").select("event_id", "event_type", "user_id", "value", F.dayofmonth("ts").alias("day"))
    disputed = events.filter("event_id % 50 = 0 and day <= 20").withColumn("value", F.col("value") + 1)
    later = events.filter("day >= 10 and not (event_id % 50 = 0 and day <= 20)")
    changed = later.withColumn("value", F.when(F.expr("event_id % 50 = 1 and day <= 20"), F.col("value") + 1).otherwise(F.col("value")))
    landing = scratch_path(spark, "batches")
    for part in (events.filter("day <= 20").unionByName(disputed), changed):
        part.write.mode("append").parquet(landing)
        source = spark.readStream.schema(events.schema).parquet(landing)
        ingest.stream_append_history(source, path, checkpoint, ["event_id"]).awaitTermination()
    kept = spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("keys"))
    aside = spark.read.parquet(f"{path}_conflicts").groupBy("event_type").agg(F.count(F.lit(1)).alias("conflicts"))
    return kept.join(aside, "event_type", "left").select("event_type", "events", "keys", F.coalesce("conflicts", F.lit(0).cast("long")).alias("conflicts"))
