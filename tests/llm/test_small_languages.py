"""Languages of one document beside a very large one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import language_id


def test_small_languages_are_learned(spark):
    many = spark.range(110_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("abc "), F.col("id").cast("string"), F.lit(" abab")).alias("text"))
    few = spark.createDataFrame([(f"l{i:02}", f"{chr(0x4E00 + 9 * i) * 4} {chr(0x4E00 + 9 * i) * 3}") for i in range(40)], "lang string, text string")
    rows = many.unionByName(few).withColumn("doc_id", F.lit(None).cast("long"))
    found = language_id.identify(rows).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in found} == {"aa": 110_000, **{f"l{i:02}": 1 for i in range(40)}}
