"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    chat_format,
    decontaminate,
    language_id,
    lexical_search,
    ngram_join,
    packing,
    periodic_runs,
    suffix_dedup,
    token_counts,
    token_files,
    top_k,
    url_filter,
    window_packing,
)
from tidemark.session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op9_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(_table(spark, sf, "documents"))


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf, "documents"), size=3, num=90, den=100)


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf, "documents"), length=200)


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    token_files.write(_table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.scan(spark, path)


def op5_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    written = cut_lineage(chat_format.format_chats(rows.unionByName(probe)), "formatted")
    return chat_format.digests(written)


#: What the edits of op6 replace: mail addresses and runs of digits as in cards and telephone numbers.
_PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[0-9][0-9 -]{6,}[0-9]"


def op6_edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    trees = cut_lineage(token_counts.build(docs, vocabulary), "trees")
    edited = docs.withColumn("edits", token_counts.replacements(F.col("text"), _PERSONAL, "<removed>"))
    return token_counts.recount(edited, trees, vocabulary)


#: Fixed rules of the query: verdict, host, path.
_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hosts of the corpus that count as listed for pages without a rule.
_LISTED = r"(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]"


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf, "pages"), _RULES, F.col("host").rlike(_LISTED))


def op8_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return top_k.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents, those whose checksum h of the doc_id ends in 0 with their tail put in a loop; rows without a doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = F.col("at") + F.pmod(F.col("i") - F.col("at"), F.col("period"))
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", h)
    chosen = F.coalesce((F.col("h") % 10 == 0) & (F.length("text") > 0), F.lit(False))
    cut = said.filter(chosen).withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = cut.withColumn("at", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("period", 1 + F.floor((F.col("n") - F.col("at")) / (3 + F.col("g") % 8)))
    order = F.expr("transform(sequence(0, n - 1), i -> element_at(words, cast(if(i < at, i, at + (i - at) % period) as int) + 1))")
    again = placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(order, " ")).otherwise(F.lit("")).alias("text"))
    return said.filter(~chosen).select("doc_id", "text").union(again)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.detect(looped(_table(spark, sf, "documents")), min_length=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=10)


def op13_window_packing(spark: SparkSession, sf: str) -> DataFrame:
    return window_packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=2)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_ngram_join, op2_chat_format, op3_suffix_dedup, op4_token_files, op5_best_two_fit, op6_edit_counts, op7_url_filter, op8_top_k, op9_string_tiling, op10_language_id,
        op11_periodic_runs, op12_lexical_search, op13_window_packing,
    )} | {"pipeline": corpus_pipeline.run}


_LISTED_RE2 = _LISTED.replace("'", "''")

_OP7_SQL = f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), rules(verdict, rule_host, rule_path) as (
  values {", ".join(str(r) for r in _RULES)}
), fitting as (
  select page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := rules.verdict), length(rule_host) + length(rule_path)) as best
  from parsed join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
)
select page_id, host, path, best.rule as rule,
  coalesce(best.verdict, case when regexp_matches(host, '{_LISTED_RE2}') then 'block' else 'allow' end) as verdict
from parsed left join fitting using (page_id)
"""

_OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, x -> floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), p -> coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 10
"""

#: Roles and texts come back as they were, so the digests follow from the table; formatted_chars counts the level-0 markup, which only -7 leaves.
_OP2_SQL = """
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (9 + sum(length(text) + case when role = 'assistant' then 7 else length(role) + 14 end) + case when conv_id = -7 then 2 * 3 else 0 end)::bigint as formatted_chars
from said group by conv_id
"""


_OP12_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"

_OP12_SQL = f"""
with numbered as (
  select doc_id, text, row_number() over () as line from documents
), said as (
  select line, doc_id, {_OP12_TERMS} from numbered
), postings as (
  select line, doc_id, term, count(*) as tf from said group by all
), lengths as (
  select line, sum(tf)::bigint as n from postings group by line
), totals as (
  select count(*) as docs, sum(n)::bigint as words from lengths
), held as (
  select term, count(*) as df from postings group by term
), asked as (
  select distinct item_id, {_OP12_TERMS} from benchmark
), weights as (
  select item_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from asked join held using (term), totals
), scored as (
  select item_id, line, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::bigint as score
  from weights join postings using (term) join lengths using (line), totals group by item_id, line
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _OP2_SQL, "op7_url_filter": _OP7_SQL, "op8_top_k": _OP8_SQL, "op12_lexical_search": _OP12_SQL}
