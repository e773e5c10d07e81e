"""Option contracts and quotes derived from line items and parts; three runs, one per return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.harness import read

# Days to expiration by (order + line) modulo their number.
DTES = (0, 3, 5, 14, 21, 28, 45, 60, 90, 120, 200, 300, 400, 500)
BASE_DAY = "2002-01-01"


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """One quote per brand and run: the average retail price."""
    part = read(spark, sf, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    mark = F.sum(cents).cast("double") / F.count(F.lit(1)) / 100.0
    return (
        part.groupBy(F.col("p_brand").alias("symbol"))
        .agg(mark.alias("quote__mark"))
        .withColumn("run_id", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
        .withColumn("quote_row", F.lit(0))
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """One contract per line item."""
    lineitem = read(spark, sf, "lineitem")
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    spot = quotes(spark, sf).filter("run_id = 'A'").select(F.col("symbol").alias("p_brand"), F.col("quote__mark").alias("spot"))
    slot = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(DTES)).cast("int")
    dte = F.element_at(F.array(*[F.lit(d) for d in DTES]), slot + 1)
    call = F.col("l_orderkey") % 2 == 0
    factor = 0.90 + 0.02 * ((F.col("l_partkey") + F.col("l_linenumber")) % 11)
    bid = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") * (1 - F.col("l_discount")))
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(spot, "p_brand")
        .select(
            F.col("l_returnflag").alias("run_id"),
            F.col("p_brand").alias("underlying_symbol"),
            F.when(call, "CALL").otherwise("PUT").alias("put_call"),
            (F.floor(F.col("spot") * factor * 100) / 100.0).alias("strike"),
            dte.alias("expiration_dte"),
            F.date_add(F.lit(BASE_DAY).cast("date"), dte).alias("expiration_date"),
            bid.alias("bid"),
            (bid * (1 + 4 * F.col("l_tax"))).alias("ask"),
            (bid * (1 + 2 * F.col("l_tax"))).alias("mark"),
            (10 + 300 * F.col("l_discount")).alias("volatility"),
            F.when(call, F.col("l_quantity") / 50).otherwise(-F.col("l_quantity") / 50).alias("delta"),
            (F.col("l_tax") / 10).alias("gamma"),
            (-F.col("l_tax")).alias("theta"),
            F.col("l_tax").alias("vega"),
            (F.col("l_partkey") % 500).alias("openInterest"),
            (F.col("l_suppkey") % 50).alias("totalVolume"),
            F.col("l_quantity").alias("quote_age_minutes"),
            ((F.col("l_discount") - 0.05) * 40000).alias("percentChange"),
            F.col("l_linenumber").alias("contract_index"),
        )
    )


CONTRACTS_SQL = f"""
spots as (
  select p_brand, cast(sum(cast(round(p_retailprice * 100) as bigint)) as double) / count(*) / 100 as spot from part group by 1),
base as (
  select l.*, p_brand, spot, l_orderkey % 2 = 0 as is_call,
         ([{", ".join(map(str, DTES))}])[cast((l_orderkey + l_linenumber) % {len(DTES)} + 1 as integer)] as expiration_dte,
         case when l_linenumber = 7 then 0.0::double else l_quantity * (1 - l_discount) end as bid
  from lineitem l join part on l_partkey = p_partkey join spots using (p_brand)),
contracts as (
  select l_returnflag as run_id, upper(p_brand) as underlying_symbol, case when is_call then 'CALL' else 'PUT' end as put_call,
    spot, cast(floor(spot * (0.90::double + 0.02::double * ((l_partkey + l_linenumber) % 11)) * 100) as double) / 100 as strike,
    expiration_dte, cast(date '{BASE_DAY}' + expiration_dte as date) as expiration_date, bid,
    bid * (1 + 4 * l_tax) as ask, bid * (1 + 2 * l_tax) as mark, 10 + 300 * l_discount as volatility,
    case when is_call then l_quantity / 50 else -l_quantity / 50 end as delta, l_tax / 10 as gamma, -l_tax as theta,
    l_tax as vega, cast(l_partkey % 500 as double) as oi, cast(l_suppkey % 50 as double) as volume,
    l_quantity as quote_age_minutes, (l_discount - 0.05::double) * 40000 as percent_change, l_linenumber as contract_index
  from base)"""
