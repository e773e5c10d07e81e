"""Queries on tiled products, long windows, stored profiles, hash trees, range joins and the exchange calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exchange_calendar
from tidemark.operators import covariance, hash_tree, market_features, periods, profile_store, profiling, ranges, regimes, tiles
from tidemark.plans.catalog import register
from tidemark.plans.common import DAILY_SQL, RULE_RESULTS_SQL, SUMMARY_COLUMNS, SUMMARY_SELECT, closes, daily, r, rounded, rounded_small, rule_results, summary_sql
from tidemark.plans.history import _FIELDS, _HASH_SQL, _LINES_SQL, _SUMS, _lines
from tidemark.plans.market_features import _PAIR_SQL, _frame
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import harness, tables

# Returns of many assets: the mean discount of a supplier's shipments in a month, in integer cents before the division.
_SUPPLIER_SQL = """
supplied as (
  select 'N' || (s_nationkey % 3) as universe_id, cast(date_trunc('month', l_shipdate) as date) as session, 'S' || s_suppkey as asset,
         sum(cast(round(l_discount * 100) as bigint))::double / count(*) / 100 as ret
  from lineitem join supplier on l_suppkey = s_suppkey group by all)"""


def supplier_returns(spark, sf):
    lines = harness.read(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", F.round(F.col("l_discount") * 100).cast("long").alias("cents"))
    supplier = harness.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    month = F.trunc(F.to_date("l_shipdate"), "month").alias("session")
    universe = F.concat(F.lit("N"), (F.col("s_nationkey") % 3).cast("string")).alias("universe_id")
    joined = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return joined.groupBy(universe, month, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("asset")).agg(
        (F.sum("cents").cast("double") / F.count(F.lit(1)) / 100).alias("ret")
    )


def _tasks(spark):
    """Tasks for rows that far outgrow what they are made of: some for each core."""
    return 4 * spark.sparkContext.defaultParallelism


@register(
    "supplier_pair_moments",
    f"""with {_SUPPLIER_SQL}
    select universe_id, a.asset as asset_i, b.asset as asset_j, count(*) as n, {r("covar_pop(a.ret, b.ret)", 9, "cov")},
           {r("sum(a.ret * a.ret * b.ret * b.ret)", 9, "s_iijj")}, {r("sum(a.ret * b.ret * b.ret)", 9, "s_ijj")}, {r("sum(a.ret)", 9, "s_i")}
    from supplied a join supplied b using (universe_id, session) where a.asset <= b.asset group by all""",
)
def supplier_pair_moments(spark, sf):
    """Many assets with gaps: several tiles per universe, and pairs over the months that both have."""
    rets = cut_lineage(supplier_returns(spark, sf), "returns")
    sums = tiles.pair_sums(rets, tile=16, tasks=_tasks(spark))
    n = F.col("n")
    cov = F.col("s_ij") / n - (F.col("s_i") / n) * (F.col("s_j") / n)
    return rounded_small(sums.select("universe_id", "asset_i", "asset_j", "n", cov.alias("cov"), "s_iijj", "s_ijj", "s_i"), 9, "cov", "s_iijj", "s_ijj", "s_i")


@register(
    "supplier_trailing_correlation",
    f"""with {_SUPPLIER_SQL},
    pairs as (
      select universe_id, session, a.asset as asset_i, b.asset as asset_j, case when count(*) over w = 12 then corr(a.ret, b.ret) over w end as corr
      from supplied a join supplied b using (universe_id, session) where a.asset < b.asset
      window w as (partition by universe_id, a.asset, b.asset order by session rows between 11 preceding and current row))
    select universe_id, session, asset_i, asset_j, {r("corr", 6)} from pairs where month(session) = 12""",
)
def supplier_trailing_correlation(spark, sf):
    rets = cut_lineage(supplier_returns(spark, sf), "returns")
    marks = rets.select("universe_id", "session").filter(F.month("session") == 12)
    return rounded_small(tiles.trailing_correlations(rets, 12, marks, tile=16, tasks=_tasks(spark)), 6, "corr")


@register(
    "month_end_pair_correlation",
    f"""with {DAILY_SQL}, {_PAIR_SQL},
    ends as (select universe_id, max(session) as session from returns group by universe_id, date_trunc('month', session))
    select universe_id, session, asset_i, asset_j, {r("corr", 6)} from pairs join ends using (universe_id, session)""",
)
def month_end_pair_correlation(spark, sf):
    rets = cut_lineage(daily(spark, sf))
    ends = periods.month_end_dates(rets).select("universe_id", F.col("month_end").alias("session"))
    return rounded(covariance.trailing_pair_correlation(rets, 63, ends), 6, "corr")


_LONG = (21, 63, 126, 1000)
_LONG_CELLS = [f"{kind}_{n}d" for n in _LONG for kind in ("return", "vol", "drawdown")]


@register(
    "long_windows",
    f"""with {DAILY_SQL},
    wealth as (
      select *, product(1 + ret) over (partition by universe_id, asset order by session rows unbounded preceding) as wealth,
             count(ret) over (partition by universe_id, asset order by session rows unbounded preceding) as history from returns),
    trail as (
      select universe_id, session, asset, history, {", ".join(
          f"case when history >= {n} then product(1 + ret) {_frame(n)} - 1 end as return_{n}d, "
          f"case when history >= {n} then stddev_samp(ret) {_frame(n)} * sqrt(252) end as vol_{n}d, "
          f"case when history >= {n} then wealth / max(wealth) {_frame(n)} - 1 end as drawdown_{n}d" for n in _LONG)} from wealth)
    select universe_id, session, asset, history, {", ".join(r(f"{c} + 1e-13", 9, c) for c in _LONG_CELLS)} from trail""",
)
def long_windows(spark, sf):
    # Ratios of closes often end on the edge of the grid; both engines look a little beside it.
    rows = market_features.trailing_features(daily(spark, sf), _LONG, _LONG, _LONG)
    return rounded(rows.withColumns({c: F.col(c) + 1e-13 for c in _LONG_CELLS}), 9, *_LONG_CELLS)


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@register(
    "stored_profile",
    "with years as (select count(distinct year(l_shipdate)) as runs from lineitem)\n"
    + "\nunion all ".join(
        f"""select '{c}' as "column", runs, count(*) as rows, count({c}) as non_null_count, {r(f"min({c}::double)" if c in _LINE_NUMBERS else "null::double", 6, "min")},
        {r(f"max({c}::double)" if c in _LINE_NUMBERS else "null::double", 6, "max")}, {r(f"avg({c}::double)" if c in _LINE_NUMBERS else "null::double", 5, "mean")},
        true as distinct_within, true as ranks_within, (select count(*) from (select distinct year(l_shipdate) as y from lineitem) where y > 1996) as runs_added_last
        from lineitem, years group by runs"""
        for c in (*_LINE_NUMBERS, *_LINE_TEXTS)
    ),
)
def stored_profile(spark, sf):
    """Two appends of runs (ship years); the profile comes from stored sketches and is held against exact counts and ranks."""
    path = scratch_path(spark, "profiles")
    table = harness.read(spark, sf, "lineitem").select(*_LINE_NUMBERS, *_LINE_TEXTS, F.year("l_shipdate").alias("year"))
    profile_store.append_runs(table.filter("year <= 1996"), "year", path)
    held = profile_store.append_runs(table, "year", path)
    profile = cut_lineage(profile_store.united(profile_store.stored(spark, path, table.schema["year"].dataType)), "united")
    exact = profiling.distinct_counts(table.drop("year"))
    errors = profile_store.rank_errors(table.drop("year"), profile)
    near = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= F.greatest(F.lit(1.0), profile_store.DISTINCT_ERROR * F.col("unique_count"))
    joined = profile.join(exact, "column").join(errors, "column", "left").crossJoin(held.agg(F.count_if("new").alias("runs_added_last")))
    out = joined.select(
        "column", "runs", "rows", "non_null_count", "min", "max", "mean", near.alias("distinct_within"),
        (F.coalesce("rank_error", F.lit(0.0)) <= profile_store.RANK_ERROR).alias("ranks_within"), "runs_added_last",
    )
    return rounded(rounded(out, 6, "min", "max"), 5, "mean")


def _levels():
    return {"year": F.year("l_shipdate"), "month": F.month("l_shipdate")}


_VERSIONS_SQL = f"""{_LINES_SQL},
before as (select year(l_shipdate)::varchar as year, month(l_shipdate)::varchar as month, l_orderkey, l_linenumber, {_HASH_SQL} as h from lines),
changed_lines as (
  select * replace (case when year(l_shipdate) = 1997 and month(l_shipdate) = 3 and l_orderkey % 7 = 3 then l_suppkey + 1 else l_suppkey end as l_suppkey)
  from lines where not (year(l_shipdate) = 1999 and month(l_shipdate) in (5, 11) and (l_orderkey % 2 = 0 or month(l_shipdate) = 5))),
after as (
  select year(l_shipdate)::varchar as year, month(l_shipdate)::varchar as month, l_orderkey, l_linenumber, {_HASH_SQL} as h from changed_lines
  union all select '2031' as year, '1' as month, l_orderkey, l_linenumber, {_HASH_SQL.replace("'shipped_on': shipped_on", "'shipped_on': '2031-01-' || substr(shipped_on, 9, 2)")} as h
  from lines where l_orderkey % 50 = 0)"""


def _versions(spark, sf):
    before = _lines(spark, sf)
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    gone = (year == 1999) & (((month == 11) & (F.col("l_orderkey") % 2 == 0)) | (month == 5))
    other = F.when((year == 1997) & (month == 3) & (F.col("l_orderkey") % 7 == 3), F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))
    changed = before.filter(~gone).withColumn("l_suppkey", other.cast(before.schema["l_suppkey"].dataType))
    late = F.concat(F.lit("2031-01-"), F.date_format("l_shipdate", "dd"))
    added = before.filter("l_orderkey % 50 = 0").withColumn("shipped_on", late).withColumn("l_shipdate", F.to_date(late).cast(before.schema["l_shipdate"].dataType))
    return before, changed, added


_NODE_SQL = "count(*) as rows, " + _SUMS
_TREE_SQL = """
select 0 as level, null as year, null as month, {0} from {1}
union all select 1, year, null, {0} from {1} group by year
union all select 2, year, month, {0} from {1} group by year, month"""


@register(
    "hash_tree",
    f"""with {_VERSIONS_SQL}, nodes as ({_TREE_SQL.format(_NODE_SQL, "after")})
    select level, year, month, rows, sha256(concat_ws('|', rows, s0, s1)) as digest from nodes""",
)
def hash_tree_of_lines(spark, sf):
    """The tree of a version and an append, made from the version's tree and the appended rows alone."""
    _, changed, added = _versions(spark, sf)
    tree = cut_lineage(hash_tree.build(changed, _FIELDS, _levels()), "tree")
    return hash_tree.appended(tree, added, _FIELDS, _levels()).select("level", "year", "month", "rows", "digest")


@register(
    "changed_ranges",
    f"""with {_VERSIONS_SQL}, x as ({_TREE_SQL.format(_NODE_SQL, "before")}), y as ({_TREE_SQL.format(_NODE_SQL, "after")})
    select coalesce(x.level, y.level) as level, coalesce(x.year, y.year) as year, coalesce(x.month, y.month) as month,
           case when x.level is null then 'ADDED' when y.level is null then 'REMOVED' else 'CHANGED' end as change,
           x.rows as rows_before, y.rows as rows_after
    from x full join y on x.level = y.level and x.year is not distinct from y.year and x.month is not distinct from y.month
    where x.level is null or y.level is null or x.rows <> y.rows or x.s0 <> y.s0 or x.s1 <> y.s1""",
)
def changed_ranges(spark, sf):
    return _changed(spark, sf)[2]


def _changed(spark, sf):
    before, changed, added = _versions(spark, sf)
    after = changed.unionByName(added)
    trees = [cut_lineage(hash_tree.build(t, _FIELDS, _levels()), "tree") for t in (before, after)]
    return before, after, hash_tree.changed(*trees, list(_levels()))


_ONCE_COLUMNS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"]
_ONCE_TREE = """
select 0 as level, null as year, null as month, count(*) as rows, sum(hash(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate)) as s from {0}
union all select 1, year(l_shipdate)::varchar, null, count(*), sum(hash(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate)) from {0} group by 2
union all select 2, year(l_shipdate)::varchar, month(l_shipdate)::varchar, count(*), sum(hash(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate)) from {0} group by 2, 3"""


@register(
    "write_once_ranges",
    f"""with after as (
      select * replace (case when year(l_shipdate) = 1997 and month(l_shipdate) = 3 and l_orderkey % 7 = 3 then l_suppkey + 1 else l_suppkey end as l_suppkey)
      from lineitem where not (year(l_shipdate) = 1999 and month(l_shipdate) in (5, 11) and (l_orderkey % 2 = 0 or month(l_shipdate) = 5))),
    x as ({_ONCE_TREE.format("lineitem")}), y as ({_ONCE_TREE.format("after")})
    select coalesce(x.level, y.level) as level, coalesce(x.year, y.year) as year, coalesce(x.month, y.month) as month,
           case when x.level is null then 'ADDED' when y.level is null then 'REMOVED' else 'CHANGED' end as change,
           x.rows as rows_before, y.rows as rows_after, 'CREATED,EXISTS,1997/3 CHANGED, 1999/11 CHANGED, 1999/5 REMOVED' as outcomes
    from x full join y on x.level = y.level and x.year is not distinct from y.year and x.month is not distinct from y.month
    where x.level is null or y.level is null or x.rows <> y.rows or x.s <> y.s""",
)
def write_once_ranges(spark, sf):
    """A table written once with its hash tree, an identical rerun, and one with other content, whose ranges are named without reading the stored rows."""
    before, changed, _ = (t.select(*_ONCE_COLUMNS) for t in _versions(spark, sf))
    path = scratch_path(spark, "once")
    outcomes = [tables.write_once(before, path, _levels()), tables.write_once(before.repartition("l_orderkey", "l_linenumber"), path, _levels())]
    try:
        tables.write_once(changed, path, _levels())
    except tables.ContentChanged as error:
        outcomes.append(str(error).split(" differs in ")[1])
    return tables.changed_since(changed, path, _levels()).withColumn("outcomes", F.lit(",".join(outcomes)))


@register(
    "changed_rows",
    f"""with {_VERSIONS_SQL},
    differing as (
      select coalesce(x.year, y.year) as year, coalesce(x.month, y.month) as month
      from (select year, month, {_NODE_SQL} from before group by 1, 2) x full join (select year, month, {_NODE_SQL} from after group by 1, 2) y
        on x.year = y.year and x.month = y.month where x.year is null or y.year is null or x.s0 <> y.s0 or x.s1 <> y.s1),
    b as (select l_orderkey, l_linenumber, list_sort(list(h)) as h from before semi join differing using (year, month) group by 1, 2),
    a as (select l_orderkey, l_linenumber, list_sort(list(h)) as h from after semi join differing using (year, month) group by 1, 2)
    select coalesce(b.l_orderkey, a.l_orderkey) as l_orderkey, coalesce(b.l_linenumber, a.l_linenumber) as l_linenumber,
           case when b.h is null then 'ADDED' when a.h is null then 'REMOVED' else 'CHANGED' end as change
    from b full join a on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.h is distinct from b.h""",
)
def changed_rows(spark, sf):
    """Rows are compared in the months whose digests differ only."""
    before, after, differing = _changed(spark, sf)
    return hash_tree.changed_rows(before, after, ["l_orderkey", "l_linenumber"], _FIELDS, _levels(), differing)


@register(
    "activity_ranges",
    f"""with {DAILY_SQL},
    activity as (
      select o_custkey, any_value(c_mktsegment) as asset, min(cast(o_orderdate as date)) as first_day, max(cast(o_orderdate as date)) as last_day
      from orders join customer on o_custkey = c_custkey group by o_custkey)
    select o_custkey, count(*) as sessions, {r("sum(ret)", 8, "total")} from activity a join returns t on t.asset = a.asset and session between first_day and last_day
    group by o_custkey""",
)
def activity_ranges(spark, sf):
    """Each customer's range of order days, which overlap by the thousand, with the sessions of its segment inside."""
    orders, customer = harness.read(spark, sf, "orders"), harness.read(spark, sf, "customer")
    day = F.to_date("o_orderdate")
    spans = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("o_custkey", F.col("c_mktsegment").alias("asset"))
        .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    )
    met = ranges.join_ranges(daily(spark, sf), "session", spans, "first_day", "last_day", ["asset"])
    return rounded(met.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sessions"), F.sum("ret").alias("total")), 8, "total")


_YEAR_RANGES_SQL = """
years as (select distinct year(o_orderdate) as y from orders),
named(universe_id, regime, lo, hi) as (
  select 'ALL', 'year ' || y, make_date(y, 1, 1), make_date(y, 12, 31) from years
  union all select 'ALL', 'three years from ' || y, make_date(y, 1, 1), make_date(y + 2, 12, 31) from years)"""


@register(
    "regimes_from_table",
    f"""with {RULE_RESULTS_SQL}, {_YEAR_RANGES_SQL},
    tagged as (select regime, results.* from results join named on results.universe_id = named.universe_id and period_end between lo and hi),
    {summary_sql("tagged", "regime, universe_id, model", "period_end", "net_return")}
    select regime, universe_id, model, {SUMMARY_SELECT} from summary""",
)
def regimes_from_table(spark, sf):
    """Named ranges per universe as a table."""
    years = harness.read(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    named = [(F.concat(F.lit("year "), F.col("y")), 0), (F.concat(F.lit("three years from "), F.col("y")), 2)]
    parts = [years.select(F.lit("ALL").alias("universe_id"), name.alias("regime"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date(F.col("y") + k, F.lit(12), F.lit(31)).alias("stop")) for name, k in named]
    return rounded(regimes.regimes_from_table(rule_results(spark, sf), parts[0].union(parts[1])), 6, *SUMMARY_COLUMNS)


# Days by rank of their weekday in the month, and Easter by another formula than the operator's.
_CALENDAR_SQL = f"""
days as (
  select d::date as day, year(d) as y, month(d) as m, day(d) as dd, dayofweek(d) as w,
         row_number() over (partition by year(d), month(d), dayofweek(d) order by d) as nth,
         row_number() over (partition by year(d), month(d), dayofweek(d) order by d desc) as from_end
  from (select unnest(generate_series(date_trunc('year', (select min(o_orderdate) from orders))::date, date '2031-12-31', interval 1 day)) as d)),
golden as (select distinct y, y % 19 as a, y // 100 as b, y % 100 as c from days),
epact as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from golden),
sunday as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from epact),
easter as (select y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) as sunday from sunday),
closed as (
  select day from days where w in (0, 6)
  union select day from days where (m = 1 and dd = 1) or (m = 1 and dd = 2 and w = 1)
  union select day from days where m = 1 and w = 1 and nth = 3 and y >= 1998
  union select day from days where m = 2 and w = 1 and nth = 3
  union select sunday - 2 from easter
  union select day from days where m = 5 and w = 1 and from_end = 1
  union select day from days where y >= 2022 and m = 6 and (dd = 19 or (dd = 18 and w = 5) or (dd = 20 and w = 1))
  union select day from days where m = 7 and (dd = 4 or (dd = 3 and w = 5) or (dd = 5 and w = 1))
  union select day from days where m = 9 and w = 1 and nth = 1
  union select day from days where m = 11 and w = 4 and nth = 4
  union select day from days where m = 12 and (dd = 25 or (dd = 24 and w = 5) or (dd = 26 and w = 1))
  union select unnest([{", ".join(f"date '{d}'" for d in exchange_calendar.SPECIAL_CLOSES)}])),
open_days as (select day, lead(day) over (order by day) as following from days anti join closed using (day))"""


@register("exchange_sessions", f"with {_CALENDAR_SQL} select day as session, following as next_session from open_days where day <= date '2030-12-31'")
def exchange_sessions(spark, sf):
    """Every session from the first year of the orders through 2030, with the one after it."""
    first = harness.read(spark, sf, "orders").agg(F.trunc(F.to_date(F.min("o_orderdate")), "year").alias("first"))
    days = first.select(F.explode(F.sequence("first", F.lit("2030-12-31").cast("date"))).alias("session"))
    return days.filter(exchange_calendar.is_session(F.col("session"))).select("session", exchange_calendar.next_session(F.col("session")).alias("next_session"))


@register(
    "information_dates",
    f"""with {_CALENDAR_SQL},
    asked as (select distinct cast(o_orderdate as date) as day from orders),
    ends as (select date_trunc('month', day)::date as month, max(day) as month_end from open_days group by 1),
    placed as (
      select a.day, o.day is not null as is_session, month_end, (select min(n.day) from open_days n where n.day > a.day) as effective_from
      from asked a left join open_days o using (day) join ends on month = date_trunc('month', a.day))
    select *, case when not is_session then 'NO_SESSION' when day <> month_end then 'NOT_MONTH_END' end as problem from placed""",
)
def information_dates(spark, sf):
    asked = harness.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return exchange_calendar.information_dates(asked, "day")
