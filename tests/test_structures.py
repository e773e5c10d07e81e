"""Tiled products, sliding windows, ranks, stored profiles, hash trees, range joins and the exchange calendar against direct computation."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exchange_calendar
from tidemark.operators import covariance, hash_tree, profile_store, profiling, ranges, ranks, sliding, tiles

RETURNS = "universe_id string, session date, asset string, ret double"


@pytest.fixture(scope="module")
def gappy(spark):
    """Two universes, assets that come and go, 400 sessions over two years."""
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2023-03-01", periods=400).date
    rows = []
    for universe, assets in (("A", 23), ("B", 2)):
        common = rng.normal(0, 0.01, 400)
        for a in range(assets):
            there = rng.random(400) < (1.0 if a % 3 else 0.7)
            if a == 4:
                there[:260] = False
            rows += [(universe, d, f"{a:02d}", float(common[i] * a / 9 + rng.normal(0, 0.01))) for i, d in enumerate(days) if there[i]]
    return pd.DataFrame(rows, columns=["universe_id", "session", "asset", "ret"]), spark.createDataFrame(rows, RETURNS).repartition(5)


@pytest.mark.parametrize("by_month", [False, True])
def test_tiled_sums_are_those_of_all_pairs(gappy, by_month):
    pdf, df = gappy
    keys = ["universe_id", "asset_i", "asset_j"] + ["month"] * by_month
    got = tiles.pair_sums(df, by_month, tile=5).toPandas().set_index(keys).sort_index()
    both = pdf.merge(pdf, on=["universe_id", "session"], suffixes=("_i", "_j")).query("asset_i <= asset_j")
    x, y = both["ret_i"], both["ret_j"]
    both = both.assign(n=1, s_i=x, s_j=y, s_ii=x * x, s_jj=y * y, s_ij=x * y, s_iij=x * x * y, s_ijj=x * y * y, s_iijj=x * x * y * y)
    both["month"] = both["session"].map(lambda d: d.replace(day=1))
    want = both.groupby(keys)[list(tiles.SUMS)].sum().sort_index()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got[list(tiles.SUMS)].to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-15)
    if by_month:
        assert (got["month_end"] == both.groupby(keys)["session"].max().sort_index()).all()


@pytest.mark.parametrize("marked", [False, True])
def test_tiled_correlations_are_those_of_all_pairs(spark, gappy, marked):
    pdf, df = gappy
    last = pdf["session"].max()
    marks = spark.createDataFrame([(u, d) for u in "AB" for d in (last, last - dt.timedelta(days=200), dt.date(2023, 3, 8))], "universe_id string, session date")
    got = tiles.trailing_correlations(df, 21, marks if marked else None, tile=6).toPandas()
    both = pdf.merge(pdf, on=["universe_id", "session"], suffixes=("_i", "_j")).query("asset_i < asset_j").sort_values("session")
    parts = []
    for (u, a, b), g in both.groupby(["universe_id", "asset_i", "asset_j"]):
        parts.append(pd.DataFrame({"universe_id": u, "session": g["session"], "asset_i": a, "asset_j": b, "want": g["ret_i"].rolling(21).corr(g["ret_j"])}))
    want = pd.concat(parts)
    if marked:
        asked = {(r.universe_id, r.session) for r in marks.collect()}
        want = want[[(u, s) in asked for u, s in zip(want["universe_id"], want["session"])]]
    met = got.merge(want, on=["universe_id", "session", "asset_i", "asset_j"], how="outer", indicator=True)
    assert (met["_merge"] == "both").all() and len(met) == len(want)
    np.testing.assert_allclose(met["corr"].to_numpy(dtype=float), met["want"].to_numpy(), atol=1e-9)


def test_no_row_per_session_and_pair(gappy):
    plan = covariance.ledoit_wolf(gappy[1])._jdf.queryExecution().executedPlan().toString()
    first = plan.index("MapInArrow")
    assert "Join" in plan and "session" not in plan[:first].replace("mapInArrow", "")


def test_sliding_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.normal(1, 0.1))) for s, n in (("a", 130), ("b", 7), ("c", 1), ("d", 64)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, at int, x double").repartition(3)
    lengths = (1, 2, 5, 64, 1000)
    wanted = {f"{k}{n}": (k, "x", n) for k in (sliding.PRODUCT, sliding.MAXIMUM, sliding.MOMENTS) for n in lengths}
    got = sliding.trailing(df, ["series"], "at", wanted).toPandas().sort_values(["series", "at"])
    for _, g in got.groupby("series"):
        for n in lengths:
            roll = g["x"].rolling(n, min_periods=1)
            full = np.arange(1, len(g) + 1) >= n
            for kind, want in ((sliding.PRODUCT, roll.apply(np.nanprod)), (sliding.MAXIMUM, roll.max()), (sliding.MOMENTS, roll.std())):
                np.testing.assert_allclose(g[f"{kind}{n}"].to_numpy(dtype=float), np.where(full, want, np.nan), atol=1e-9)


def test_sliding_cost_does_not_grow_with_the_window(spark):
    df = spark.range(10).withColumn("series", F.lit("s")).withColumn("x", F.rand(1))
    plan = sliding.trailing(df, ["series"], "id", {"p": (sliding.PRODUCT, "x", 1000)})._jdf.queryExecution().toString()
    assert "-999, currentrow" not in plan


def test_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k == 2 else f"g{k}", float(v)) for k in range(4) for v in rng.integers(0, 40, 1 + 700 * k)]
    rows += [("g1", 7.0)] * 3000  # one value has most rows
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    got = ranks.average_ranks(df, ["g"], "v", "rank").toPandas()
    pdf["rank"] = pdf.groupby("g", dropna=False)["v"].rank()
    want = pdf.drop_duplicates(["g", "v"])
    met = got.merge(want, on=["g", "v"], how="outer")
    assert len(met) == len(got) == len(want) and (met["rank_x"] == met["rank_y"]).all()
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    for r in ranks.percentiles(df, ["g"], "v", probs).collect():
        mine = pdf[pdf["g"].isna() if r["g"] is None else pdf["g"] == r["g"]]["v"]
        np.testing.assert_allclose(r["percentiles"], mine.quantile(probs))
    assert ranks.percentiles(df, [], "v", [0.5]).first()["percentiles"] == [pdf["v"].median()]
    assert ranks.distinct_ranks(df.limit(0), ["g"], ["v"]).count() == 0


def test_profiles_from_stored_sketches(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i % 5), float(rng.lognormal(3, 2)), f"k{rng.integers(0, 3000)}", None) for i in range(20000)]
    rows += [(4, None, None, None), (4, float("nan"), "x", None)]
    df = spark.createDataFrame(rows, "run int, x double, name string, never double")
    path = f"{tmp_path}/profiles"
    first = profile_store.append_runs(df.filter("run < 3"), "run", path)
    assert {(r["run"], r["new"]) for r in first.collect()} == {(0, True), (1, True), (2, True)}
    # Rows of a run on record are not read again, whatever they hold by now.
    second = profile_store.append_runs(df.withColumn("x", F.when(F.col("run") < 3, F.lit(-1e9)).otherwise(F.col("x"))), "run", path)
    assert {r["run"] for r in second.collect() if r["new"]} == {3, 4}
    profile = profile_store.united(profile_store.stored(spark, path, df.schema["run"].dataType))
    got = {r["column"]: r for r in profile.collect()}
    assert got["x"]["rows"] == 20002 and got["x"]["non_null_count"] == 20001 and got["x"]["runs"] == 5
    numbers = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    assert got["x"]["min"] == min(numbers) and got["x"]["max"] == max(numbers) and abs(got["x"]["mean"] - np.mean(numbers)) < 1e-6
    exact = {r["column"]: r["unique_count"] for r in profiling.distinct_counts(df.drop("run")).collect()}
    assert abs(got["name"]["unique_estimate"] - exact["name"]) <= profile_store.DISTINCT_ERROR * exact["name"]
    assert got["never"]["median_estimate"] is None and got["never"]["unique_estimate"] == 0
    errors = {r["column"]: r["rank_error"] for r in profile_store.rank_errors(df.drop("run"), profile).collect()}
    assert 0 <= errors["x"] <= profile_store.RANK_ERROR


def test_hash_tree(spark):
    levels = {"year": F.year("day"), "month": F.month("day")}
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(300)]
    rows = [(i, d, i * 2) for i, d in enumerate(days)] + [(9000, None, 1)]
    schema = "id int, day date, value int"
    columns = ["id", "day", "value"]
    before = spark.createDataFrame(rows, schema)
    edited = [(i, d, v + 1 if i == 5 else v) for i, d, v in rows if i not in (100, 101)] + [(7000, dt.date(2031, 5, 1), 1)]
    after = spark.createDataFrame(edited, schema).repartition(4)
    x, y = (hash_tree.build(t, columns, levels) for t in (before, after))
    found = {(r["level"], r["year"], r["month"]): r["change"] for r in hash_tree.changed(x, y, list(levels)).collect()}
    gone = {(2, str(days[i].year), str(days[i].month)): "CHANGED" for i in (100, 101)}
    assert found == gone | {
        (0, None, None): "CHANGED", (1, "2020", None): "CHANGED", (2, "2020", "1"): "CHANGED", (1, "2031", None): "ADDED", (2, "2031", "5"): "ADDED",
    }
    differing = hash_tree.changed(x, y, list(levels))
    changes = {(r["id"], r["change"]) for r in hash_tree.changed_rows(before, after, ["id"], columns, levels, differing).collect()}
    assert changes == {(5, "CHANGED"), (100, "REMOVED"), (101, "REMOVED"), (7000, "ADDED")}
    same = hash_tree.changed(x, hash_tree.build(before.repartition(7), columns, levels), list(levels))
    assert same.count() == 0
    batch = spark.createDataFrame([(1, dt.date(2020, 2, 2), 3), (2, None, 4)], schema)
    grown = {tuple(r) for r in hash_tree.appended(x, batch, columns, levels).select("level", "year", "month", "rows", "digest").collect()}
    whole = {tuple(r) for r in hash_tree.build(before.union(batch), columns, levels).select("level", "year", "month", "rows", "digest").collect()}
    assert grown == whole


def test_ranges_meet_each_day_once(spark):
    rng = np.random.default_rng(8)
    start = dt.date(1969, 12, 1)
    day = lambda k: start + dt.timedelta(days=int(k))
    spans = [(i, "u" if i % 2 else "v", day(a), day(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 3000, 400), rng.integers(-2, 900, 400)))]
    spans += [(1000, "u", dt.date(1900, 1, 1), dt.date(2199, 12, 31)), (1001, "u", None, day(5)), (1002, None, day(1), day(9))]
    points = [(i, "u" if i % 3 else "v", day(k)) for i, k in enumerate(rng.integers(0, 4000, 500))] + [(900, "u", None)]
    left = spark.createDataFrame(points, "p int, k string, day date")
    right = spark.createDataFrame(spans, "s int, k string, lo date, hi date")
    joined = ranges.join_ranges(left, "day", right, "lo", "hi", ["k"])
    got = sorted((r["p"], r["s"]) for r in joined.collect())
    assert got == sorted((p, s) for p, k, d in points for s, u, lo, hi in spans if d and lo and k == u and lo <= d <= hi)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_exchange_calendar(spark):
    known = {
        1999: ["01-01", "01-18", "02-15", "04-02", "05-31", "07-05", "09-06", "11-25", "12-24"],
        2004: ["01-01", "01-19", "02-16", "04-09", "05-31", "06-11", "07-05", "09-06", "11-25", "12-24"],
        2011: ["01-17", "02-21", "04-22", "05-30", "07-04", "09-05", "11-24", "12-26"],
        2012: ["01-02", "01-16", "02-20", "04-06", "05-28", "07-04", "09-03", "10-29", "10-30", "11-22", "12-25"],
        2021: ["01-01", "01-18", "02-15", "04-02", "05-31", "07-05", "09-06", "11-25", "12-24"],
        2022: ["01-17", "02-21", "04-15", "05-30", "06-20", "07-04", "09-05", "11-24", "12-26"],
        2025: ["01-01", "01-09", "01-20", "02-17", "04-18", "05-26", "06-19", "07-04", "09-01", "11-27", "12-25"],
    }
    for year, closed in known.items():
        opened = {r["session"] for r in exchange_calendar.sessions(spark, f"{year}-01-01", f"{year}-12-31").collect()}
        weekdays = {d.date() for d in pd.bdate_range(f"{year}-01-01", f"{year}-12-31")}
        assert sorted(d.strftime("%m-%d") for d in weekdays - opened) == closed and opened <= weekdays
    asked = spark.createDataFrame([(dt.date(2001, 9, 10),), (dt.date(2024, 3, 28),), (dt.date(2024, 3, 29),), (dt.date(2024, 3, 27),), (None,)], "day date")
    got = {r["day"]: (r["effective_from"], r["problem"]) for r in exchange_calendar.information_dates(asked, "day").collect()}
    assert got[dt.date(2001, 9, 10)] == (dt.date(2001, 9, 17), "NOT_MONTH_END")
    assert got[dt.date(2024, 3, 28)] == (dt.date(2024, 4, 1), None)
    assert got[dt.date(2024, 3, 29)][1] == "NO_SESSION" and got[dt.date(2024, 3, 27)][1] == "NOT_MONTH_END" and got[None][1] == "NO_DATE"


def test_critical_line():
    from tidemark.operators import frontier

    rng = np.random.default_rng(0)

    def met(c, m, t, w, low, high):
        slope = c @ w - t * m
        inside, floor, cap = (w > low + 1e-9) & (w < high - 1e-9), w <= low + 1e-9, w >= high - 1e-9
        slack = 1e-6 * max(1.0, np.abs(slope).max())
        level = slope[inside].mean() if inside.any() else None
        if level is None:
            return not (floor.any() and cap.any()) or slope[cap].max() <= slope[floor].min() + slack
        return np.abs(slope[inside] - level).max() < slack and (not floor.any() or slope[floor].min() >= level - slack) and (not cap.any() or slope[cap].max() <= level + slack)

    for trial in range(600):
        n = int(rng.integers(1, 12))
        f = rng.normal(size=(n, 3))
        c = f @ f.T + np.diag(rng.uniform(0.01, 1, n)) if trial % 4 else np.eye(n) * 0.5 + 0.1 * (trial % 8)
        low, high = rng.choice([0.0, 0.0, 0.02]), rng.choice([1.0, 1.0, 0.4, 0.25])
        if n * high < 1:
            continue
        m = rng.normal(size=n)
        prices, weights, done = frontier.turning_points(c, m, low, high)
        assert done and prices[-1] == 0 and (np.diff(prices[1:]) <= 1e-9).all()
        assert np.abs(weights.sum(axis=1) - 1).max() < 1e-9 and weights.min() >= low and weights.max() <= high
        assert all(met(c, m, t, w, low, high) for t, w in zip(prices[1:], weights[1:]))
        w, done = frontier.least_variance(c, low, high)
        assert done and met(c, m * 0, 0.0, w, low, high)
        if m @ weights[0] > 0:
            best, _ = frontier.best_ratio(c, m, low, high)
            ratio = m @ best / np.sqrt(best @ c @ best)
            for _ in range(20):  # no mixture with any point of the line is better
                x = weights[rng.integers(len(weights))]
                y = best + rng.uniform(0, 1) * (x - best)
                assert ratio >= m @ y / np.sqrt(y @ c @ y) - 1e-9


def test_write_once_names_ranges(spark, tmp_path):
    from tidemark.sources import tables

    levels = {"year": F.year("day"), "month": F.month("day")}
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=7 * i)) for i in range(60)]
    table = spark.createDataFrame(rows, "id int, day date")
    path = f"{tmp_path}/once"
    assert tables.write_once(table, path, levels) == "CREATED" and tables.write_once(table.repartition(2), path, levels) == "EXISTS"
    with pytest.raises(tables.ContentChanged, match="2020/5 CHANGED"):
        tables.write_once(table.withColumn("id", F.when(F.col("id") == 20, 0).otherwise(F.col("id"))), path, levels)
    with pytest.raises(tables.ContentChanged, match="columns differ"):
        tables.write_once(table.withColumn("more", F.lit(1)), path, levels)
    assert tables.tampered_ranges(spark, path, levels).count() == 0
    table.filter("id = 3").write.mode("append").parquet(path)
    found = {(r["level"], r["year"], r["month"]) for r in tables.tampered_ranges(spark, path, levels).collect()}
    assert found == {(0, None, None), (1, "2020", None), (2, "2020", "1")}
