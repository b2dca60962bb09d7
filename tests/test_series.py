"""The series engine against pandas, and its behaviour on one dominating series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ordered, quarter, series
from wattframe.operators import joins
from wattframe.operators.quantiles import exact_percentiles, medians
from wattframe.operators.series import Running, attach, dedup, grid, row_windows, running, time_windows


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    n = 3000
    # One series holds most of the rows.
    pdf = pd.DataFrame({
        "asset_id": np.where(rng.random(n) < 0.8, "hot", "cold"),
        "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(15000, n, replace=False)) * 15, unit="min"), "v": rng.normal(size=n),
    })
    pdf.loc[rng.random(n) < 0.2, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf.sort_values(["asset_id", "timestamp"]).reset_index(drop=True), df


def back(df):
    return df.toPandas().sort_values(["asset_id", "timestamp"]).reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), atol=1e-9)


def test_running_equals_pandas(frames):
    pdf, df = frames
    v = F.col("v")
    got = back(running(df, [
        Running("pos", "position"), Running("n", "total"), Running("s", "sum", v), Running("m", "max", v), Running("last", "last", v),
        Running("next", "next", v), Running("prev", "prev", v), Running("lead", "lead", v),
    ]))
    g = pdf.groupby("asset_id").v
    same(got.pos, g.cumcount() + 1)
    same(got.n, pdf.groupby("asset_id").v.transform("size"))
    same(got.s, g.transform(lambda x: x.fillna(0).cumsum()))
    same(got.m, g.transform(lambda x: x.cummax().ffill()))
    same(got["last"], g.ffill())
    same(got["next"], g.bfill())
    same(got.prev, g.shift(1))
    same(got.lead, g.shift(-1))


def test_row_windows_cross_chunks(frames):
    pdf, df = frames
    got = back(row_windows(
        df, lambda w: [F.lag("v", 96).over(w).alias("lag"), F.lead("v", 3).over(w).alias("ahead"), F.avg("v").over(w.rowsBetween(-16, -1)).alias("mean")],
        before=96, after=3, chunk_rows=100,
    ))
    g = pdf.groupby("asset_id").v
    assert len(got) == len(pdf)
    same(got.lag, g.shift(96))
    same(got.ahead, g.shift(-3))
    same(got["mean"], g.transform(lambda x: x.shift(1).rolling(16, min_periods=1).mean()))


def test_time_windows_cross_chunks(frames):
    pdf, df = frames
    got = back(time_windows(df, lambda w: [F.count("v").over(w.rangeBetween(-7200, 0)).alias("k")], before_seconds=7200, chunk_seconds=86400))
    want = pdf.set_index("timestamp").groupby("asset_id").v.apply(lambda x: x.notna().rolling("7201s").sum()).reset_index()
    same(got.k, want.sort_values(["asset_id", "timestamp"]).v)


@pytest.mark.parametrize("accuracy", [200, 100_000])
def test_percentiles_equal_pandas(frames, accuracy):
    pdf, df = frames
    wanted = {"low": 0.05, "mid": 0.5, "high": 0.99, "min": 0.0, "max": 1.0}
    got = exact_percentiles(df, F.col("v"), wanted, ["asset_id"], accuracy).toPandas().set_index("asset_id")
    for name, p in wanted.items():
        same(got[name].sort_index(), pdf.groupby("asset_id").v.quantile(p).sort_index())
    whole = exact_percentiles(df, F.col("v"), {"mid": 0.5}, accuracy=accuracy).toPandas()
    same(whole.mid, [pdf.v.quantile(0.5)])


def test_percentiles_of_one_repeated_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = exact_percentiles(df, F.col("v"), {"a": 0.5, "b": 0.999}, accuracy=100).first()
    assert got["a"] == 7.0 and abs(got["b"] - np.quantile(np.r_[np.full(4900, 7.0), np.arange(4900, 5000)], 0.999)) < 1e-9


def test_medians_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0), (None, 7.0)], "a double, b double")
    assert {r["feature"]: r["median"] for r in medians(df, ["a", "b"]).collect()} == {"a": 2.0, "b": 6.0}


def test_attach_keeps_every_row(frames):
    pdf, df = frames
    table = df.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    got = attach(df, table.where("asset_id = 'hot'"), ["asset_id"])
    assert got.count() == len(pdf) and got.where("n is not null").count() == (pdf.asset_id == "hot").sum()


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 1), ("a", 1, 20.0, 2), ("a", 1, 25.0, 3), ("a", 2, 30.0, 4)], "asset_id string, timestamp int, load double, tie int")
    assert ordered(dedup(df, "tie"), "load") == [10.0, 20.0, 30.0]
    assert ordered(dedup(df, "tie", keep="last"), "load") == [10.0, 25.0, 30.0]


def test_grid_is_complete_over_days(spark):
    df = series(spark, [1] * 2).limit(1).unionByName(series(spark, [1], start=pd.Timestamp("2024-01-04 01:00").to_pydatetime()))
    got = ordered(grid(df, 900), "timestamp")
    assert len(got) == 3 * 96 + 5 and len(set(got)) == len(got)


def test_no_window_sorts_a_whole_series(frames):
    """Every window of a feature plan partitions by chunk or bucket as well as by asset."""
    _, df = frames
    plan = row_windows(df, lambda w: [F.lag("v", 4).over(w).alias("l")], before=4)._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window [") and "_chunk" not in line and "_bucket" not in line]
    assert not specs


def test_merged_stamps_are_dealt_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    rows = spark.createDataFrame([("a", quarter(i)) for i in range(400)] + [("b", quarter(7))], "asset_id string, timestamp timestamp")
    weather = spark.createDataFrame([("a", quarter(4 * h), float(h * h) if h % 3 else None) for h in range(2, 90)], "asset_id string, timestamp timestamp, t double")
    whole = sorted(tuple(r) for r in joins.interp_join(rows, weather, ["t"]).select("asset_id", "timestamp", "t").where("t IS NOT NULL").collect())
    monkeypatch.setattr(joins, "MERGED_ROWS", 40)
    dealt = joins.interp_join(rows, weather, ["t"])
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert len(whole) > 300 and whole == sorted(tuple(r) for r in dealt.select("asset_id", "timestamp", "t").where("t IS NOT NULL").collect())


@pytest.mark.parametrize("accuracy", [100_000, 100])
def test_medians_of_the_whole_table_stay_side_by_side(spark, monkeypatch, accuracy):
    """The medians of single groups, though no value outside a bracket becomes a row."""
    from wattframe.operators import quantiles

    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    df = spark.range(3000).select((F.hash("id") % 1000).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.hash(F.col("id") + 1) / 7).alias("b"), F.lit(None).cast("double").alias("none"), F.lit(4).alias("same"))
    names = df.columns
    grouped = {r.feature: r.median for r in medians(df.withColumn("k", F.lit(1)), names, ["k"]).collect()}
    monkeypatch.setattr(quantiles, "exact_percentiles", lambda *a, **k: pytest.fail("every value became a row"))
    assert {r.feature: r.median for r in medians(df, names).collect()} == grouped and len(grouped) == 3
    assert medians(df.limit(0), names).count() == 0
