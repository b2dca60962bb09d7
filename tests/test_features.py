import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ordered, quarter, series
from wattframe.functions.calendar import with_calendar, with_holiday
from wattframe.functions.physics import solar_position, turbine_fraction
from wattframe.operators import features as f
from wattframe.operators import joins as j
from wattframe.operators import splits as s

START = datetime(2024, 4, 26, 12)


@pytest.fixture(scope="module")
def ramp(spark):
    return series(spark, [10 + 0.5 * i for i in range(200)], START)


def test_lags_and_windows_look_back_only(ramp):
    out = f.demand_features(ramp, windows=(4, 16))
    rows = out.orderBy("timestamp").collect()
    d = [r["demand_mw"] for r in rows]
    assert rows[0]["demand_mw_lag_15m"] is None and rows[3]["demand_mw_roll_mean_4"] is None
    for i in (20, 150):
        assert rows[i]["demand_mw_lag_15m"] == d[i - 1] and rows[i]["demand_mw_lag_60m"] == d[i - 4]
        assert rows[i]["demand_mw_roll_mean_4"] == pytest.approx(np.mean(d[i - 4:i])) and rows[i]["demand_mw_roll_max_16"] == max(d[i - 16:i])
        assert rows[i]["demand_mw_roll_std_16"] == pytest.approx(np.std(d[i - 16:i], ddof=1))
    assert rows[150]["demand_mw_lag_1440m"] == d[54] and rows[150]["demand_mw_diff_1h"] == d[149] - d[146]


def test_changing_the_future_changes_nothing_before(ramp):
    cut = START + timedelta(minutes=15 * 120)
    other = ramp.withColumn("demand_mw", F.when(F.col("timestamp") > F.lit(cut), 999.0).otherwise(F.col("demand_mw")))
    names = [n for n in f.demand_feature_names() if "demand" in n]
    pick = lambda df: f.demand_feature_frame(df).where(F.col("timestamp") <= F.lit(cut)).orderBy("timestamp").select(*names).collect()
    assert pick(ramp) == pick(other)


def test_order_of_input_does_not_matter(ramp):
    a = f.lags(ramp).orderBy("timestamp").collect()
    assert a == f.lags(ramp.orderBy(F.rand(1))).orderBy("timestamp").collect()


def test_feature_frame_has_the_fixed_columns(ramp):
    out = f.demand_feature_frame(ramp)
    assert out.columns[3:] == f.demand_feature_names() and len(f.demand_feature_names()) == 37
    assert out.where("direct_radiation <> 0").count() == 0


def test_calendar(spark, ramp):
    by_day = {}
    for r in with_calendar(ramp).withColumn("d", F.dayofmonth("timestamp")).select("d", "is_weekend", "is_holiday", "season").distinct().collect():
        by_day[r["d"]] = (r["is_weekend"], r["is_holiday"], r["season"])
    assert by_day == {26: (0, 0, 2), 27: (1, 1, 2), 28: (1, 0, 2)}
    assert with_holiday(ramp).where("holiday_name like 'Koningsdag%'").count() == 96


def test_lags_by_time_skip_gaps(spark):
    df = series(spark, range(6)).where("demand_mw <> 2")
    assert ordered(f.lags(df), "demand_mw_lag_15m") == [None, 0, 1, 3, 4]
    assert ordered(f.lags(df, by="time"), "demand_mw_lag_15m") == [None, 0, None, 3, 4]


def test_weather_join_keeps_rows(spark, ramp):
    weather = ramp.select("asset_id", "timestamp").withColumn("cloud_cover", F.lit(50.0)).withColumn("demand_mw", F.lit(-1.0))
    out = j.weather_left(ramp, weather)
    assert out.count() == 200 and out.where("cloud_cover is null or demand_mw < 0").count() == 0
    doubled = j.weather_left(ramp, weather.unionByName(weather))
    assert doubled.count() == ramp.count()


def test_interpolation_holds_the_end_and_not_the_start(spark):
    rows = series(spark, range(12))
    weather = series(spark, [10, 20], START.replace(month=1, day=1, hour=0) + timedelta(minutes=30), value="t", step=60)
    got = ordered(j.interp_join(rows, weather, ["t"]), "t")
    assert got == [None, None, 10, 12.5, 15, 17.5, 20, 20, 20, 20, 20, 20]


def test_versions_hold_for_their_hour_and_their_time_of_issue(spark):
    """Against all pairs: the newest revision for the hour of the valid time that was issued by the decision."""
    rng = random.Random(21)
    at = lambda minutes: quarter(0) + timedelta(minutes=minutes)
    revisions = [("a", at(60 * rng.randrange(30)), at(rng.randrange(0, 1800, 20)), float(i)) for i in range(400)] + [("b", at(0), at(5), 1.0), ("a", None, at(0), 9.0), ("a", at(0), None, 9.0)]
    asks = [(a, at(15 * i), at(15 * i + h)) for a in "abc" for i in range(120) for h in (15, 60, 600)] + [("a", None, at(0)), ("a", at(0), None)]
    got = j.versioned_asof(
        spark.createDataFrame(asks, "asset_id string, decided_at timestamp, valid_at timestamp"),
        spark.createDataFrame(revisions, "asset_id string, valid_at timestamp, available_at timestamp, cloud_cover double"), ["cloud_cover"],
    ).collect()
    assert len(got) == len(asks)
    for r in got:
        fits = [
            (available, value) for asset, valid, available, value in revisions
            if None not in (valid, available, r.valid_at, r.decided_at) and asset == r.asset_id and valid == r.valid_at.replace(minute=0) and available <= r.decided_at
        ]
        assert (r.known_available_at, r.cloud_cover) == max(fits, default=(None, None))
    assert sum(r.cloud_cover is not None for r in got) > 100


def test_asof_uses_only_what_was_available(spark):
    t = datetime(2024, 1, 1)
    facts = spark.createDataFrame([("a", t, 1.0), ("a", t + timedelta(days=2), 2.0)], "asset_id string, available_at timestamp, v double")
    asks = spark.createDataFrame([("a", t - timedelta(hours=1)), ("a", t), ("a", t + timedelta(days=1)), ("a", t + timedelta(days=9))], "asset_id string, at timestamp")
    assert ordered(j.asof_join(asks, facts, "at", "available_at", ["v"]), "v", by=("at",)) == [None, 1.0, 1.0, 2.0]


def test_history_depth(spark):
    df = series(spark, range(200))
    asked = spark.createDataFrame([("a", START.replace(month=1, day=1, hour=1)), ("a", START.replace(month=1, day=2, hour=12))], "asset_id string, origin timestamp")
    short, full = j.history_depth(j.asof_history(df, asked), asked).orderBy("origin").collect()
    assert (short["available_rows"], short["error_code"]) == (5, "INSUFFICIENT_HISTORY")
    assert (full["available_rows"], full["error_code"]) == (96, None)


def test_recent_fill_names_what_is_missing(spark):
    df = spark.createDataFrame([("a", START + timedelta(minutes=15 * i), x, None) for i, x in enumerate([1.0, 2.0, None])], "asset_id string, timestamp timestamp, p double, q double")
    r = f.recent_ffill(df, ["p", "q"]).first()
    assert r["p"] == 2.0 and r["missing_features"] == "q"


def test_forecast_gate_names_the_first_reason(spark):
    rows = [(a, START + timedelta(minutes=15 * i), x, 1.0) for a, n, x in (("short", 95, None), ("hole", 96, None), ("full", 97, 2.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp timestamp, p double, q double")
    got = {r["asset_id"]: (r["history_rows"], r["missing_features"], r["error_code"]) for r in f.forecast_gate(df, ["p", "q"]).collect()}
    assert got == {"short": (95, "p", "INSUFFICIENT_HISTORY"), "hole": (96, "p", "MISSING_FEATURE"), "full": (97, "", None)}


def test_input_gate(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    r = f.input_gate(df, ["a", "b"]).first()
    assert (r["null_counts"], r["error_code"]) == ("b=1", "MISSING_FEATURE")
    assert f.input_gate(df, ["a"]).first()["error_code"] is None


def test_hourly_features(spark):
    df = series(spark, [max(0, 10 + 5 * np.sin(i)) for i in range(240)], value="actual_mw", step=60).withColumn("capacity_mw", F.lit(20.0))
    rows = f.hourly_feature_frame(df).orderBy("timestamp").collect()
    assert rows[10]["lag_1"] == rows[9]["actual_mw"] and rows[10]["lagged_generation_ratio"] == rows[9]["actual_mw"] / 20
    assert rows[167]["roll_mean_168"] is None and rows[168]["roll_mean_168"] is not None


def test_sun_and_turbine(spark):
    noon = spark.createDataFrame([(datetime(2024, 6, 21, 12), 52.0, 0.0), (datetime(2024, 6, 21, 0), 52.0, 0.0)], "t timestamp, lat double, lon double")
    day, night = [r for r in noon.select(*solar_position("t", "lat", "lon")).collect()]
    assert day["solar_elevation_deg"] == pytest.approx(61.4, abs=0.5) and abs(day["solar_azimuth_deg"] - 180) < 3
    assert night["cos_solar_zenith"] == 0.0 and night["solar_elevation_deg"] < 0
    speeds = spark.createDataFrame([(v,) for v in (2.0, 3.0, 7.5, 12.0, 25.0, 26.0)], "v double")
    assert [r[0] for r in speeds.select(turbine_fraction("v")).collect()] == [0.0, 0.0, 0.125, 1.0, 1.0, 0.0]


def test_split_sizes_and_leads(spark):
    df = series(spark, range(300))
    placed = s.chronological_split(df)
    sizes = {r["split"]: r["rows"] for r in s.split_bounds(placed).collect()}
    assert sizes == {"train": 210, "validation": 45, "test": 45}
    lead = ordered(s.lead_targets(placed, "demand_mw", {"t": 2}), "t")
    assert lead[0] == 2 and lead[207] == 209 and lead[208] is None and lead[299] is None


def test_published_split_sizes(spark):
    df = spark.range(35136).select(F.lit("a").alias("asset_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900).alias("timestamp"))
    sizes = {r["split"]: r["rows"] for r in s.split_bounds(s.chronological_split(df)).collect()}
    assert sizes == {"train": 24595, "validation": 5270, "test": 5271}


def test_naive_forecasts(spark):
    out = s.baselines(series(spark, [10, 20, 30, 40, 50]))
    assert ordered(out, "persistence_15") == [None, 10, 20, 30, 40] and ordered(out, "persistence_30") == [None, None, 10, 20, 30]
    cyc = s.baselines(series(spark, range(10)), season=4)
    assert ordered(cyc, "seasonal_naive") == [None] * 4 + [0, 1, 2, 3, 4, 5]


def test_spike_labels(spark):
    df = s.with_growth(series(spark, [100.0] * 99 + [150.0, 400.0]))
    assert ordered(df, "growth_pct")[-1] is None
    label = s.spike_class(F.col("growth_pct"), F.lit(40.0), F.lit(150.0))
    assert ordered(df.withColumn("c", label), "c")[-3:] == [1, 2, 0]
    assert ordered(df.withColumn("c", s.spike_class(F.col("growth_pct"), F.lit(40.0), F.lit(150.0), None)), "c")[-1] is None


def test_peak_without_look_ahead(spark):
    out = ordered(f.peak_24h(series(spark, [5, 1, 1, 1, 9, 1])), "historical_peak_24h")
    assert out == [None, None, None, None, 5, 9]
    assert ordered(f.peak_24h(series(spark, [5, 1, 1, 1, 9, 1]), backfill=True), "historical_peak_24h")[0] == 5
