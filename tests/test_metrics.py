import math

import pytest
from pyspark.sql import functions as F

from helpers import series
from wattframe.operators import metrics as m
from wattframe.operators import reshape as r
from wattframe.operators import splits as s
from wattframe.operators.quality import series_quality
from wattframe.sources import scan, sinks


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "actual double, predicted double").withColumn("k", F.lit("x"))


def test_known_scores(spark):
    got = m.forecast_metrics(pairs(spark, [10.0, 20.0, 30.0, 40.0], [12.0, 18.0, 33.0, 36.0]), ["k"]).first()
    assert (got["mae"], got["mape"], got["n"]) == (2.75, 12.5, 4) and got["rmse"] == pytest.approx(math.sqrt(8.25))


def test_zero_actuals_have_no_percentage(spark):
    got = m.forecast_metrics(pairs(spark, [0.0, 0.0], [1.0, 2.0]), ["k"]).first()
    assert got["mape"] is None and got["mae"] == 1.5
    none = m.forecast_metrics(pairs(spark, [None, 1.0], [1.0, None]), ["k"]).first()
    assert none["n"] == 0 and none["mae"] is None


def test_baseline_table(spark):
    df = s.chronological_split(series(spark, [50 + 10 * math.sin(2 * math.pi * i / 96) + 0.05 * i for i in range(300)]))
    out = m.forecast_metrics(s.stacked_baselines(s.baselines(df).where("split = 'test'")), ["model", "horizon_minutes"])
    assert out.count() == 6 and {x["n"] for x in out.collect()} == {45}


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "actual_class int, predicted_class int").withColumn("k", F.lit("x"))
    got = {x["class"]: x for x in m.class_report(df, ["k"]).collect()}
    assert got["1"]["precision"] == 0 and got["1"]["recall"] == 0 and got["2"]["f1"] == 1 and got["0"]["precision"] == pytest.approx(2 / 3)
    assert got["macro"]["recall"] == pytest.approx(2 / 3) and got["weighted"]["recall"] == pytest.approx(0.75) and got["0"]["accuracy"] == 0.75


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {x["y"]: x["weight"] for x in m.class_weights(df, "y").collect()}
    assert got == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


@pytest.fixture(scope="module")
def wide(spark):
    rows = [("2020-01-01 00:00:00", 10.5, 100.0, 20.0), ("2020-01-01 01:00:00", None, 100.0, 21.0)]
    return spark.createDataFrame(rows, "utc_timestamp string, DE_solar_generation_actual double, DE_solar_capacity double, AT_wind_onshore_generation_actual double")


def test_unpivot(wide):
    found = r.discover_series(wide.columns)
    assert found == {"DE_solar_generation_actual": "DE_solar_capacity", "AT_wind_onshore_generation_actual": None}
    rows = r.unpivot_series(wide).collect()
    assert len(rows) == 4
    assert [x["capacity_mw"] for x in rows if x["energy_type"] == "solar"] == [100, 100] and {x["capacity_mw"] for x in rows if x["energy_type"] == "wind"} == {None}


def test_wide_gap(spark, wide):
    late = wide.withColumn("utc_timestamp", F.when(F.col("utc_timestamp").endswith("01:00:00"), "2020-01-01 02:00:00").otherwise(F.col("utc_timestamp")))
    got = series_quality(late, ["DE_solar_generation_actual"], {"DE_solar_generation_actual": "DE_solar_capacity"}, 3600).first()
    assert (got["row_count"], got["missing_steps"], got["missing_generation"], got["irregular_steps"]) == (2, 1, 1, 1)


def test_arrays_round_trip(spark):
    df = spark.createDataFrame([("s", 1, 2.0), ("s", 0, 1.0), ("s", 2, 3.0)], "scenario_id string, period int, v double")
    packed = r.rows_to_arrays(df, ["scenario_id"], ["v"])
    assert packed.first()["v"] == [1.0, 2.0, 3.0]
    assert [x["v"] for x in r.arrays_to_rows(packed, ["v"]).orderBy("period").collect()] == [1.0, 2.0, 3.0]


def test_even_sample(spark):
    import numpy as np

    got = sorted(x["demand_mw"] for x in r.even_sample(series(spark, range(100))).collect())
    assert got == np.linspace(0, 99, 10, dtype=int).tolist()
    assert r.even_sample(series(spark, range(7))).count() == 7


def test_asset_tree(spark, tmp_path):
    import pandas as pd

    for path in ("a.parquet", "deep/b.parquet", "deep/c.parquet", "deeper/x/c.parquet"):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"datetime": pd.to_datetime(["2024-01-01"]), "load": [float("nan")]}).to_parquet(full)
    tree = scan.scan_asset_tree(spark, str(tmp_path))
    assert "timestamp" in tree.columns and tree.where("load is null").count() == 4
    got = {x["asset_id"]: x["ambiguous"] for x in scan.resolve_assets(tree).collect()}
    assert got == {"a": False, "b": False, "c": True}
    with pytest.raises(Exception, match="several files"):
        scan.require_unambiguous(scan.resolve_assets(tree)).collect()


def test_sources_reject_what_they_do_not_know(spark, tmp_path):
    with pytest.raises(ValueError):
        scan.scan_telemetry(spark, "load.xlsx")
    with pytest.raises(ValueError):
        scan.wide_csv_path("x", "5min")
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(1), str(tmp_path / "r"), "xml")


def test_table_sink_partitions_by_group(spark, tmp_path):
    df = series(spark, range(4)).withColumn("group_name", F.lit("mv_feeder"))
    path = sinks.write_table(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "group_name=mv_feeder").exists() and spark.read.parquet(path).count() == 4
