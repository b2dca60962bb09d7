"""Cause models of the quarter-hour rows: their inputs, their diagnoses, and types without a model."""

import random

import pytest
from helpers import quarter
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.models import boosted, cause, store

WEATHER = ["cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m"]


@pytest.fixture(scope="module")
def frame(spark):
    """Deviations that follow the diagnosis of solar and the wind speed of wind, at random, so that history does not tell them; one type is unknown."""
    rng = random.Random(8)
    made, weather = [], []
    for asset, kind, n in (("s", "solar", 260), ("w", "wind", 260), ("h", "hydro", 40)):
        for i in range(n):
            category = rng.choice(("uncertain", "normal_production", "possible_physical_fault")) if i < 230 else "weather_driven_reduction"
            speed = float(rng.randrange(13))
            deviation = {"solar": {"uncertain": -10.0, "normal_production": 0.0}.get(category, -60.0), "wind": 5.0 * speed}.get(kind, 1.0)
            made.append((asset, quarter(i), kind, 10.0, 10.0 + deviation / 10, None if i % 50 == 7 else deviation + rng.random(), category, i % 9 == 0))
            weather.append((asset, quarter(i), *[rng.random() for _ in WEATHER[:4]], speed, 90.0))
    ddl = "asset_id string, timestamp timestamp, asset_type string, expected_mw double, actual_mw double, percentage_deviation double, diagnostic_category string, anomaly boolean"
    rows = spark.createDataFrame(made, ddl).withColumns({"latitude": F.lit(52.0), "longitude": F.lit(5.0)})
    return cause.cause_frame(rows, spark.createDataFrame(weather, "asset_id string, timestamp timestamp, " + ", ".join(f"{n} double" for n in WEATHER))).persist()


@pytest.fixture(scope="module")
def fitted(frame):
    return cause.cause_fits(frame, iterations=40)


def test_all_inputs_are_there(frame):
    assert {kind: len(names) for kind, names in C.CAUSE_INPUTS.items()} == {"solar": 24, "wind": 30}
    assert all(set(names) <= set(frame.columns) for names in C.CAUSE_INPUTS.values()) and frame.count() == 560


def test_types_without_a_model_say_why(frame, fitted):
    models, placed, report = fitted
    got = {r.asset_type: r for r in report.collect()}
    assert sorted(models) == ["solar", "wind"] and got["hydro"].skipped == "unsupported asset type" and got["hydro"].inputs is None
    assert got["solar"].skipped is None and got["solar"].inputs == 24 + 3 and got["wind"].inputs == 30 + 3
    assert all(r.rows == r.train_rows + r.validation_rows + r.test_rows for r in got.values()) and got["solar"].rows == 260 - 6
    few = frame.where("asset_type = 'solar'").limit(9)
    models, _, report = cause.cause_fits(few)
    assert models == {} and [r.skipped for r in report.collect()] == ["insufficient finite deviation rows"]
    none = frame.withColumn("percentage_deviation", F.lit(None).cast("double")).where("asset_type = 'wind'")
    assert [(r.rows, r.skipped, r.categories) for r in cause.cause_fits(none)[2].collect()] == [(0, "insufficient finite deviation rows", [])]
    assert cause.cause_fits(frame.limit(0))[0] == {}


def test_models_lean_on_what_was_planted(fitted):
    models, placed, _ = fitted
    strongest = {}
    for kind, model in models.items():
        part = placed.where((F.col("asset_type") == kind) & (F.col("split") == "train"))
        tall = model.contributions(part).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("size"))
        strongest[kind] = tall.orderBy(F.col("size").desc()).first().feature
    assert strongest["solar"].startswith("diagnostic_category_") and strongest["wind"] in ("wind_speed_10m", "wind_speed_cubed")


def test_diagnoses_are_aligned_when_scored_by_a_loaded_model(spark, tmp_path, fitted):
    """A diagnosis that was never learnt, and one of the learnt that does not occur, change no column of the inputs."""
    models, placed, _ = fitted
    model = models["solar"]
    assert model.categories == ["normal_production", "possible_physical_fault", "uncertain"]
    root = f"file://{tmp_path}"
    store.publish(spark, store.stage(root, {("deviation", "solar"): model}, "v1", quarter(0)))
    again = store.find(spark, root, "deviation", ["s", "solar"])
    assert again.categories == model.categories and again.regression.names == model.regression.names
    keys = ["asset_id", "timestamp", "p"]
    later = placed.where("asset_type = 'solar' AND split = 'test'")
    assert {r[0] for r in later.select("diagnostic_category").distinct().collect()} - set(model.categories) == {"weather_driven_reduction"}
    for rows in (later, later.where("diagnostic_category = 'uncertain'"), later.drop("anomaly", "season")):
        assert sorted(again.predict(rows, "p").select(*keys).collect()) == sorted(model.predict(rows, "p").select(*keys).collect())
    coded = model.aligned(later.where("diagnostic_category = 'weather_driven_reduction'")).agg(*[F.sum(f"diagnostic_category_{c}") for c in model.categories]).first()
    assert set(coded) == {0.0}


def test_null_diagnoses_and_clashing_columns(fitted):
    models, placed, _ = fitted
    rows = placed.where("asset_type = 'wind'").withColumn("diagnostic_category", F.lit(None).cast("string")).withColumn("diagnostic_category_uncertain", F.lit("x"))
    assert models["wind"].predict(rows, "p").where("p IS NULL").count() == 0 and isinstance(models["wind"].regression, boosted.Regression)
