"""The model queries do their whole job: all rows, and all rounds that the models allow."""

import random

import pytest
from helpers import quarter
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.models import boosted, cause
from wattframe.plans import model_queries as q


class Same:
    """A model that gives back what it should find."""

    def predict(self, rows, output, floor=None):
        return rows.withColumn(output, F.col("actual_mw"))

    def contributions(self, rows):
        return rows.select(F.lit("x").alias("feature"), F.col("v").alias("contribution"))


@pytest.fixture
def hours(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(kind, quarter(4 * i), kind, 50 + rng.random(), 90.0) for kind in ("solar", "wind") for i in range(230)]
    table = spark.createDataFrame(rows, "asset_id string, timestamp timestamp, energy_type string, actual_mw double, capacity_mw double")
    monkeypatch.setattr(q.v, "hourly", lambda t: table)


def test_contributions_cover_all_rows(spark, monkeypatch):
    rows = [(kind, part, float(i)) for kind in ("solar", "wind") for i, part in enumerate(["train"] * 7 + ["validation"] * 2 + ["test"])]
    frame = spark.createDataFrame(rows, "asset_type string, split string, v double")
    monkeypatch.setattr(q, "deviation_models", lambda t: ({"solar": Same(), "wind": Same()}, frame))
    assert sorted(tuple(r) for r in q.contribution_rows(None).select("asset_type", "rows", "mean_abs").collect()) == [("solar", 10, 4.5), ("wind", 10, 4.5)]


def test_hourly_fits_get_all_their_rounds(hours, monkeypatch):
    seen = []
    monkeypatch.setattr(boosted, "pooled_fit", lambda rows, names, label, iterations, *a, **k: seen.append(iterations) or Same())
    assert q.generation_fit(None).count() == 2 and seen == [C.HOURLY_ROUNDS] * 2
    seen.clear()
    monkeypatch.setattr(q.hourly, "hourly_deviation_fits", lambda *a: [][0])  # only the expectations are asked for
    with pytest.raises(IndexError):
        q.hourly_status(None)
    assert len(seen) == 2 and set(seen) == {C.HOURLY_ROUNDS}


@pytest.fixture(scope="module")
def fitted(spark):
    """y follows x; z never changes, so no tree holds it."""
    rng = random.Random(5)
    made = [(i, float(x := rng.randrange(20)), rng.random() if i % 7 else None, 1.0, 3.0 * x) for i in range(400)]
    rows = spark.createDataFrame(made, "id int, x double, u double, z double, y double").persist()
    return boosted.pooled_fit(rows, ["x", "u", "z"], "y", 12), rows


def test_contributions_stay_with_their_rows(fitted):
    model, rows = fitted
    tall = boosted.contributions(model, rows, ["id"])
    assert " Exchange " not in tall._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.feature): r.contribution for r in tall.collect()}
    assert len(got) == 3 * 400 and {got[i, "z"] for i in range(400)} == {0.0}
    middle = model.medians.first()
    base = {r.id: r.p for r in model.predict(rows, "p").collect()}
    for name in ("x", "u"):
        for r in model.predict(rows.withColumn(name, F.lit(middle[f"median_{name}"])), "p").collect():
            assert got[r.id, name] == pytest.approx(base[r.id] - r.p, abs=1e-12)
    assert max(abs(got[i, "x"]) for i in range(400)) > 5


def test_repeated_keys_keep_their_own_contributions(fitted):
    model, rows = fitted
    one = {r.feature: r.contribution for r in boosted.contributions(model, rows.where("id = 8"), ["id"]).collect()}
    twice = boosted.contributions(model, rows.where("id = 8").unionByName(rows.where("id = 9").withColumn("id", F.lit(8))), ["id"]).collect()
    assert len(twice) == 6 and sum(r.contribution == one[r.feature] for r in twice) >= 3


def test_cause_rows_are_placed_once(spark):
    """Rows, report, fits and scores read one table; none of them places the rows anew."""
    made = [("a", quarter(i), "hydro", 10.0, 9.0, -10.0, "uncertain") for i in range(30)]
    frame = spark.createDataFrame(made, "asset_id string, timestamp timestamp, asset_type string, expected_mw double, actual_mw double, percentage_deviation double, diagnostic_category string")
    models, placed, report = cause.cause_fits(frame)
    assert models == {} and placed.count() == 30 and "Window" not in placed._jdf.queryExecution().executedPlan().toString()
