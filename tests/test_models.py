"""Fits of the boosted models on series with a known signal."""

import math
import random

from helpers import quarter
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.models import boosted
from wattframe.operators import features as f
from wattframe.operators import metrics as m
from wattframe.operators import splits as s


def weather(spark):
    names = ["temperature_2m", "cloud_cover", "wind_speed_10m", "shortwave_radiation", "relative_humidity_2m"]
    ddl = "asset_id string, timestamp timestamp, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([("a", quarter(4 * h), *(float(10 + h % 24) for _ in names)) for h in range(240)], ddl)


def demand(spark, n=900):
    """A daily wave whose height drifts, so that yesterday's value is a poor forecast and the last hour a good one."""
    rng = random.Random(1)
    rows = [("a", quarter(i), 50 + 10 * math.sin(2 * math.pi * i / 96) + 8 * math.sin(i / 37) + rng.random() / 2) for i in range(n)]
    return spark.createDataFrame(rows, "asset_id string, timestamp timestamp, demand_mw double")


def test_demand_models_beat_the_seasonal_naive_and_give_ordered_bands(spark):
    rows = demand(spark)
    fitted, test = boosted.demand_forecast_fit(f.demand_feature_frame(rows, weather(spark)), iterations=60)
    scored = fitted.predict(test)
    by_model = {r.horizon_minutes: r.rmse for r in m.forecast_metrics(boosted.stacked_predictions(scored).select("model", "horizon_minutes", "predicted", "actual"), ["model", "horizon_minutes"]).collect()}
    base = s.stacked_baselines(s.baselines(s.chronological_split(rows)).where("split = 'test'")).where("model = 'seasonal_naive'")
    naive = {r.horizon_minutes: r.rmse for r in m.forecast_metrics(base, ["model", "horizon_minutes"]).collect()}
    assert set(by_model) == {15, 30, 60} and all(by_model[h] < naive[h] for h in by_model)
    assert set(fitted.rmse) == {15, 30, 60} and fitted.rmse != C.FALLBACK_RMSE
    points = boosted.forecast_points(scored, fitted.rmse).select("timestamp", "predicted_peak_mw", F.explode("points").alias("p")).select("timestamp", "predicted_peak_mw", "p.lower_bound_mw", "p.demand_mw", "p.upper_bound_mw")
    bad = points.where("NOT (0 <= lower_bound_mw AND lower_bound_mw <= demand_mw AND demand_mw <= upper_bound_mw AND demand_mw <= predicted_peak_mw)")
    assert points.count() == 4 * scored.count() and bad.count() == 0


def test_pooled_fit_follows_its_input_and_stops_on_noise(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(float(i % 40), rng.random(), 3.0 * (i % 40), rng.gauss(0, 1)) for i in range(600)], "x double, y double, target double, noise double")
    fitted = boosted.pooled_fit(rows, ["x", "y"], "target", 60)
    off = fitted.predict(rows, "predicted", floor=0.0).agg(F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0]
    assert off < 2.0
    assert boosted.pooled_fit(rows, ["x", "y"], "noise", 60).model.getNumTrees < 60


def test_spike_model_finds_the_planted_classes(spark):
    rng = random.Random(3)
    names = ["u", "w"]
    rows = []
    for i in range(600):
        c = (0, 0, 0, 1, 2)[i % 5]
        rows.append((c + rng.random() * 0.6, rng.random(), c))
    frame = spark.createDataFrame(rows, "u double, w double, spike_class int")
    out = boosted.spike_fit(frame, names=names, iterations=20).predict(frame).collect()
    assert sum(r.predicted_class == r.spike_class for r in out) > 0.95 * len(out)
    assert all(1 / 3 - 1e-9 <= r.probability <= 1 and r.level == ("normal", "moderate", "severe")[r.predicted_class] for r in out)


def test_best_prefix_waits_out_a_worse_stretch():
    curve = [5.0, 4.0, 4.5, 4.4, 3.0, 3.1, 3.2, 2.9, *[3.0] * 40]
    assert boosted.best_prefix(curve, 30) == (8, True) and boosted.best_prefix(curve, 2) == (2, True) and boosted.best_prefix(curve[:20], 30) == (8, False)
    assert boosted.best_prefix([1.0], 30) == (1, False) and boosted.best_prefix([float("nan"), 2.0, 1.0], 5)[0] == 1


def test_a_fit_goes_on_after_a_worse_tree_and_keeps_the_best_prefix(spark):
    """Held-out errors rise where the trees learn a part that is wrong there, and fall below what they were as the rest is learnt."""
    rng = random.Random(4)
    rows = [(i % 5 == 0, float(x := rng.randrange(60)), rng.random(), 2.0 * x + 12 * math.sin(x) + rng.gauss(0, 9)) for i in range(700)]
    frame = boosted.assemble(spark.createDataFrame(rows, "held boolean, x double, y double, target double"), ["x", "y"], ["held", "target"]).coalesce(1).persist()
    curves = {}
    for step in (0.3, 0.6, 0.9):
        whole = boosted.GBTRegressor(labelCol="target", maxIter=24, stepSize=step, maxDepth=2, seed=C.FOREST_SEED).fit(frame.where("NOT held"))
        curves[step] = whole.evaluateEachIteration(frame.where("held"), "squared")
    rises = {step: next((i for i in range(1, 24) if c[i] >= c[i - 1]), 24) for step, c in curves.items()}
    step = max(curves, key=lambda s: boosted.best_prefix(curves[s], 8)[0] - rises[s])
    kept = boosted.best_prefix(curves[step], 8)[0]
    assert kept > rises[step], "no curve of this fixture recovers after a worse tree"
    fitted = boosted.fit_regressor(frame, "target", 24, "held", step=step, depth=2, patience=8)
    again = fitted.evaluateEachIteration(frame.where("held"), "squared")
    assert fitted.getNumTrees == kept == len(again) and again[-1] == curves[step][kept - 1] < curves[step][rises[step] - 1]


def test_no_forecast_sees_its_own_future(spark):
    """Changed demand from one stamp on changes no cross-fitted forecast before it; each fold's model has learnt earlier folds only."""
    rows = demand(spark, 700)
    cut = quarter(420)
    later = rows.withColumn("demand_mw", F.when(F.col("timestamp") >= F.lit(cut), F.col("demand_mw") * 3 + 7).otherwise(F.col("demand_mw")))
    result = {}
    for name, table in (("as_is", rows), ("changed", later)):
        frame = boosted.cross_fit_frame(f.demand_feature_frame(table, weather(spark)))
        assert frame.where("fold = 1").agg(F.max("_target")).first()[0] is not None
        result[name] = {r.timestamp: (r.fold, r.forecast_mw) for r in boosted.cross_fitted_forecast(frame, iterations=6).collect()}
    before = [x for x in result["as_is"] if x < cut]
    assert before and all(result["as_is"][x] == result["changed"][x] for x in before)
    assert any(result["as_is"][x] != result["changed"][x] for x in result["as_is"] if x >= cut)
    assert {fold for fold, _ in result["as_is"].values()} == {0, 1, 2, 3} and all((y is None) == (fold == 0) for fold, y in result["as_is"].values())
