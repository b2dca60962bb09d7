"""Models by kind, key and version: published as a whole, found by time."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wattframe.models import boosted, store
from wattframe.models.forest import forest_fit, isolation_scores

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
NAMES = ["x", "y"]


def day(n):
    return START + timedelta(days=n)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], float(i % 30), rng.random(), 2.0 * (i % 30), i % 3, i % 5 > 0) for i in range(300)]
    return spark.createDataFrame(rows, "id long, model string, x double, y double, target double, spike_class int, fit boolean").persist()


@pytest.fixture(scope="module")
def regression(frame):
    return boosted.pooled_fit(frame, NAMES, "target", 3)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def publish(spark, root, keys, version, valid, model, at=None):
    return store.publish(spark, store.stage(root, {("generation", k): model for k in keys}, version, valid), at)


def listed(spark, root):
    return sorted((r.key, r.version) for r in store.manifest(spark, root).collect())


def test_all_kinds_score_alike_when_loaded(spark, root, frame, regression):
    demand = boosted.DemandModels({h: regression.model for h in (15, 30, 60)}, regression.medians, NAMES, {15: 0.1, 30: 0.2, 60: 0.3})
    spikes = boosted.spike_fit(frame, names=NAMES, iterations=2)
    forests = forest_fit(frame, NAMES, "model", ["id"], trees=10)
    models = {"demand": demand, "generation": regression, "spike": spikes, "deviation": regression, "forest": forests}
    store.publish(spark, store.stage(root, {(kind, "a"): m for kind, m in models.items()}, "v1", day(0)))
    score = {
        "demand": lambda m: m.predict(frame).select("id", "predicted_15", "predicted_30", "predicted_60"), "generation": lambda m: m.predict(frame, "p").select("id", "p"),
        "spike": lambda m: m.predict(frame).select("id", "level", "probability"), "deviation": lambda m: m.predict(frame, "p").select("id", "p"),
        "forest": lambda m: m.predict(frame, ["id"]).select("id", "anomaly_score"),
    }
    for kind, model in models.items():
        again = store.find(spark, root, kind, ["a"])
        assert type(again) is type(model) and sorted(score[kind](again).collect()) == sorted(score[kind](model).collect())
    assert store.find(spark, root, "demand", ["a"]).rmse == demand.rmse
    whole = isolation_scores(frame, NAMES, "model", ["id"], trees=10).select("id", "anomaly_score")
    assert sorted(whole.collect()) == sorted(score["forest"](forests).collect())
    unknown = frame.limit(5).withColumn("model", F.lit("new"))
    assert [r.anomaly_score for r in forests.predict(unknown, ["id"]).collect()] == [None] * 5


def test_a_half_written_version_is_not_there(spark, root, regression, monkeypatch):
    assert listed(spark, root) == []
    publish(spark, root, ["p"], "v1", day(1), regression)
    store.stage(root, {("generation", "p"): regression}, "v2", day(2))
    broken = boosted.Regression(None, regression.medians, NAMES)
    with pytest.raises(AttributeError):
        publish(spark, root, ["q"], "v3", day(3), broken)
    with monkeypatch.context() as m:
        m.setattr(store, "MANIFEST", "not a schema at all")
        with pytest.raises(Exception):
            publish(spark, root, ["p"], "v4", day(4), regression)
    assert listed(spark, root) == [("p", "v1")]
    with pytest.raises(LookupError):
        store.find(spark, root, "generation", ["p"], version="v2")
    with pytest.raises(ValueError):
        store.stage(root, {("guess", "p"): regression}, "v1", day(1))


def test_two_writers_do_not_disturb_each_other(spark, root, regression):
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(publish, spark, root, [f"k{i}", "p"], f"v{i}", day(i), regression) for i in range(6)]
        batches = {j.result() for j in jobs}
    assert len(batches) == 6 and listed(spark, root) == sorted((k, f"v{i}") for i in range(6) for k in (f"k{i}", "p"))


def test_the_newest_model_of_its_time_serves(spark, root, regression):
    for keys, version, valid, at in ((["solar"], "v1", 10, 1), (["solar", "wind"], "v2", 20, 2), (["a"], "v1", 15, 3), (["solar"], "v1", 12, 4)):
        publish(spark, root, keys, version, day(valid), regression, day(at))
    published = store.manifest(spark, root).persist()
    assert published.count() == 4, "a version published anew replaces the older one"
    days = [5, 11, 12, 15, 20, 25]
    stamps = [(n, asset, kind, day(d)) for n, (asset, kind, d) in enumerate((a, k, d) for a, k in (("a", "solar"), ("b", "solar"), ("c", "wind"), (None, None)) for d in days)]
    rows = spark.createDataFrame(stamps, "n long, asset_id string, energy_type string, timestamp timestamp")
    got = {r.n: (r.model_key, r.model_version) for r in store.choose(rows, published, "generation").collect()}
    valid = {"solar": [(12, "v1"), (20, "v2")], "wind": [(20, "v2")], "a": [(15, "v1")]}
    for n, asset, kind, at in stamps:
        usable = [(key, [v for d, v in valid.get(key, ()) if day(d) <= at]) for key in (asset, kind)]
        assert got[n] == next(((key, versions[-1]) for key, versions in usable if versions), (None, None))
    assert len(got) == len(stamps)
    assert store.choose(rows, published, "spike").where("model_key IS NOT NULL").count() == 0
    with pytest.raises(LookupError):
        store.find(spark, root, "generation", ["wind"], at=day(19))
    assert store.find(spark, root, "generation", ["nobody", "wind"], at=day(20)).names == NAMES


def test_rows_are_scored_by_their_own_model(spark, root, frame, regression):
    other = boosted.pooled_fit(frame.withColumn("target", -F.col("target")), NAMES, "target", 3)
    publish(spark, root, ["solar"], "v1", day(1), regression)
    publish(spark, root, ["solar"], "v2", day(3), other)
    rows = frame.withColumns({"energy_type": F.lit("solar"), "timestamp": F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") % 5 * 86400)})
    out = store.predict_at_time(rows, store.manifest(spark, root), "generation", "p", asset="model")
    got = {r.id: (r.model_version, r.p) for r in out.collect()}
    first, second = ({r.id: r.p for r in m.predict(frame, "p").collect()} for m in (regression, other))
    assert got == {i: (None, None) if i % 5 < 1 else ("v1", first[i]) if i % 5 < 3 else ("v2", second[i]) for i in range(300)}
