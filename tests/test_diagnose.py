import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ordered, quarter
from wattframe.models import forest
from wattframe.models.anomaly import detect_anomalies
from wattframe.models.forest import isolation_scores
from wattframe.operators import diagnose as g


def rows(spark, expected, actual, kind="solar", cloud=None, wind=None, extra=()):
    data = [("a", kind, quarter(i), float(e), float(a), cloud, wind) for i, (e, a) in enumerate(zip(expected, actual))]
    return spark.createDataFrame(data, "asset_id string, asset_type string, timestamp timestamp, expected_mw double, actual_mw double, cloud_cover double, wind_speed_10m double")


def perf(spark, *args, **kw):
    return g.performance(rows(spark, *args, **kw))


def test_ordinary_day(spark):
    out = perf(spark, [5.0, 5.2, 4.8], [4.9, 5.1, 4.7])
    assert ordered(out, "absolute_deviation") == pytest.approx([-0.1] * 3) and ordered(out, "performance_ratio")[0] == pytest.approx(4.9 / 5)
    assert not any(ordered(out, "zero_expected_edge_case"))


def test_quiet_hours_are_nominal(spark):
    out = perf(spark, [0, 1e-6, 5e-5], [0, 0, 1e-5])
    assert ordered(out, "performance_ratio", "percentage_deviation", "zero_expected_edge_case") == [(1.0, 0.0, False)] * 3


def test_generation_out_of_nothing(spark):
    out = perf(spark, [0, 5e-5], [2.5, 3.0])
    assert ordered(out, "performance_ratio", "percentage_deviation", "zero_expected_edge_case") == [(None, None, True)] * 2


def test_types_are_checked(spark):
    with pytest.raises(Exception, match="bad asset or type"):
        g.check_asset_types(rows(spark, [1], [1], kind="nuclear")).collect()


def test_capacity_form(spark):
    df = spark.createDataFrame([(10.0, 8.0, 20.0), (0.0, 0.0, 20.0), (1e-8, 2.0, None)], "expected_mw double, actual_mw double, capacity_mw double")
    a, b, c = g.performance_capacity(df).collect()
    assert (a["absolute_deviation_mw"], a["performance_ratio"], a["generation_capacity_ratio"]) == (-2, 0.8, 0.4)
    assert b["performance_ratio"] is None and c["performance_ratio"] is None and c["generation_capacity_ratio"] is None and c["zero_or_missing_expected"]


@pytest.mark.parametrize("actual, kw, want", [
    ([10.0], {}, ["normal_production"]), ([4.0], {"cloud": 90.0}, ["weather_driven_reduction"]), ([4.0], {"cloud": 10.0}, ["uncertain"]),
    ([4.0] * 4, {}, ["uncertain"] * 3 + ["possible_physical_fault"]), ([-1.0], {}, ["data_quality_issue"]),
    ([4.0, 4.0, 4.0, 10.0, 4.0], {}, ["uncertain"] * 3 + ["normal_production", "uncertain"]),
    ([4.0] * 4, {"kind": "wind", "wind": 2.0}, ["weather_driven_reduction"] * 4),
])
def test_diagnosis(spark, actual, kw, want):
    assert ordered(g.classify_deviation(perf(spark, [10] * len(actual), actual, **kw)), "diagnostic_category") == want


def test_edge_case_is_a_quality_issue(spark):
    assert ordered(g.classify_deviation(perf(spark, [0], [5])), "diagnostic_category") == ["data_quality_issue"]


def test_curtailment_needs_a_flag(spark):
    out = g.classify_deviation(perf(spark, [10] * 4, [4] * 4)).withColumn("flag", F.when(F.col("timestamp") == F.lit(quarter(3)), " YES "))
    assert ordered(g.apply_curtailment(out, "flag"), "diagnostic_category") == ["uncertain"] * 3 + ["intentional_curtailment"]
    assert ordered(g.apply_curtailment(out, "missing"), "diagnostic_category")[-1] == "possible_physical_fault"


def test_long_runs_cross_days(spark):
    df = perf(spark, [10] * 300, [4] * 150 + [10] + [4] * 149)
    run = ordered(g.low_run(df, F.col("performance_ratio") < 0.7), "low_run")
    assert run == list(range(1, 151)) + [0] + list(range(1, 150))


def test_blocks_overlap_after_a_31st(spark):
    from datetime import datetime

    df = spark.createDataFrame([("a", datetime(2024, 1, 31, 5)), ("a", datetime(2024, 2, 1, 5)), ("a", datetime(2024, 2, 2, 5))], "asset_id string, timestamp timestamp")
    got = [(r["block_start"].day, r["own_block"]) for r in g.in_blocks(df).orderBy("timestamp", "block_start").collect()]
    assert got == [(31, True), (31, False), (1, True), (1, True)]


def found(spark, actual, **kw):
    diagnosed = g.classify_deviation(perf(spark, [10] * len(actual), actual, **kw), keep_evidence=True)
    return diagnosed


def test_planted_fault_is_flagged(spark):
    out = detect_anomalies(found(spark, [10] * 24 + [0], cloud=5.0))
    last = out.orderBy(F.desc("timestamp")).first()
    assert last["anomaly"] and last["anomaly_score"] < 0
    assert detect_anomalies(found(spark, [10] * 24, cloud=5.0)).where("anomaly").count() == 0


def test_weather_and_curtailment_are_not_anomalies(spark):
    cloudy = rows(spark, [10] * 25, [10] * 24 + [4]).withColumn("cloud_cover", F.when(F.col("actual_mw") < 5, 95.0).otherwise(5.0))
    assert detect_anomalies(g.classify_deviation(g.performance(cloudy), keep_evidence=True)).where("anomaly").count() == 0
    flagged = found(spark, [10] * 24 + [0]).withColumn("flag", F.when(F.col("actual_mw") == 0, "true"))
    curtailed = g.apply_curtailment(flagged, "flag")
    r = detect_anomalies(curtailed).orderBy(F.desc("timestamp")).first()
    assert not r["anomaly"] and r["anomaly_suppressed_reason"] == "intentional_curtailment"
    assert detect_anomalies(curtailed, suppress=False).orderBy(F.desc("timestamp")).first()["anomaly"]


def test_corrupt_rows_are_forced(spark):
    assert detect_anomalies(found(spark, [10] * 7 + [-1])).orderBy(F.desc("timestamp")).first()["anomaly"]


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(3000).select("id", F.lit("m").alias("model"), F.lit(True).alias("fit"), (F.hash("id") % 1000 / 1000).alias("x"), (F.hash(F.col("id") + 7) % 1000 / 1000).alias("y"))
    return df.withColumn("x", F.when(F.col("id") % 500 == 0, 25.0).otherwise(F.col("x")))


@pytest.mark.parametrize("chunk_rows", [4096, 700])
def test_forest_finds_outliers_in_one_or_several_chunks(spark, points, chunk_rows):
    out = isolation_scores(points, ["x", "y"], "model", ["id"], trees=50, contamination=0.02, chunk_rows=chunk_rows).toPandas()
    assert len(out) == 3000 and (out[out.id % 500 == 0].anomaly_score < 0).all() and 40 <= (out.anomaly_score < 0).sum() <= 61


def test_rows_travel_once_and_forests_stay_where_they_are_grown(spark):
    """Trees draw by the places that Spark's xxhash64 gives; a short series sends its fit rows once, not once a tree, and a long one only what some tree draws."""
    rows = spark.range(4000).select("id", F.when(F.col("id") < 40, "short").otherwise("long").alias("model"), (F.col("id") % 4 > 0).alias("fit"), (F.hash("id") % 1000 / 1000).alias("x"))
    trees, sample, seed = 6, 8, 42
    pool = forest._pool(forest._sized(rows, "model", "fit"), ["x"], "model", ["id"], "fit", trees, sample, seed)
    found = {m: p.sort_values("id") for m, p in pool.toPandas().groupby("model")}
    place = F.pmod(F.xxhash64("model", "id", F.lit(seed), F.col("tree")), F.lit(2**40)) / F.lit(float(2**40))
    placed = rows.where("fit").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("place", place).toPandas()
    assert len(found["short"]) == 30 and len(found["long"]) <= 4 * trees * sample
    for model, p in found.items():
        drawn, tree = forest.draw(p["_hash"].to_numpy(), int(p["_fit_rows"].iloc[0]), trees, sample)
        for t in range(trees):
            wanted = placed[(placed.model == model) & (placed.tree == t)].nsmallest(sample, "place")
            assert set(p["id"].to_numpy()[drawn[tree == t]]) == set(wanted.id) and len(drawn[tree == t]) == sample
    few = found["short"].head(5)
    assert forest.draw(few["_hash"].to_numpy(), 5, 2, sample)[0].tolist() == [0, 1, 2, 3, 4] * 2


def test_scores_are_those_of_the_kept_forests(spark):
    rows = spark.range(1500).select("id", F.when(F.col("id") < 200, "short").otherwise("long").alias("model"), (F.col("id") % 4 > 0).alias("fit"), (F.hash("id") % 1000 / 1000).alias("x"), (F.hash(F.col("id") + 7) % 1000 / 1000).alias("y"))
    once = isolation_scores(rows, ["x", "y"], "model", ["id"], trees=10, chunk_rows=300, keep=["id"])
    kept = forest.forest_fit(rows, ["x", "y"], "model", ["id"], trees=10).predict(rows, ["id"])
    assert once.columns == ["id", "anomaly_score"]
    assert [tuple(r) for r in once.orderBy("id").collect()] == [tuple(r) for r in kept.select("id", "anomaly_score").orderBy("id").collect()]


def test_forest_does_not_depend_on_partitions(points):
    one = isolation_scores(points.repartition(1), ["x", "y"], "model", ["id"], trees=20, chunk_rows=900).orderBy("id").collect()
    many = isolation_scores(points.repartition(7), ["x", "y"], "model", ["id"], trees=20, chunk_rows=900).orderBy("id").collect()
    assert [r["anomaly_score"] for r in one] == pytest.approx([r["anomaly_score"] for r in many])


def test_cause_needs_a_real_deviation(spark):
    rows_ = spark.createDataFrame([("a", quarter(0), -60.0, True), ("a", quarter(1), 1.0, False)], "asset_id string, timestamp timestamp, percentage_deviation double, anomaly boolean")
    tall = spark.createDataFrame([("a", quarter(i), n, x) for i in (0, 1) for n, x in (("cloud_cover", -3.0), ("hour_of_day", 1.0))], "asset_id string, timestamp timestamp, feature string, contribution double")
    a, b = g.cause_category(rows_, tall).orderBy("timestamp").collect()
    assert (a["cause_category"], a["cause_confidence"]) == ("weather_cloud_cover", 0.75) and (b["cause_category"], b["cause_confidence"]) == ("uncertain", 0.0)


def test_planted_driver_ranks_first(spark):
    from wattframe.models.boosted import contributions, pooled_fit

    df = spark.range(400).select(
        F.lit("a").alias("asset_id"), F.timestamp_seconds(F.col("id") * 900).alias("timestamp"), (F.abs(F.hash("id")) % 100).cast("double").alias("cloud_cover"),
        (F.abs(F.hash(F.col("id") + 1)) % 24).cast("double").alias("hour_of_day"),
    ).withColumn("percentage_deviation", -F.col("cloud_cover"))
    fitted = pooled_fit(df, ["cloud_cover", "hour_of_day"], "percentage_deviation", iterations=5)
    mean = {r["feature"]: r["m"] for r in contributions(fitted, df, ["asset_id", "timestamp"]).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()}
    assert mean["cloud_cover"] > 10 * mean["hour_of_day"]


def test_ends_of_short_and_long_nodes():
    """Least and largest ranks of nodes, and trees over equal values, whichever way the ends are found."""
    rng = np.random.default_rng(4)
    for counts in (np.array([40, 25, 31]), rng.integers(1, 9, 50), np.array([1, 1, 7, 1])):
        starts = np.r_[0, counts.cumsum()[:-1]]
        ranks = rng.integers(0, 200, (3, counts.sum())).astype(np.uint8)
        low, high = forest.ends(ranks, starts, counts)
        for i, (a, n) in enumerate(zip(starts, counts)):
            assert (low[:, i] == ranks[:, a:a + n].min(1)).all() and (high[:, i] == ranks[:, a:a + n].max(1)).all()
    x = np.array([[1.0, 2.0], [1.0, 3.0], [1.0, 3.0]])
    made = forest.grow(x, np.tile(np.arange(3), 5), np.repeat(np.arange(5), 3), 5, np.random.default_rng(0))
    assert set(made["feature"]) <= {0, 1} and all(2.0 <= t < 3.0 for t, c in zip(made["threshold"], made["child"]) if c >= 0) and (made["child"][:5] >= 0).all()


def test_forests_are_dealt_to_as_many_tasks_whatever_their_size(spark, points):
    """Small tables are not merged into a task or two: growing forests takes far longer than reading their rows."""
    raw = isolation_scores(points.withColumn("model", F.pmod("id", F.lit(40)).cast("string")), ["x", "y"], "model", ["id"], trees=5)
    written = [f for f in raw.inputFiles() if "wattframe-" in f]
    assert raw.count() == 3000 and len(set(written)) >= 16
