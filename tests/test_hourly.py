"""The hourly status chain on a planted signal, its restart, and the status of one asset at one time."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattframe.models import boosted
from wattframe.models import hourly as h

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Two assets with a daily wave; in the last part of one, some hours collapse."""
    rng = random.Random(9)
    made = []
    for name, kind in (("s", "solar"), ("w", "wind")):
        for i in range(520):
            value = 60 + 30 * math.sin(2 * math.pi * i / 24) + rng.random()
            if name == "s" and i in (480, 490, 500, 510):
                value *= 0.1
            made.append((name, START + timedelta(hours=i), kind, None if i == 300 else value, 120.0))
    return spark.createDataFrame(made, "asset_id string, timestamp timestamp, energy_type string, actual_mw double, capacity_mw double").persist()


@pytest.fixture(scope="module")
def chain(spark, rows, tmp_path_factory):
    run = h.Run(spark, f"file://{tmp_path_factory.mktemp('run')}")
    status = h.hourly_status(rows, run, min_rows=100, iterations=8)
    return run, status.persist()


def test_every_hour_has_a_status_and_rules_hold(rows, chain):
    run, status = chain
    assert status.count() == rows.count() and run.computed == ["inputs", "expectations", "performance", "anomalies", "cause_report", "evidence"]
    got = {(r.asset_id, r.timestamp): r for r in status.collect()}
    for r in got.values():
        assert (r.root_cause == h.NO_EVIDENCE) == (r.anomaly_flag is not True or r.percentage_deviation is None)
        assert (len(r.evidence) == h.EVIDENCE) == (r.anomaly_flag is True) and r.curtailment_status == "unknown" and not r.weather_available
        assert r.root_cause != h.NO_EVIDENCE or r.uncertainty
    first = [r for r in got.values() if r.timestamp < START + timedelta(hours=168)]
    assert all(r.expected_mw is None and r.anomaly_flag is None for r in first)
    fallen = [got["s", START + timedelta(hours=i)] for i in (480, 490, 500, 510)]
    found = [r for r in fallen if r.anomaly_flag]
    assert len(found) >= 2 and all(r.root_cause.startswith("unusually low") for r in found), [(r.anomaly_score, r.percentage_deviation) for r in fallen]


def test_an_ended_run_goes_on_where_it_stopped(spark, rows, chain, monkeypatch):
    run, status = chain
    for name in ("hourly_expectations", "hourly_anomalies", "hourly_deviation_fits"):
        monkeypatch.setattr(h, name, lambda *a, **k: pytest.fail("computed again"))
    again = h.Run(spark, run.folder)
    assert h.hourly_status(rows, again, min_rows=100).count() == status.count() and again.computed == []


def test_no_expectation_comes_from_hours_it_forecasts(spark, rows):
    """Changing the last fifth of all series changes no earlier expectation."""
    cut = START + timedelta(hours=416)
    changed = rows.withColumn("actual_mw", F.when(F.col("timestamp") >= F.lit(cut), F.col("actual_mw") + 500).otherwise(F.col("actual_mw")))
    kept = []
    for table in (rows, changed):
        found = h.hourly_expectations(h.hourly_folds(table).persist(), iterations=3).where(F.col("timestamp") < F.lit(cut)).collect()
        kept.append({(r.asset_id, r.timestamp): r.expected_mw for r in found})
    assert kept[0] == kept[1] and any(x is not None for x in kept[0].values())


def test_types_without_enough_rows_are_reported(spark, chain):
    run, _ = chain
    performed = spark.read.parquet(f"{run.folder}/performance")
    fits, report = h.hourly_deviation_fits(performed, min_rows=10**6)
    assert fits == {} and {r.skipped for r in report.collect()} == {"insufficient finite deviation rows"}


def test_point_status_reads_one_file(spark, chain, tmp_path):
    _, status = chain
    path = h.write_status(status, f"file://{tmp_path}/status")
    stamp = "2024-03-20 10:00:00"
    found = h.status_at(spark, path, "s", stamp)
    rows = found.collect()
    assert len(rows) == 1 and rows[0].asset_id == "s" and rows[0].error_code is None and str(rows[0].timestamp) == stamp
    plan = found._jdf.queryExecution().executedPlan()
    leaves, files = [plan], []
    while leaves:
        node = leaves.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            leaves.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            leaves.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            files.append(node.metrics().apply("numFiles").value())
        children = node.children()
        leaves += [children.apply(i) for i in range(children.length())]
    assert files == [1] and spark.read.parquet(path).inputFiles().__len__() > 20
    code = lambda asset, at: h.status_at(spark, path, asset, at).first().error_code
    assert (code(" ", stamp), code("s", "soon"), code("s", "2030-01-01 00:00:00"), code("x", stamp)) == ("INVALID_ASSET_ID", "INVALID_TIMESTAMP", "TIMESTAMP_OUT_OF_RANGE", "TIMESTAMP_OUT_OF_RANGE")


def test_first_trees_are_a_prefix(spark):
    frame = boosted.assemble(spark.range(200).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 2.0).alias("y")), ["x"], ["y"])
    whole = boosted.GBTRegressor(labelCol="y", maxIter=6, maxDepth=2, seed=1).fit(frame)
    short = boosted.first_trees(whole, 2)
    assert short.getNumTrees == 2 and short.treeWeights == whole.treeWeights[:2] and short.getLabelCol() == "y"
    assert short.evaluateEachIteration(frame, "squared") == whole.evaluateEachIteration(frame, "squared")[:2]
