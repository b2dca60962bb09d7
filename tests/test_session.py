from types import SimpleNamespace

import pytest

from wattframe.plans.catalog import load_queries
from wattframe.session import cut_lineage, one_process, shared_folder, use_utc, work_folder

# Results that depend on fitted models.
WITHOUT_SQL = {
    "demand_forecast_fit", "generation_fit", "forecast_points", "anomaly_forest", "anomaly_forest_hourly", "spike_fit", "deviation_fit", "contributions",
    "renewable_status",
}


def test_every_query_has_sql_unless_it_fits_a_model():
    assert {n for n, q in load_queries().items() if q.sql is None} == WITHOUT_SQL


def test_stage_tables_go_to_the_shared_folder(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = str(tmp_path)
        spark.sparkContext.setCheckpointDir(shared)
    assert shared.rstrip("/") in work_folder(spark, "x") and work_folder(spark, "x") != work_folder(spark, "x")
    df = cut_lineage(spark.range(5).repartition(3))
    assert df.count() == 5 and all(shared.rstrip("/") in f for f in df.inputFiles())


def test_zone_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    assert use_utc(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_cluster_needs_the_shared_folder():
    assert one_process("local[8]") and one_process("local") and not one_process("local-cluster[3,2,1024]") and not one_process("spark://host:7077")
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, applicationId="x")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
