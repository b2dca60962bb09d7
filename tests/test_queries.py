"""Registered queries against their SQL. WATTFRAME_ALL=1 compares every one of them."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import difference, open_tables

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "dedup_first", "gap_detect", "canonicalize", "quality_report", "series_quality", "interp_join", "asof_available", "past_rolling", "low_run", "spike_thresholds",
    "classify_deviation", "dispatch_eval", "rank_plans", "grid_snapshot", "dispatch_text_audit", "contract_forecast", "stream_ingest", "stream_snapshot", "wide_csv_scan",
]
ORACLE = entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("WATTFRAME_ALL") else QUICK)
def test_query_equals_sql(spark, tables, name):
    assert difference(entry_module.queries()[name](spark, FOLDER), tables, ORACLE[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "demand_mw_roll_mean_4" in df.columns
