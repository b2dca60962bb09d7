import pytest
from pyspark.sql import functions as F

from helpers import ordered, quarter, series
from wattframe.operators import quality as q


@pytest.fixture(scope="module")
def clean(spark):
    rows = [("a", "mv_feeder", quarter(i), x, quarter(i), i) for i, x in enumerate([500000.0, 520000.0, 510000.0, 490000.0])]
    return spark.createDataFrame(rows, "asset_id string, group_name string, timestamp timestamp, load double, available_at timestamp, tie int")


def test_clean_rows_pass_through(clean):
    out = q.canonicalize(clean, "tie")
    assert out.columns[:10] == list(q.CANONICAL)
    assert ordered(out, "demand_mw") == [0.5, 0.52, 0.51, 0.49] and ordered(out, "demand_kw")[0] == 500.0
    assert q.schema_check(clean).where("not passed").count() == 0


def test_missing_load_column(clean):
    bad = q.schema_check(clean.drop("load")).where("not passed and severity = 'error'").collect()
    assert [r["column_name"] for r in bad] == ["load"]
    with pytest.raises(ValueError, match="load"):
        q.canonicalize(clean.drop("load"), "tie")


def test_text_column_numeric_only_if_all_coerce(spark):
    df = spark.createDataFrame([("x", "1.5"), ("y", "2")], "timestamp string, load string")
    assert q.schema_check(df).where("check_name = 'numeric'").first()["passed"]
    worse = df.unionByName(spark.createDataFrame([("z", None)], "timestamp string, load string"))
    assert q.schema_check(worse).where("check_name = 'numeric'").first()["bad_rows"] == 1


def test_text_stamps(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:30:00", 300, 0), ("a", "2024-01-01 00:00:00", 100, 1), ("a", "rubbish", 9, 2), ("a", "2024-01-01 00:15:00", 200, 3)], "asset_id string, timestamp string, load int, tie int")
    assert ordered(q.ts_normalize(df), "load") == [100, 200, 300]
    report = q.ts_report(df, sequence="tie").first()
    assert (report["rows_in"], report["rows_out"], report["dropped"], report["monotonic"]) == (4, 3, 1, False)


def test_duplicates_counted(spark):
    df = spark.createDataFrame([("a", quarter(i), 1.0) for i in (0, 1, 1, 2)], "asset_id string, timestamp timestamp, load double")
    r = q.duplicate_report(df).first()
    assert (r["rows_in"], r["rows_out"], r["duplicates"], r["sample_stamps"]) == (4, 3, 1, "2024-01-01 00:15")


def test_gap(spark):
    df = spark.createDataFrame([("a", quarter(i)) for i in (0, 2, 3)] + [("b", quarter(0))], "asset_id string, timestamp timestamp")
    a, b = q.gap_detect(df).orderBy("asset_id").collect()
    assert (a["expected"], a["actual"], a["missing"], a["missing_pct"], a["irregular_deltas"]) == (4, 3, 1, 25.0, 1)
    assert (b["expected"], b["missing"], b["irregular_deltas"]) == (1, 0, 0)


def test_null_policies(spark):
    df = series(spark, [500000, None, 510000, 490000], value="load")
    assert q.null_policy(df, "leave_as_null").where("load is null").count() == 1
    filled = q.null_policy(df, limit=2)
    assert ordered(filled, "load")[1] == 500000 and ordered(filled, "is_imputed") == [False, True, False, False]
    assert q.null_policy(df, "drop").count() == 3
    with pytest.raises(ValueError):
        q.null_policy(df, "guess")


def test_fill_stops_at_the_limit(spark):
    out = q.fill_bounded(series(spark, [1] + [None] * 6 + [2], value="load"), limit=4)
    assert ordered(out, "load") == [1, 1, 1, 1, 1, None, None, 2] and sum(ordered(out, "is_unresolved")) == 2


def test_nan_is_missing(spark):
    out = q.fill_bounded(series(spark, [1, float("nan"), 3], value="load"))
    assert ordered(out, "load") == [1, 1, 3]


def test_range_flags_with_own_limits(spark):
    df = series(spark, [500, -200, 20000], value="load").withColumn("group_name", F.lit("g"))
    limits = spark.createDataFrame([("g", -1000.0, 10000.0)], "group_name string, plausible_min double, plausible_max double")
    out = q.range_flags(df, limits=limits)
    assert ordered(out, "is_out_of_range") == [False, False, True] and ordered(out, "is_reverse_flow") == [False, True, False]


def test_ratio_groups_have_their_own_limits(spark):
    df = series(spark, [0.5, -0.5], value="load").withColumn("group_name", F.lit("solar_park"))
    assert ordered(q.range_flags(df), "is_out_of_range") == [True, False]


def test_quality_report_counts(clean):
    again = clean.unionByName(clean.limit(1).withColumn("tie", F.lit(9)))
    r = q.quality_report(again, "tie").first()
    assert (r["rows_in"], r["rows_out"], r["retention_pct"], r["duplicates"]["extra_rows"], r["gaps"]["missing"]) == (5, 4, 80.0, 1, 0)


def test_order_gate(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00", 0), ("2020-01-01 00:00:00", 1), ("not-a-timestamp", 2)], "utc_timestamp string, n int")
    gate = q.strict_order_gate(df, sequence="n")
    r = gate.first()
    assert (r["invalid_stamps"], r["duplicate_stamps"], r["not_increasing"]) == (1, 1, 1)
    with pytest.raises(Exception, match="rejected"):
        q.enforce_order(gate).collect()
    good = spark.createDataFrame([("2020-01-01 00:00:00", 0), ("2020-01-01 01:00:00", 1)], "utc_timestamp string, n int")
    assert q.enforce_order(q.strict_order_gate(good, sequence="n")).first()["accepted"]


def test_name_based_findings(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "wind_speed int, target_load double, future_x string")
    found = {(r["role"], r["column_name"]) for r in q.column_candidates(df).collect()}
    assert {("weather", "wind_speed"), ("wind", "wind_speed"), ("demand_load", "target_load")} <= found
    leaks = {r["column_name"]: (r["matched"], r["missing_pct"]) for r in q.leakage_columns(df).collect()}
    assert leaks == {"target_load": ("target", 0.0), "future_x": ("future", 100.0)}


def test_leakage_audit_finds_every_row(spark):
    df = series(spark, [1, 2, 3, 4]).withColumn("lag_1", F.col("demand_mw"))
    assert q.leakage_audit(df, "demand_mw", "lag_1").first()["violations"] == 3
