import pytest
from pyspark.sql import functions as F

from wattframe.operators import contracts as k
from wattframe.operators import dispatch as d
from wattframe.operators import snapshot as snap


@pytest.fixture(scope="module")
def resources(spark):
    base = d.scenario_resources(spark)
    return base.withColumn("ev_window", F.lit(60)).withColumn("ind_window", F.lit(120))


@pytest.fixture(scope="module")
def periods(spark):
    return d.scenario_table(spark).withColumnRenamed("scenario", "scenario_id").drop("grid_capacity_mw", "current_soc_mwh", "max_discharge_mw")


def idle(periods, **chosen):
    out = periods.select("scenario_id", F.lit("p").alias("plan_id"), "period")
    for name in ("charge_mw", "discharge_mw", "ev_shift_mw", "ind_shift_mw", "curtail_mw"):
        out = out.withColumn(name, F.lit(float(chosen.get(name, 0.0))))
    return out


def test_eight_scenarios(periods):
    assert periods.select("scenario_id").distinct().count() == 8 and periods.count() == 32


def test_before_metrics(periods, resources):
    got = {r["scenario_id"]: r for r in d.dispatch_before(periods, resources).collect()}
    assert got["HIGH_RENEWABLE_CURTAILMENT"]["curtailment_mw"] == pytest.approx(126 - 67.5)
    assert got["INFEASIBLE_DEMAND"]["grid_stress"] == 1.0 and all(0 <= r["grid_stress"] <= 1 and r["curtailment_mw"] >= 0 for r in got.values())


def test_infeasible_report(periods, resources):
    got = {r["scenario_id"]: r for r in d.infeasibility_report(periods, resources).collect()}
    r = got["INFEASIBLE_DEMAND"]
    assert r["required_balancing_mw"] == pytest.approx(452.0) and r["available_flexibility_mw"] == pytest.approx(10 + 4.8 + 8.4)
    assert r["estimated_deficit_mw"] == pytest.approx(452 - 23.2) and r["binding_limits"].startswith("Period 0: supply (38.0 MW) < demand (450.0 MW)")
    assert got["NORMAL_DAY"]["required_balancing_mw"] == 0


def test_extreme_deficit_costs(periods, resources):
    rows = d.dispatch_rows(idle(periods), periods, resources)
    got = {r["scenario_id"]: r for r in d.dispatch_eval(rows).collect()}
    assert got["INFEASIBLE_DEMAND"]["cost"] > 1000 and got["INFEASIBLE_DEMAND"]["deficit_mw"] == pytest.approx(4 * 452.0)


def test_state_of_charge_and_limits(periods, resources):
    one = periods.where("scenario_id = 'NORMAL_DAY'")
    rows = d.dispatch_rows(idle(one, charge_mw=20.0), one, resources)
    soc = [r["soc_mwh"] for r in rows.orderBy("period").collect()]
    assert soc[0] == pytest.approx(25 + 0.9 ** 0.5 * 5) and soc == sorted(soc)
    broken = lambda **c: {r["violated"] for r in d.violation_texts(d.dispatch_rows(idle(one, **c), one, resources)).collect()}
    assert broken() == set() and broken(charge_mw=30.0) == {"charge", "soc"} and broken(charge_mw=1.0, discharge_mw=1.0) == {"both"}
    assert broken(ev_shift_mw=4.5) == {"ev"} and broken(ind_shift_mw=8.0) == {"ind"} and broken(curtail_mw=500.0) == {"curtail"}
    assert broken(discharge_mw=19.0) == {"soc"} or broken(discharge_mw=19.0) == set()


def test_cheapest_feasible_plan(spark, periods, resources):
    one = periods.where("scenario_id = 'EVENING_DEMAND_SPIKE'")
    plans = idle(one).unionByName(idle(one, discharge_mw=15.0).withColumn("plan_id", F.lit("help"))).unionByName(idle(one, discharge_mw=50.0).withColumn("plan_id", F.lit("cheat")))
    evaluated = d.dispatch_eval(d.dispatch_rows(plans, one, resources))
    best = d.rank_plans(evaluated).first()
    assert (best["plan_id"], best["status"], best["feasible_plans"]) == ("help", "feasible", 2)
    none = d.rank_plans(evaluated.where("plan_id = 'cheat'")).first()
    assert none["plan_id"] is None and none["status"] == "infeasible"


def test_action_window(spark, periods, resources):
    one = periods.where("scenario_id = 'NORMAL_DAY'").withColumn("start_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    plan = idle(one).withColumn("discharge_mw", F.when(F.col("period").between(1, 2), 6.0).otherwise(0.0))
    got = {r["action_type"]: r for r in d.action_window(d.dispatch_rows(plan, one, resources)).collect()}
    a, b = got["battery_discharge"], got["battery_charge"]
    assert (a["start_time"].minute, a["end_time"].minute, a["power_mw"]) == (15, 45, 6.0) and (b["start_time"].minute, b["end_time"].hour, b["power_mw"]) == (0, 1, 0.0)


@pytest.mark.parametrize("column, value, message", [
    ("min_soc_mwh", -1.0, "min_soc_mwh must be >= 0"), ("max_soc_mwh", 0.0, "max_soc_mwh must be > 0"), ("efficiency", 1.2, "efficiency must be in (0, 1]"),
    ("current_soc_mwh", 60.0, "current_soc_mwh > max_soc_mwh"), ("ev_fraction", 1.5, "flexible_fraction must be in [0, 1]"), ("ind_cap_mw", -1.0, "max_shift_mw must be >= 0"),
    ("grid_capacity_mw", 0.0, "grid_capacity_mw must be > 0"),
])
def test_each_broken_resource_field(periods, resources, column, value, message):
    bad = resources.where("scenario_id = 'NORMAL_DAY'").withColumn(column, F.lit(value))
    found = k.resource_check(bad, periods).where("severity = 'error'").collect()
    assert message in {r["message"] for r in found}
    assert k.resource_check(resources.where("scenario_id = 'NORMAL_DAY'"), periods).where("severity = 'error'").count() == 0


def test_period_count_and_signs(spark, periods, resources):
    one = resources.where("scenario_id = 'NORMAL_DAY'")
    short = periods.where("period < 3").withColumn("solar_mw", -F.col("solar_mw"))
    assert {r["message"] for r in k.resource_check(one, short).where("severity = 'error'").collect()} == {"period count differs from n_periods", "solar_mw has negative values"}


def test_forecast_contract(spark):
    schema = """zone_id string, generated_at string, horizon_minutes int, points array<struct<timestamp:string,demand_mw:double,lower_bound_mw:double,upper_bound_mw:double>>,
        spike_risk struct<level:string,probability:double,predicted_peak_mw:double>, model_version string"""
    good = ("z", "2024-01-01T00:00:00", 60, [("2024-01-01T00:15:00", 95.0, 91.0, 99.0)], ("normal", 0.1, 95.0), "v1")
    bad = (" ", "never", 0, [("2024-01-01T00:15:00", -1.0, 99.0, 91.0)], ("wild", 2.0, 95.0), "v1")
    rules, nested = k.forecast_rules()
    a, b = k.check(spark.createDataFrame([good, bad], schema), rules, nested).collect()
    assert a["accepted"] and a["errors"] == [] and not b["accepted"]
    assert len(b["errors"]) == 7 and "points[0].lower_bound_mw cannot exceed upper_bound_mw" in b["errors"]


def test_snapshot_names_what_failed(spark):
    zones = spark.createDataFrame([("z1",), ("z2",)], "zone_id string")
    state = spark.createDataFrame([("z1", 90.0, 0.92, 50.0, 1.0, 60.0)], "zone_id string, demand_mw double, stress_index double, frequency_hz double, curtailment_mw double, soc_percent double")
    a, b = snap.grid_snapshot(zones, state, None, None, None).orderBy("zone_id").collect()
    assert a["current_demand"]["status"] == "available" and a["grid_stress"]["severity"] == "critical"
    assert a["system_health"]["unavailable_dependencies"] == ["forecasting", "renewable", "optimization"]
    assert b["current_demand"]["value_mw"] is None and b["system_health"]["unavailable_dependencies"][0] == "data_telemetry" and b["grid_stress"]["severity"] is None


def test_text_audit(spark):
    texts = spark.createDataFrame([
        (1, "none", "discharge 15 MW"), (2, "bad", "Curtail 5.5 mw"), (3, "ok", "discharge 15.04 MW and shift 9 MW"), (4, "ok", "all quiet, recharge 3 MW"), (5, "ok", "charge 0 MW"),
    ], "text_id int, run_id string, text string")
    runs = spark.createDataFrame([("ok", "feasible"), ("bad", "infeasible")], "run_id string, status string")
    actions = spark.createDataFrame([("ok", 15.0)], "run_id string, power_mw double")
    got = {(r["text_id"], r["power_mw"]): r["violation"] for r in snap.dispatch_text_audit(texts, runs, actions).collect()}
    assert got == {(1, 15.0): "no_run", (2, 5.5): "infeasible_run", (3, 9.0): "unverified_power"}


def test_impossible_plans_are_infeasible(spark, periods, resources):
    one = periods.where("scenario_id = 'NORMAL_DAY'")
    none = resources.withColumns({c: F.lit(None).cast("double") for c in ("max_charge_mw", "max_discharge_mw", "min_soc_mwh", "max_soc_mwh", "current_soc_mwh", "efficiency", "ev_fraction", "ind_fraction", "ind_cap_mw")})
    verdict = lambda plans, limits: {r["plan_id"]: r["feasible"] for r in d.dispatch_eval(d.dispatch_rows(plans, one, limits)).collect()}
    for action in ({"discharge_mw": 20.0}, {"charge_mw": 5.0}, {"ev_shift_mw": 10.0}, {"ind_shift_mw": 1.0}):
        assert set(verdict(idle(one, **action), none).values()) == {False}
    assert set(verdict(idle(one), none).values()) == {True}
    for action in d.ACTIONS:
        assert set(verdict(idle(one, **{action: -500.0}), resources).values()) == {False}
    partial = idle(one).where("period <> 2")
    rows = d.dispatch_rows(partial, one, resources)
    assert {(r["period"], r["violated"]) for r in d.violation_texts(rows).collect()} == {(2, "missing")} and rows.count() == one.count()


def test_unknown_periods_and_absent_limits(spark, periods, resources):
    one = periods.where("scenario_id = 'NORMAL_DAY'")
    far = idle(one).unionByName(idle(one).limit(1).withColumns({"period": F.lit(9), "discharge_mw": F.lit(900.0)}))
    rows = d.dispatch_rows(far, one, resources)
    assert {r["violated"] for r in d.violation_texts(rows).where("period = 9").collect()} >= {"unknown", "discharge"} and rows.count() == one.count() + 1
    got = d.dispatch_eval(rows).first()
    plain = d.dispatch_eval(d.dispatch_rows(idle(one), one, resources)).first()
    assert not got["feasible"] and got["cost"] > plain["cost"] and plain["feasible"] and got["after_demand_mw"] == plain["after_demand_mw"]
    blind = resources.withColumn("grid_capacity_mw", F.lit(None).cast("double"))
    got = d.dispatch_eval(d.dispatch_rows(idle(one), one, blind)).first()
    assert (got["feasible"], got["capacity_violations"], got["after_stress"]) == (False, one.count(), 1.0)
    got = d.dispatch_eval(d.dispatch_rows(idle(one), one, resources.where("scenario_id = 'none'"))).first()
    assert not got["feasible"] and got["capacity_violations"] == one.count()
    nowhere = idle(one).withColumn("scenario_id", F.lit("nowhere"))
    assert [r["unknown_violations"] for r in d.dispatch_eval(d.dispatch_rows(nowhere, one, resources)).collect()] == [one.count()]
