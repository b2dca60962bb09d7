"""Scores, thresholds, totals and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import dispatch as d
from wattframe.operators import metrics as m
from wattframe.operators import snapshot as snap
from wattframe.operators import splits as s
from wattframe.operators.diagnose import performance_capacity
from wattframe.operators.quantiles import exact_percentiles, medians
from wattframe.operators.series import Running, attach, running
from wattframe.plans import views as v
from wattframe.plans.join_queries import BASELINES
from wattframe.plans.registry import query
from wattframe.plans.window_queries import TRAIN_GROWTH, train_growth

SCORES = """avg(abs(actual_mw - expected_mw)) AS mae, sqrt(avg((actual_mw - expected_mw) ** 2)) AS rmse"""


@query("forecast_metrics", f"""
    SELECT asset_id, {SCORES}, avg(CASE WHEN abs(actual_mw) > 1e-4 THEN abs(actual_mw - expected_mw) / abs(actual_mw) END) * 100 AS mape, count(*) AS n FROM pair GROUP BY 1""", ["mae", "rmse", "mape"])
def forecast_metrics(t):
    return m.forecast_metrics(v.pair(t), ["asset_id"], "actual_mw", "expected_mw")


def _masked(rule: str, floor: str) -> str:
    return f"""SELECT asset_id, '{rule}' AS rule, {SCORES}, avg(CASE WHEN actual_mw >= {floor} THEN abs(actual_mw - expected_mw) / (abs(actual_mw) + 1e-9) END) * 100 AS mape,
        count(*) AS n, count(CASE WHEN actual_mw >= {floor} THEN 1 END) AS n_mape FROM pair GROUP BY 1"""


@query("gen_metrics", f"""
    {_masked('solar', '0.001')} UNION ALL {_masked('wind', '0.05')} UNION ALL
    SELECT asset_id, 'hourly', {SCORES}, avg(CASE WHEN abs(actual_mw) > 1e-6 THEN abs(actual_mw - expected_mw) / abs(actual_mw) END) * 100, count(*), count(CASE WHEN abs(actual_mw) > 1e-6 THEN 1 END) FROM pair GROUP BY 1""",
    ["mae", "rmse", "mape"])
def gen_metrics(t):
    parts = [m.gen_metrics(v.pair(t), ["asset_id"], rule, "actual_mw", "expected_mw").withColumn("rule", F.lit(rule)) for rule in ("solar", "wind", "hourly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("baseline_eval", f"WITH {BASELINES} SELECT * FROM sc WHERE model <> 'blend'", ["mae", "rmse", "mape"])
def baseline_eval(t):
    test = s.baselines(v.split(t)).where(F.col("split") == "test")
    return m.forecast_metrics(s.stacked_baselines(test), ["model", "horizon_minutes"])


@query("spike_thresholds", f"""
    WITH {TRAIN_GROWTH} SELECT th.*, n AS sample_size, a AS normal_rows, b AS moderate_rows, c AS severe_rows FROM th JOIN (SELECT gp.asset_id, count(*) AS n,
        count(CASE WHEN growth_pct < moderate_growth_pct THEN 1 END) AS a, count(CASE WHEN growth_pct >= moderate_growth_pct AND growth_pct < severe_growth_pct THEN 1 END) AS b,
        count(CASE WHEN growth_pct >= severe_growth_pct THEN 1 END) AS c FROM gp JOIN th ON gp.asset_id = th.asset_id WHERE growth_pct IS NOT NULL GROUP BY 1) k ON th.asset_id = k.asset_id""",
    ["moderate_growth_pct", "severe_growth_pct", "moderate_delta_mw", "severe_delta_mw"])
def spike_thresholds(t):
    return s.spike_thresholds(train_growth(t))


@query("spike_thresholds_positive", """
    WITH p AS (SELECT asset_id, timestamp, demand_mw, lag(demand_mw) OVER w AS prev, max(demand_mw) OVER (PARTITION BY asset_id ORDER BY timestamp) AS peak FROM demand WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
    c AS (SELECT *, (demand_mw / nullif(prev, 0) - 1) * 100 AS x FROM p), th AS (SELECT asset_id, quantile_cont(x, 0.90) AS moderate_pct, quantile_cont(x, 0.99) AS severe_pct FROM c WHERE x > 0 GROUP BY 1)
    SELECT c.asset_id, CASE WHEN x >= severe_pct THEN 2 WHEN x >= moderate_pct THEN 1 WHEN x IS NOT NULL THEN 0 END AS spike_class, count(*) AS rows, max(peak) AS historical_peak
    FROM c LEFT JOIN th ON c.asset_id = th.asset_id GROUP BY 1, 2""", ["historical_peak"])
def spike_thresholds_positive(t):
    rows = running(v.demand(t), [Running("prev_mw", "prev", F.col("demand_mw")), Running("peak", "max", F.col("demand_mw"))])
    limits = s.positive_growth_thresholds(rows)
    growth = (F.col("demand_mw") / F.nullif(F.col("prev_mw"), F.lit(0.0)) - 1) * 100
    label = s.spike_class(growth, F.col("moderate_pct"), F.col("severe_pct"), None)
    return attach(rows, limits, ["asset_id"]).groupBy("asset_id", label.alias("spike_class")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("peak").alias("historical_peak")
    )


CLASSES = """SELECT asset_id, CASE WHEN actual_mw > 8 THEN 2 WHEN actual_mw > 4 THEN 1 ELSE 0 END AS actual_class, CASE WHEN expected_mw > 7 THEN 2 WHEN expected_mw > 3 THEN 1 ELSE 0 END AS predicted_class FROM pair"""


def classes(t):
    level = lambda c, a, b: F.when(F.col(c) > a, 2).when(F.col(c) > b, 1).otherwise(0)
    return v.pair(t).select("asset_id", level("actual_mw", 8, 4).alias("actual_class"), level("expected_mw", 7, 3).alias("predicted_class"))


@query("confusion_matrix", f"""
    SELECT asset_id, actual_class, count(CASE WHEN predicted_class = 0 THEN 1 END) AS predicted_0, count(CASE WHEN predicted_class = 1 THEN 1 END) AS predicted_1,
        count(CASE WHEN predicted_class = 2 THEN 1 END) AS predicted_2 FROM ({CLASSES}) GROUP BY 1, 2""")
def confusion_matrix(t):
    return m.confusion_matrix(classes(t), ["asset_id"])


@query("class_report", f"""
    WITH x AS ({CLASSES}), k AS (SELECT asset_id, c, count(CASE WHEN actual_class = c AND predicted_class = c THEN 1 END) AS tp, count(CASE WHEN predicted_class = c THEN 1 END) AS p,
        count(CASE WHEN actual_class = c THEN 1 END) AS y, count(CASE WHEN actual_class = predicted_class THEN 1 END) * 1.0 / count(*) AS accuracy FROM x, (VALUES (0), (1), (2)) v(c) GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN y = 0 THEN 0 ELSE tp / y END AS recall FROM k),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
    SELECT asset_id, CAST(c AS VARCHAR) AS class, precision, recall, f1, y AS support, accuracy FROM f
    UNION ALL SELECT asset_id, 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(y) AS BIGINT), any_value(accuracy) FROM f GROUP BY 1
    UNION ALL SELECT asset_id, 'weighted', sum(precision * y) / sum(y), sum(recall * y) / sum(y), sum(f1 * y) / sum(y), CAST(sum(y) AS BIGINT), any_value(accuracy) FROM f GROUP BY 1""",
    ["precision", "recall", "f1", "accuracy"])
def class_report(t):
    return m.class_report(classes(t), ["asset_id"])


@query("class_weights", f"""
    SELECT asset_id, actual_class, count(*) AS class_rows, sum(count(*)) OVER (PARTITION BY asset_id) * 1.0 / (count(*) OVER (PARTITION BY asset_id) * count(*)) AS weight FROM ({CLASSES}) GROUP BY 1, 2""", ["weight"])
def class_weights(t):
    return m.class_weights(classes(t), "actual_class", ["asset_id"])


@query("median_impute", """
    WITH j AS (SELECT d.asset_id, d.timestamp, cloud_cover, temperature_2m, performance_ratio FROM perf d LEFT JOIN weather w ON d.asset_id = w.asset_id AND d.timestamp = w.timestamp),
    md AS (SELECT asset_id, quantile_cont(cloud_cover, 0.5) AS mc, quantile_cont(temperature_2m, 0.5) AS mt, quantile_cont(performance_ratio, 0.5) AS mp FROM j GROUP BY 1)
    SELECT j.asset_id, timestamp, coalesce(cloud_cover, mc, 0) AS cloud_cover, coalesce(temperature_2m, mt, 0) AS temperature_2m, coalesce(performance_ratio, mp, 0) AS performance_ratio
    FROM j JOIN md ON j.asset_id = md.asset_id""", ["cloud_cover", "temperature_2m", "performance_ratio"])
def median_impute(t):
    from wattframe.models.impute import impute, impute_medians

    names = ["cloud_cover", "temperature_2m", "performance_ratio"]
    rows = v.perf(t).join(v.weather(t), ["asset_id", "timestamp"], "left").select("asset_id", "timestamp", *names)
    return impute(rows, impute_medians(rows, names, ["asset_id"]), names, ["asset_id"])


@query("zone_totals", """
    SELECT zone_id, timestamp, coalesce(sum(CASE WHEN asset_type = 'solar' THEN actual_mw END), 0) AS solar_mw, coalesce(sum(CASE WHEN asset_type = 'wind' THEN actual_mw END), 0) AS wind_mw,
        sum(expected_mw) AS expected_mw, count(CASE WHEN anomaly THEN 1 END) AS anomaly_count, count(*) AS asset_count,
        coalesce(sum(CASE WHEN asset_type IN ('solar', 'wind') THEN actual_mw END), 0) AS renewable_mw FROM statuses GROUP BY 1, 2""", ["solar_mw", "wind_mw", "expected_mw", "renewable_mw"])
def zone_totals(t):
    return snap.zone_totals(v.statuses(t))


@query("zone_anomalies", "SELECT zone_id, timestamp, asset_id, asset_type, expected_mw, actual_mw FROM statuses WHERE anomaly", ["expected_mw", "actual_mw"])
def zone_anomalies(t):
    return snap.zone_anomalies(v.statuses(t))


@query("grid_snapshot", """
    WITH zn AS (SELECT DISTINCT CAST(zone_id AS VARCHAR) AS zone_id FROM raw),
    st AS (SELECT CAST(zone_id AS VARCHAR) AS zone_id, arg_max(90 + v, hour * 1.0 + 0 * period) AS x FROM (SELECT zone_id, epoch(hour) + period * 900 AS hour, period, v FROM zones) GROUP BY 1),
    fc AS (SELECT CAST(zone_id AS VARCHAR) AS zone_id, arg_max(k, epoch(hour) + period * 900) AS h15, arg_max(solar_v, epoch(hour) + period * 900) AS hs FROM zones WHERE zone_id % 2 = 0 GROUP BY 1),
    tt AS (SELECT zone_id, timestamp, coalesce(sum(CASE WHEN asset_type = 'solar' THEN actual_mw END), 0) AS solar_mw, coalesce(sum(CASE WHEN asset_type = 'wind' THEN actual_mw END), 0) AS wind_mw,
        count(CASE WHEN anomaly THEN 1 END) AS c, count(*) AS n FROM statuses GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY timestamp DESC) = 1)
    SELECT zn.zone_id, 'available' AS demand_status, st.x AS demand_mw, CASE WHEN fc.zone_id IS NULL THEN 'unavailable' ELSE 'available' END AS forecast_status, fc.h15,
        tt.solar_mw + tt.wind_mw AS total_mw, tt.c AS anomaly_count, tt.n AS asset_count, CASE WHEN least(1.0, (st.x - 90) / 100) >= 0.90 THEN 'critical' WHEN least(1.0, (st.x - 90) / 100) >= 0.75 THEN 'warning' ELSE 'normal' END AS severity,
        CASE WHEN fc.zone_id IS NULL THEN 'forecasting,optimization' ELSE 'optimization' END AS unavailable
    FROM zn JOIN st ON zn.zone_id = st.zone_id LEFT JOIN fc ON zn.zone_id = fc.zone_id LEFT JOIN tt ON zn.zone_id = tt.zone_id""", ["demand_mw", "h15", "total_mw"])
def grid_snapshot(t):
    at = F.col("hour").cast("long") + F.col("period") * 900
    rows = v.zones(t).withColumn("zone", F.col("zone_id").cast("string")).withColumn("at", at)
    newest = snap.newest_row(rows.select(F.col("zone").alias("zone_id"), "at", "v", "k"), ["zone_id"], "at")
    state = newest.select(
        "zone_id", (90 + F.col("v")).alias("demand_mw"), F.least(F.lit(1.0), F.col("v") / 100).alias("stress_index"), F.lit(50.0).alias("frequency_hz"),
        F.lit(0.0).alias("curtailment_mw"), F.col("k").alias("soc_percent"),
    )
    even = newest.where(F.col("zone_id").cast("long") % 2 == 0)
    forecast = even.select("zone_id", F.col("k").alias("h15"), F.lit(None).cast("double").alias("h30"), F.col("v").alias("h60"), F.lit("normal").alias("spike_level"))
    totals = snap.newest_row(snap.zone_totals(v.statuses(t)), ["zone_id"])
    out = snap.grid_snapshot(state.select("zone_id"), state, forecast, totals, None)
    return out.select(
        "zone_id", F.col("current_demand.status").alias("demand_status"), F.col("current_demand.value_mw").alias("demand_mw"), F.col("forecast_demand.status").alias("forecast_status"),
        "forecast_demand.h15", "renewable_generation.total_mw", F.col("renewable_anomalies.count").alias("anomaly_count"), "renewable_generation.asset_count", "grid_stress.severity",
        F.array_join("system_health.unavailable_dependencies", ",").alias("unavailable"),
    )


@query("latest_per_asset", "SELECT asset_id, max(timestamp) AS timestamp, CASE WHEN arg_max(load, timestamp) > 0 THEN arg_max(load, timestamp) END AS load FROM loads GROUP BY 1", ["load:3"])
def latest_per_asset(t):
    return snap.latest_per_asset(v.load(t), "load")


@query("anomaly_manifest", """
    WITH f AS (SELECT asset_id, energy_type, CASE WHEN expected_mw IS NOT NULL AND abs(expected_mw) > 1e-6 THEN actual_mw / expected_mw < 0.3 END AS flag FROM hourly_perf),
    c AS (SELECT asset_id, energy_type, count(*) AS row_count, count(flag) AS e, count(CASE WHEN flag THEN 1 END) AS a FROM f GROUP BY 1, 2)
    SELECT asset_id, energy_type, row_count, CASE WHEN e >= 500 THEN e ELSE 0 END AS evaluated, CASE WHEN e >= 500 THEN a ELSE 0 END AS anomalous, CASE WHEN e >= 500 THEN a * 100.0 / e END AS anomaly_pct,
        CASE WHEN e < 500 THEN 'insufficient valid performance rows' END AS skip_reason FROM c""", ["anomaly_pct"])
def anomaly_manifest(t):
    rows = performance_capacity(v.hourly_perf(t)).withColumn("anomaly_flag", F.col("performance_ratio") < 0.3)
    return m.anomaly_manifest(rows, ["asset_id", "energy_type"], min_rows=500)


@query("dispatch_before", """
    WITH a AS (SELECT scenario_id, avg(demand_mw) AS dm, avg(solar_mw + wind_mw) AS rn, avg(other_generation_mw) AS ot FROM scenario_periods GROUP BY 1)
    SELECT a.scenario_id, dm AS demand_mw, rn AS renewable_mw, least(rn, greatest(0, dm - ot)) AS usable_renewable_mw, greatest(0, rn - least(rn, greatest(0, dm - ot))) AS curtailment_mw,
        least(1.0, greatest(0, dm - rn - ot) / grid_capacity_mw) AS grid_stress, least(1.0, greatest(0, dm - rn) / grid_capacity_mw) AS snapshot_stress
    FROM a JOIN resources r ON a.scenario_id = r.scenario_id""", ["demand_mw", "renewable_mw", "usable_renewable_mw", "curtailment_mw", "grid_stress", "snapshot_stress"])
def dispatch_before(t):
    return d.dispatch_before(v.scenario_periods(t), v.resources(t))


@query("infeasibility_report", """
    WITH p AS (SELECT s.scenario_id, period, demand_mw, other_generation_mw + solar_mw + wind_mw AS supply, r.* EXCLUDE (scenario_id) FROM scenario_periods s JOIN resources r ON s.scenario_id = r.scenario_id),
    a AS (SELECT scenario_id, greatest(0, avg(demand_mw) - avg(supply)) AS req, any_value(max_discharge_mw + ev_current_mw * ev_fraction + least(ind_current_mw * ind_fraction, ind_cap_mw)) AS flex,
        string_agg(CASE WHEN supply < demand_mw THEN 'Period ' || period || ': supply (' || printf('%.1f', supply) || ' MW) < demand (' || printf('%.1f', demand_mw) || ' MW)' END, '; ' ORDER BY period) AS short,
        string_agg(CASE WHEN supply > grid_capacity_mw THEN 'Period ' || period || ': generation (' || printf('%.1f', supply) || ' MW) exceeds grid capacity (' || printf('%.1f', grid_capacity_mw) || ' MW)' END, '; ' ORDER BY period) AS over,
        any_value(CASE WHEN greatest(0, current_soc_mwh - min_soc_mwh) < 1 THEN 'Battery SOC near minimum: only ' || printf('%.2f', greatest(0, current_soc_mwh - min_soc_mwh)) || ' MWh available' END) AS soc,
        any_value(CASE WHEN max_discharge_mw = 0 THEN 'Battery discharge disabled' END) AS rate, any_value(CASE WHEN ev_fraction = 0 THEN 'EV flexibility is zero' END) AS ev FROM p GROUP BY 1)
    SELECT scenario_id, req AS required_balancing_mw, flex AS available_flexibility_mw, greatest(0, req - flex) AS estimated_deficit_mw, concat_ws('; ', short, soc, rate, ev, over) AS binding_limits FROM a""",
    ["required_balancing_mw", "available_flexibility_mw", "estimated_deficit_mw"])
def infeasibility_report(t):
    return d.infeasibility_report(v.scenario_periods(t), v.resources(t))


@query("asset_limits", "SELECT asset_id, quantile_cont(load, 0.02) AS lower_limit, quantile_cont(load, 0.98) AS upper_limit FROM loads GROUP BY 1", ["lower_limit:3", "upper_limit:3"])
def asset_limits(t):
    return exact_percentiles(v.load(t), F.col("load"), {"lower_limit": 0.02, "upper_limit": 0.98}, ["asset_id"])
