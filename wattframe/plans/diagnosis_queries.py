"""Performance, diagnosis, dispatch evaluation, contracts and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import contracts as k
from wattframe.operators import diagnose as g
from wattframe.operators import dispatch as d
from wattframe.operators.series import DAY_SECONDS, floor_time
from wattframe.plans import views as v
from wattframe.plans.join_queries import contributions
from wattframe.plans.registry import query

PERF = ["expected_mw", "actual_mw", "absolute_deviation", "percentage_deviation", "performance_ratio"]


@query("performance", "SELECT * FROM perf", PERF)
def performance(t):
    return v.perf(t)


HOURLY_PERF = """
    SELECT asset_id, energy_type, timestamp, actual_mw, expected_mw, capacity_mw, actual_mw - expected_mw AS absolute_deviation_mw, abs(actual_mw - expected_mw) AS absolute_error_mw,
        CASE WHEN abs(expected_mw) > 1e-6 THEN (actual_mw - expected_mw) / expected_mw * 100 END AS percentage_deviation, CASE WHEN abs(expected_mw) > 1e-6 THEN actual_mw / expected_mw END AS performance_ratio,
        CASE WHEN capacity_mw > 0 THEN actual_mw / capacity_mw END AS generation_capacity_ratio, CASE WHEN capacity_mw > 0 THEN expected_mw / capacity_mw END AS expected_capacity_ratio,
        NOT coalesce(abs(expected_mw) > 1e-6, false) AS zero_or_missing_expected FROM hourly_perf"""


@query("performance_capacity", HOURLY_PERF, [
    "actual_mw", "expected_mw", "capacity_mw", "absolute_deviation_mw", "absolute_error_mw", "percentage_deviation", "performance_ratio", "generation_capacity_ratio", "expected_capacity_ratio"])
def performance_capacity(t):
    return g.performance_capacity(v.hourly_perf(t))


@query("classify_deviation", "SELECT asset_id, timestamp, performance_ratio, diagnostic_category, diagnostic_confidence FROM diagnosis", ["performance_ratio", "diagnostic_confidence"])
def classify_deviation(t):
    return v.diagnosis(t).select("asset_id", "timestamp", "performance_ratio", "diagnostic_category", "diagnostic_confidence")


FLAG = "epoch(timestamp)::BIGINT // 900 % 11 = 0"


def flagged(t):
    """Every eleventh quarter-hour carries an explicit curtailment flag."""
    quarter = F.floor(F.col("timestamp").cast("long") / 900)
    return v.diagnosis(t).withColumn("curtailed", F.when(quarter % 11 == 0, F.lit("Yes")).otherwise("no"))


CURTAILED = f"""SELECT * EXCLUDE (diagnostic_category, diagnostic_confidence), CASE WHEN {FLAG} THEN 'intentional_curtailment' ELSE diagnostic_category END AS diagnostic_category,
    CASE WHEN {FLAG} THEN 0.98 ELSE diagnostic_confidence END AS diagnostic_confidence FROM diagnosis"""


@query("curtailment_override", f"WITH c AS ({CURTAILED}) SELECT asset_id, timestamp, diagnostic_category, diagnostic_confidence FROM c", ["diagnostic_confidence"])
def curtailment_override(t):
    return g.apply_curtailment(flagged(t), "curtailed").select("asset_id", "timestamp", "diagnostic_category", "diagnostic_confidence")


@query("anomaly_policy", f"""
    WITH c AS ({CURTAILED}), s AS (SELECT *, performance_ratio - 0.4 AS score, zero_expected_edge_case OR diagnostic_category = 'data_quality_issue' AS dq, diagnostic_category = 'intentional_curtailment' AS sup FROM c)
    SELECT asset_id, timestamp, CASE WHEN dq OR sup THEN 0.0 ELSE coalesce(score, 0) END AS anomaly_score,
        CASE WHEN dq THEN true WHEN sup OR diagnostic_category = 'weather_driven_reduction' THEN false ELSE coalesce(score < 0, false) END AS anomaly, CASE WHEN sup THEN 'intentional_curtailment' END AS anomaly_suppressed_reason
    FROM s""", ["anomaly_score"])
def anomaly_policy(t):
    rows = g.apply_curtailment(flagged(t), "curtailed").withColumn("anomaly_score", F.col("performance_ratio") - 0.4)
    return g.anomaly_policy(rows).select("asset_id", "timestamp", "anomaly_score", "anomaly", "anomaly_suppressed_reason")


@query("deviation_category", f"""
    SELECT asset_id, timestamp, CASE WHEN percentage_deviation IS NULL THEN 'insufficient evidence' WHEN abs(percentage_deviation) < 5 THEN 'expected/normal temporal variation'
        WHEN percentage_deviation < 0 THEN 'unusually low generation relative to expected' ELSE 'unusually high generation relative to expected' END AS root_cause FROM ({HOURLY_PERF})""")
def deviation_category(t):
    return g.performance_capacity(v.hourly_perf(t)).select("asset_id", "timestamp", g.deviation_category().alias("root_cause"))


@query("cause_category", """
    WITH c AS (SELECT asset_id, timestamp, f AS feature, x AS contribution FROM (SELECT asset_id, timestamp, cloud_cover - 50 AS cloud_cover, wind_speed_10m - 14 AS wind_speed_10m,
        temperature_2m AS temperature_2m, relative_humidity_2m / 7 AS relative_humidity_2m FROM weather) UNPIVOT (x FOR f IN (cloud_cover, wind_speed_10m, temperature_2m, relative_humidity_2m))),
    b AS (SELECT *, sum(abs(contribution)) OVER (PARTITION BY asset_id, timestamp) AS magnitude, row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY abs(contribution) DESC, feature) AS r FROM c),
    j AS (SELECT s.asset_id, s.timestamp, s.anomaly, s.percentage_deviation, feature, contribution, magnitude,
        coalesce(abs(percentage_deviation) < 5 AND NOT anomaly, false) OR feature IS NULL AS unknown FROM statuses s LEFT JOIN b ON s.asset_id = b.asset_id AND s.timestamp = b.timestamp AND b.r = 1)
    SELECT asset_id, timestamp, feature AS top_feature, CASE WHEN unknown THEN 'uncertain' ELSE CASE feature WHEN 'cloud_cover' THEN 'weather_cloud_cover' WHEN 'wind_speed_10m' THEN 'weather_wind_speed'
        WHEN 'temperature_2m' THEN 'weather_temperature' ELSE 'weather_humidity' END END AS cause_category, CASE WHEN unknown OR magnitude = 0 THEN 0.0 ELSE abs(contribution) / magnitude END AS cause_confidence FROM j""",
    ["cause_confidence"])
def cause_category(t):
    return g.cause_category(v.statuses(t), contributions(t)).select("asset_id", "timestamp", "top_feature", "cause_category", "cause_confidence")


# --- dispatch -----------------------------------------------------------------


def dispatched(t):
    return d.dispatch_rows(v.candidate_plans(t), v.scenario_periods(t), v.resources(t))


def dispatched_impossible(t):
    """Also with plans that cannot be carried out and resources that are not there."""
    return d.dispatch_rows(v.impossible_plans(t), v.scenario_periods(t), v.partial_resources(t))


CHECKS = ["missing", "unknown", "negative", "soc", "charge", "discharge", "both", "ev", "ind", "curtail", "capacity"]
COUNTS = ", ".join(f"CAST({c}_violations AS BIGINT) AS {c}_violations" for c in CHECKS)
FEASIBLE = " + ".join(f"{c}_violations" for c in CHECKS) + " = 0"
AFTER = ["after_demand_mw", "after_renewable_mw", "after_curtailment_mw", "after_stress"]


@query("dispatch_eval", f"SELECT scenario_id, plan_id, cost, deficit_mw, oversupply_mw, {COUNTS}, {', '.join(AFTER)}, {FEASIBLE} AS feasible FROM impossible_cost", ["cost", "deficit_mw", "oversupply_mw", *AFTER])
def dispatch_eval(t):
    return d.dispatch_eval(dispatched_impossible(t))


@query("violation_list", """
    SELECT scenario_id, plan_id, period, violated FROM (SELECT *, unnest([CASE WHEN NOT listed THEN 'missing' END, CASE WHEN NOT known THEN 'unknown' END,
        CASE WHEN least(charge_mw, discharge_mw, ev_shift_mw, ind_shift_mw, curtail_mw) < -1e-6 THEN 'negative' END, CASE WHEN soc_mwh < min_soc_mwh - 1e-6 OR soc_mwh > max_soc_mwh + 1e-6 THEN 'soc' END,
        CASE WHEN charge_mw > max_charge_mw + 1e-6 THEN 'charge' END, CASE WHEN discharge_mw > max_discharge_mw + 1e-6 THEN 'discharge' END,
        CASE WHEN charge_mw > 1e-6 AND discharge_mw > 1e-6 THEN 'both' END, CASE WHEN ev_shift_mw > ev_fraction * ev_demand_mw + 1e-6 THEN 'ev' END,
        CASE WHEN ind_shift_mw > least(ind_fraction * industrial_demand_mw, ind_cap_mw) + 1e-6 THEN 'ind' END,
        CASE WHEN curtail_mw < -1e-6 OR curtail_mw > solar_mw + wind_mw + 1e-6 THEN 'curtail' END,
        CASE WHEN other_generation_mw + used_mw + discharge_mw > grid_capacity_mw + 1e-6 THEN 'capacity' END]) AS violated FROM impossible_rows) WHERE violated IS NOT NULL""")
def violation_list(t):
    return d.violation_texts(dispatched_impossible(t))


@query("rank_plans", f"""
    WITH e AS (SELECT *, {FEASIBLE} AS feasible FROM impossible_cost)
    SELECT scenario_id, arg_min(CASE WHEN feasible THEN plan_id END, CASE WHEN feasible THEN cost END) AS plan_id, min(CASE WHEN feasible THEN cost END) AS cost,
        count(CASE WHEN feasible THEN 1 END) AS feasible_plans, CASE WHEN count(CASE WHEN feasible THEN 1 END) = 0 THEN 'infeasible' ELSE 'feasible' END AS status FROM e GROUP BY 1""", ["cost"])
def rank_plans(t):
    return d.rank_plans(d.dispatch_eval(dispatched_impossible(t)))


@query("curtail_attribution", """
    SELECT scenario_id, plan_id, avg(curtail_mw) * sum(solar_mw) / sum(solar_mw + wind_mw) AS curtail_solar_mw, avg(curtail_mw) * sum(wind_mw) / sum(solar_mw + wind_mw) AS curtail_wind_mw
    FROM dispatch_rows GROUP BY 1, 2""", ["curtail_solar_mw", "curtail_wind_mw"])
def curtail_attribution(t):
    return d.curtail_attribution(dispatched(t))


COMPARED = ["cost", "deficit_mw", "after_demand_mw", "after_curtailment_mw", "after_stress"]


@query("scenario_compare", f"""
    SELECT b.scenario_id, {', '.join(f'b.{c} AS base_{c}, m.{c} AS modified_{c}' for c in COMPARED)}, m.cost - b.cost AS cost_change, m.after_stress - b.after_stress AS stress_change,
        greatest(0.0, b.after_curtailment_mw - m.after_curtailment_mw) AS curtailment_saved_mw FROM dispatch_cost b JOIN dispatch_cost m ON b.scenario_id = m.scenario_id
    WHERE b.plan_id = 'idle' AND m.plan_id = 'mixed'""", [f"{s}_{c}" for c in COMPARED for s in ("base", "modified")] + ["cost_change", "stress_change", "curtailment_saved_mw"])
def scenario_compare(t):
    return d.scenario_compare(d.dispatch_eval(dispatched(t)), "idle", "mixed")


def _scenario_values() -> str:
    from wattframe.constants import SCENARIOS

    return ", ".join(
        f"('{n}', {i}, {s[0][i]}.0::DOUBLE, {s[1][i]}.0::DOUBLE, {s[2][i]}.0::DOUBLE, {s[3]}.0::DOUBLE, {s[6]}.0::DOUBLE)" for n, s in SCENARIOS.items() for i in range(4)
    )


@query("scenario_set", f"""
    WITH c(scenario, period, demand_mw, solar_mw, wind_mw, other_generation_mw, grid_capacity_mw) AS (VALUES {_scenario_values()}),
    f AS (SELECT scenario_id AS profile_id, period, demand_mw / avg(demand_mw) OVER (PARTITION BY scenario_id) AS factor FROM scenario_periods)
    SELECT profile_id, scenario, avg(demand_mw * factor) AS demand_mw, avg(solar_mw + wind_mw) AS renewable_mw, max(demand_mw * factor - solar_mw - wind_mw - other_generation_mw) AS peak_shortfall_mw,
        sum(CASE WHEN solar_mw + wind_mw + other_generation_mw > grid_capacity_mw THEN 1 ELSE 0 END)::BIGINT AS over_capacity FROM f JOIN c ON f.period = c.period GROUP BY 1, 2""",
    ["demand_mw", "renewable_mw", "peak_shortfall_mw"])
def scenario_set(t):
    periods = v.scenario_periods(t)
    mean = periods.groupBy("scenario_id").agg(F.avg("demand_mw").alias("_mean"))
    profile = periods.join(mean, "scenario_id").select(F.col("scenario_id").alias("profile_id"), "period", (F.col("demand_mw") / F.col("_mean")).alias("factor"))
    supply = F.col("solar_mw") + F.col("wind_mw")
    return d.scenario_set(profile).groupBy("profile_id", "scenario").agg(
        F.avg("demand_mw").alias("demand_mw"), F.avg(supply).alias("renewable_mw"), F.max(F.col("demand_mw") - supply - F.col("other_generation_mw")).alias("peak_shortfall_mw"),
        F.count_if(supply + F.col("other_generation_mw") > F.col("grid_capacity_mw")).alias("over_capacity"),
    )


# --- contracts ----------------------------------------------------------------


@query("contract_status", """
    WITH x AS (SELECT asset_id, timestamp, [CASE WHEN actual_mw < 0 THEN 'actual_mw must be a non-negative number' END,
        CASE WHEN performance_ratio IS NULL OR performance_ratio < 0 THEN 'performance_ratio must be a non-negative number' END,
        CASE WHEN percentage_deviation / 100 NOT BETWEEN 0 AND 1 THEN 'anomaly_score must be a number between 0 and 1' END] AS e FROM statuses)
    SELECT asset_id, timestamp, array_to_string(list_filter(e, lambda m: m IS NOT NULL), '; ') AS errors, len(list_filter(e, lambda m: m IS NOT NULL)) = 0 AS accepted FROM x""")
def contract_status(t):
    rows = v.statuses(t).withColumn("anomaly_score", F.col("percentage_deviation") / 100).withColumn(
        "likely_root_cause", F.lit(None).cast("struct<category:string,confidence:double>")
    )
    return k.check(rows, k.status_rules()).select("asset_id", "timestamp", F.array_join("errors", "; ").alias("errors"), "accepted")


@query("contract_forecast", """
    WITH p AS (SELECT zone_id, hour, period, row_number() OVER (PARTITION BY zone_id, hour ORDER BY period) - 1 AS i, v - 15 AS dm, v - k AS lo, v + 20 - k AS hi, k, v FROM zones),
    q AS (SELECT zone_id, hour, unnest([CASE WHEN dm < 0 THEN 'demand_mw must be a non-negative number' END, CASE WHEN lo < 0 THEN 'lower_bound_mw must be a non-negative number' END,
        CASE WHEN hi < 0 THEN 'upper_bound_mw must be a non-negative number' END, CASE WHEN lo > hi THEN 'lower_bound_mw cannot exceed upper_bound_mw' END]) AS m, unnest([1, 2, 3, 4]) AS o, i FROM p),
    n AS (SELECT zone_id, hour, string_agg('points[' || i || '].' || m, '; ' ORDER BY i, o) AS nested FROM q WHERE m IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT zone_id, hour, CASE WHEN max(k) / 90 > 1 THEN 'spike_risk.probability must be a number between 0 and 1' END AS own FROM p GROUP BY 1, 2)
    SELECT r.zone_id, r.hour, concat_ws('; ', own, nested) AS errors, own IS NULL AND nested IS NULL AS accepted FROM r LEFT JOIN n ON r.zone_id = n.zone_id AND r.hour = n.hour""")
def contract_forecast(t):
    iso = F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss")
    point = F.struct(
        "period", iso.alias("timestamp"), (F.col("v") - 15).alias("demand_mw"), (F.col("v") - F.col("k")).alias("lower_bound_mw"),
        (F.col("v") + 20 - F.col("k")).alias("upper_bound_mw"),
    )
    rows = v.zones(t).groupBy("zone_id", "hour").agg(
        F.array_sort(F.collect_list(point)).alias("points"), F.struct(
            F.lit("normal").alias("level"), (F.max("k") / 90).alias("probability"), F.max("v").alias("predicted_peak_mw")
        ).alias("spike_risk"),
    ).withColumn("generated_at", iso).withColumn("horizon_minutes", F.lit(60)).withColumn("model_version", F.lit("v1")).withColumn("zone_id", F.col("zone_id").cast("string"))
    rules, nested = k.forecast_rules()
    out = k.check(rows, rules, nested)
    return out.select(F.col("zone_id").cast("long").alias("zone_id"), "hour", F.array_join("errors", "; ").alias("errors"), "accepted")


@query("contract_grid_state", """
    WITH x AS (SELECT zone_id, hour, period, [CASE WHEN v - 20 < 0 THEN 'demand_mw must be a non-negative number' END, CASE WHEN solar_v IS NULL THEN 'solar_generation_mw must be a non-negative number' END,
        CASE WHEN wind_v IS NULL THEN 'wind_generation_mw must be a non-negative number' END, CASE WHEN k * 1.1 > 100 THEN 'battery_soc_percent must be a number between 0 and 100' END,
        CASE WHEN v / 100 > 1 THEN 'grid_stress_index must be a number between 0 and 1' END] AS e FROM zones)
    SELECT zone_id, hour, period, array_to_string(list_filter(e, lambda m: m IS NOT NULL), '; ') AS errors FROM x""")
def contract_grid_state(t):
    rows = v.zones(t).select(
        "hour", "period", F.col("zone_id").cast("string").alias("zone_id"), F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), (F.col("v") - 20).alias("demand_mw"),
        F.col("solar_v").alias("solar_generation_mw"), F.col("wind_v").alias("wind_generation_mw"), F.col("v").alias("net_load_mw"), (F.col("k") * 1.1).alias("battery_soc_percent"),
        F.lit(0.0).alias("battery_power_mw"), F.lit(0.0).alias("curtailment_mw"), F.lit(50.0).alias("grid_frequency_hz"), (F.col("v") / 100).alias("grid_stress_index"),
        F.col("n").alias("active_alerts_count"),
    )
    out = k.check(rows, k.grid_state_rules())
    return out.select(F.col("zone_id").cast("long").alias("zone_id"), "hour", "period", F.array_join("errors", "; ").alias("errors"))


@query("contract_weather", """
    WITH x AS (SELECT asset_id, timestamp, [CASE WHEN temperature_2m * 4 > 90 THEN 'location.latitude must be a number between -90 and 90' END, CASE WHEN wind_speed_10m - 3 < 0 THEN 'wind_speed_ms must be a non-negative number' END,
        CASE WHEN cloud_cover * 1.2 > 100 THEN 'cloud_cover_percent must be a number between 0 and 100' END, CASE WHEN wind_direction_10m > 340 THEN 'wind_direction_degrees must be a number between 0 and 360' END] AS e FROM weather)
    SELECT asset_id, timestamp, array_to_string(list_filter(e, lambda m: m IS NOT NULL), '; ') AS errors FROM x""")
def contract_weather(t):
    rows = v.weather(t).select(
        "asset_id", "timestamp", F.struct((F.col("temperature_2m") * 4).alias("latitude"), F.lit(5.2).alias("longitude"), F.col("asset_id").alias("zone_id")).alias("location"),
        F.col("shortwave_radiation").alias("ghi_wm2"), F.col("temperature_2m").alias("temperature_celsius"), (F.col("wind_speed_10m") - 3).alias("wind_speed_ms"),
        (F.col("cloud_cover") * 1.2).alias("cloud_cover_percent"), F.lit(None).cast("double").alias("dni_wm2"), F.lit(None).cast("double").alias("dhi_wm2"),
        (F.col("wind_direction_10m") + 20).alias("wind_direction_degrees"), F.col("relative_humidity_2m").alias("relative_humidity_percent"), F.lit(False).alias("is_forecast"),
    )
    return k.check(rows, k.weather_rules()).select("asset_id", "timestamp", F.array_join("errors", "; ").alias("errors"))


@query("contract_result", """
    WITH p AS (SELECT scenario_id, plan_id, period, row_number() OVER (PARTITION BY scenario_id, plan_id ORDER BY period) - 1 AS i, discharge_mw - 4 AS power FROM dispatch_rows),
    n AS (SELECT scenario_id, plan_id, string_agg(CASE WHEN power < 0 THEN 'actions[' || i || '].power_mw must be a non-negative number' END, '; ' ORDER BY i) AS nested FROM p GROUP BY 1, 2),
    r AS (SELECT scenario_id, plan_id, CASE WHEN after_demand_mw - 120 < 0 THEN 'after.demand_mw must be a non-negative number' END AS own FROM dispatch_cost)
    SELECT r.scenario_id, r.plan_id, concat_ws('; ', own, nested) AS errors FROM r JOIN n ON r.scenario_id = n.scenario_id AND r.plan_id = n.plan_id""")
def contract_result(t):
    rows = dispatched(t)
    iso = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")
    action = F.struct("period", F.lit("BESS").alias("resource_id"), F.lit("battery_discharge").alias("action_type"), (F.col("discharge_mw") - 4).alias("power_mw"), iso.alias("start_time"), iso.alias("end_time"))
    packed = rows.groupBy("scenario_id", "plan_id").agg(F.array_sort(F.collect_list(action)).alias("actions"))
    state = d.dispatch_eval(rows)
    metric = lambda demand: F.struct(demand.alias("demand_mw"), F.col("after_renewable_mw").alias("renewable_mw"), F.col("after_curtailment_mw").alias("curtailment_mw"), F.col("after_stress").alias("grid_stress_index"))
    joined = packed.join(state, ["scenario_id", "plan_id"]).select(
        "scenario_id", "plan_id", "actions", F.lit("feasible").alias("status"), F.lit("optimal").alias("solver_status"), metric(F.col("after_demand_mw")).alias("before"),
        metric(F.col("after_demand_mw") - 120).alias("after"), F.col("cost").alias("objective_value"), F.lit(None).cast("double").alias("solve_duration_ms"),
    )
    rules, nested = k.dispatch_result_rules()
    return k.check(joined, rules, nested).select("scenario_id", "plan_id", F.array_join("errors", "; ").alias("errors"))


@query("resource_check", """
    WITH p AS (SELECT scenario_id, count(*) AS n, max(demand_mw) AS peak, max(other_generation_mw + solar_mw + wind_mw) AS supply FROM scenario_periods GROUP BY 1),
    x AS (SELECT r.*, n, peak, supply, max_discharge_mw + ev_current_mw * ev_fraction + least(ind_current_mw * ind_fraction, ind_cap_mw) AS flex FROM resources r JOIN p ON r.scenario_id = p.scenario_id),
    f AS (SELECT scenario_id, 'battery' AS field, 'current_soc_mwh > max_soc_mwh' AS message, 'error' AS severity FROM x WHERE current_soc_mwh > max_soc_mwh
        UNION ALL SELECT scenario_id, 'battery', 'current_soc_mwh < min_soc_mwh', 'error' FROM x WHERE current_soc_mwh < min_soc_mwh
        UNION ALL SELECT scenario_id, 'battery.efficiency', 'efficiency is unusually low', 'warning' FROM x WHERE efficiency < 0.7
        UNION ALL SELECT scenario_id, 'battery', 'battery nearly full', 'warning' FROM x WHERE greatest(0, max_soc_mwh - current_soc_mwh) / (max_charge_mw * sqrt(efficiency)) < 0.05
        UNION ALL SELECT scenario_id, 'ev.flexible_fraction', 'EV has demand but zero flexibility', 'warning' FROM x WHERE ev_fraction = 0
        UNION ALL SELECT scenario_id, 'industrial.max_shift_mw', 'the shift cap will bind', 'warning' FROM x WHERE ind_cap_mw < ind_current_mw * ind_fraction
        UNION ALL SELECT scenario_id, 'input', 'period count differs from n_periods', 'error' FROM x WHERE n <> 4
        UNION ALL SELECT scenario_id, 'supply_demand', 'peak demand exceeds maximum supply + flexibility', 'warning' FROM x WHERE n = 4 AND peak > supply + flex)
    SELECT * FROM f""")
def resource_check(t):
    return k.resource_check(v.resources(t), v.scenario_periods(t))


@query("source_check", """
    SELECT asset_id, timestamp, concat_ws('; ', CASE WHEN asset_type = 'hydro' THEN 'asset_type must be one of: solar, wind' END, CASE WHEN actual_mw < 0 THEN 'available_mw must be a non-negative number' END) AS errors FROM pair""")
def source_check(t):
    rows = v.pair(t).withColumnRenamed("actual_mw", "available_mw")
    return k.source_check(rows).select("asset_id", "timestamp", F.array_join("errors", "; ").alias("errors"))


@query("contract_input", """
    WITH x AS (SELECT r.scenario_id, [CASE WHEN s.demand - 120 < 0 THEN 'current_grid_state.demand_mw must be a non-negative number' END, CASE WHEN s.solar - 40 < 0 THEN 'renewable_forecast_mw must be a non-negative number' END,
        CASE WHEN current_soc_mwh * 3 > 100 THEN 'battery_constraints.current_soc_percent must be a number between 0 and 100' END,
        CASE WHEN max_soc_mwh * 2 - 35 < min_soc_mwh THEN 'battery_constraints.min_soc_percent cannot exceed max_soc_percent' END,
        CASE WHEN efficiency + 0.2 > 1 THEN 'battery_constraints.round_trip_efficiency must be a number between 0 and 1' END] AS e
        FROM resources r JOIN (SELECT scenario_id, avg(demand_mw) AS demand, avg(solar_mw) AS solar FROM scenario_periods GROUP BY 1) s ON r.scenario_id = s.scenario_id)
    SELECT scenario_id, array_to_string(list_filter(e, lambda m: m IS NOT NULL), '; ') AS errors FROM x""")
def contract_input(t):
    means = v.scenario_periods(t).groupBy("scenario_id").agg(F.avg("demand_mw").alias("_demand"), F.avg("solar_mw").alias("_solar"))
    zero, stamp = F.lit(0.0), F.lit("2024-01-01T00:00:00")
    state = F.struct(
        stamp.alias("timestamp"), F.lit("Z1").alias("zone_id"), (F.col("_demand") - 120).alias("demand_mw"), F.col("_solar").alias("solar_generation_mw"), zero.alias("wind_generation_mw"),
        zero.alias("net_load_mw"), F.lit(50.0).alias("battery_soc_percent"), zero.alias("battery_power_mw"), zero.alias("curtailment_mw"), F.lit(50.0).alias("grid_frequency_hz"),
        F.lit(0.5).alias("grid_stress_index"), F.lit(0).alias("active_alerts_count"),
    )
    battery = F.struct(
        F.col("max_soc_mwh").alias("max_capacity_mwh"), (F.col("current_soc_mwh") * 3).alias("current_soc_percent"), F.col("min_soc_mwh").alias("min_soc_percent"),
        (F.col("max_soc_mwh") * 2 - 35).alias("max_soc_percent"), F.col("max_charge_mw").alias("max_charge_power_mw"), F.col("max_discharge_mw").alias("max_discharge_power_mw"),
        (F.col("efficiency") + 0.2).alias("round_trip_efficiency"),
    )
    flexible = F.struct(F.col("ind_cap_mw").alias("total_flexible_mw"), F.col("ind_window").alias("max_shift_duration_minutes"), F.lit(3.0).alias("shift_cost_per_mw"))
    rows = v.resources(t).join(means, "scenario_id").select(
        "scenario_id", stamp.alias("target_timestamp"), F.lit(60).alias("horizon_minutes"), state.alias("current_grid_state"), (F.col("_solar") - 40).alias("renewable_forecast_mw"),
        battery.alias("battery_constraints"), flexible.alias("flexible_load_constraints"), F.lit(10.0).alias("curtailment_penalty_per_mw"),
    )
    return k.check(rows, k.dispatch_input_rules()).select("scenario_id", F.array_join("errors", "; ").alias("errors"))


@query("contract_scenario", """
    WITH p AS (SELECT zone_id, hour, period, row_number() OVER (PARTITION BY zone_id, hour ORDER BY period) - 1 AS i, v - 30 AS severity FROM zones),
    n AS (SELECT zone_id, hour, string_agg(CASE WHEN severity < 0 THEN 'injected_events[' || i || '].severity must be a non-negative number' END, '; ' ORDER BY i) AS nested, max(severity) AS top FROM p GROUP BY 1, 2)
    SELECT zone_id, hour, concat_ws('; ', CASE WHEN top < 20 THEN 'description must be a non-empty string' END, nested) AS errors FROM n""")
def contract_scenario(t):
    event = F.struct(
        "period", (F.col("period") * 15).alias("timestamp_offset_minutes"), F.lit("demand_spike").alias("event_type"), (F.col("v") - 30).alias("severity"),
        F.col("zone_id").cast("string").alias("asset_or_zone_id"),
    )
    rows = v.zones(t).groupBy("zone_id", "hour").agg(F.array_sort(F.collect_list(event)).alias("injected_events"), F.max(F.col("v") - 30).alias("_top")).select(
        "zone_id", "hour", "injected_events", F.concat(F.lit("S"), F.col("zone_id")).alias("scenario_id"), F.lit("replay").alias("name"),
        F.when(F.col("_top") < 20, "  ").otherwise("observed").alias("description"), F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("historical_source_timestamp"),
        F.struct(F.lit(True).alias("expected_feasible_optimization")).alias("expected_outcome"),
    )
    rules, nested = k.scenario_rules()
    return k.check(rows, rules, nested).select("zone_id", "hour", F.array_join("errors", "; ").alias("errors"))


@query("contract_recommendation", """
    WITH x AS (SELECT scenario_id, plan_id, [CASE WHEN cost > 20000 THEN 'urgency must be one of: low, medium, high, critical' END, CASE WHEN after_demand_mw - 100 < 0 THEN 'associated_action.power_mw must be a non-negative number' END,
        CASE WHEN after_curtailment_mw - 2 < 0 THEN 'impact_assessment.curtailment_avoided_mw must be a non-negative number' END] AS e FROM dispatch_cost)
    SELECT scenario_id, plan_id, array_to_string(list_filter(e, lambda m: m IS NOT NULL), '; ') AS errors FROM x""")
def contract_recommendation(t):
    action = F.struct(F.lit("BESS").alias("resource_id"), F.lit("battery_discharge").alias("action_type"), (F.col("after_demand_mw") - 100).alias("power_mw"), F.lit(15).alias("duration_minutes"))
    impact = F.struct((-F.col("after_stress")).alias("grid_stress_reduction"), (F.col("after_curtailment_mw") - 2).alias("curtailment_avoided_mw"))
    rows = d.dispatch_eval(dispatched(t)).select(
        "scenario_id", "plan_id", F.col("scenario_id").alias("id"), F.lit("Run plan").alias("title"), F.when(F.col("cost") > 20000, "urgent").otherwise("high").alias("urgency"),
        F.lit("dispatch").alias("category"), F.lit("text").alias("description"), F.lit("text").alias("rationale"), action.alias("associated_action"), impact.alias("impact_assessment"),
        F.lit(False).alias("is_automated_executable"),
    )
    return k.check(rows, k.recommendation_rules()).select("scenario_id", "plan_id", F.array_join("errors", "; ").alias("errors"))


@query("contract_snapshot", """
    SELECT DISTINCT CAST(zone_id AS VARCHAR) AS zone_id, CASE WHEN zone_id % 2 = 0 THEN '' ELSE 'forecast_demand.status must be one of: available, unavailable' END AS errors FROM raw""")
def contract_snapshot(t):
    from wattframe.operators.snapshot import grid_snapshot

    zones = v.raw(t).select(F.col("zone_id").cast("string").alias("zone_id")).distinct()
    rows = grid_snapshot(zones, None, None, None, None).withColumn("timestamp", F.lit("2024-01-01T00:00:00"))
    known = F.when(F.col("zone_id").cast("long") % 2 == 0, F.col("forecast_demand.status")).otherwise("unknown")
    rows = rows.withColumn("forecast_demand", F.struct(known.alias("status")))
    return k.check(rows, k.snapshot_rules()).select("zone_id", F.array_join("errors", "; ").alias("errors"))
