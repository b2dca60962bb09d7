"""SQL twins of the bindings in `views.py`, as common table expressions."""

from __future__ import annotations

import re

SQL_VIEWS: dict[str, str] = {
    "raw": """
        SELECT event_id AS tie, event_type || '-' || CAST(user_id // 100 AS VARCHAR) AS asset_id,
            CASE event_type WHEN 'view' THEN 'mv_feeder' WHEN 'click' THEN 'transformer' WHEN 'error' THEN 'solar_park'
                WHEN 'purchase' THEN 'wind_park' ELSE 'station_installation' END AS group_name,
            user_id // 100 AS zone_id, event_type AS kind, ts AS event_time,
            time_bucket(INTERVAL '15 minutes', ts) AS timestamp,
            (value - 20) * 98765.4321 AS load, value,
            CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 1.00123456789 AS k,
            ts + INTERVAL '20 minutes' * CAST(event_id % 7 AS INTEGER) AS available_at
        FROM events""",
    "loads": """
        SELECT asset_id, timestamp, avg(load) AS load, min(group_name) AS group_name FROM raw GROUP BY asset_id, timestamp""",
    "span": "SELECT asset_id, min(timestamp) AS a, max(timestamp) AS z FROM loads GROUP BY asset_id",
    "slots": """
        SELECT asset_id, unnest(generate_series(a, z, INTERVAL '15 minutes')) AS timestamp FROM span""",
    "dense": """
        SELECT s.asset_id, s.timestamp, l.load FROM slots s LEFT JOIN loads l ON s.asset_id = l.asset_id AND s.timestamp = l.timestamp""",
    "demand": """
        SELECT asset_id, timestamp, load / 1e6 AS demand_mw FROM loads""",
    "weather": """
        SELECT asset_id, date_trunc('hour', event_time) AS timestamp, avg(k) AS cloud_cover, avg(k) / 4 AS wind_speed_10m,
            avg(k) / 3 - 5 AS temperature_2m, 40 + avg(k) / 2 AS relative_humidity_2m, 980 + avg(k) / 2 AS surface_pressure,
            avg(k) * 3.6 AS wind_direction_10m, avg(k) * 8 AS shortwave_radiation
        FROM raw GROUP BY 1, 2""",
    "weather_revisions": """
        SELECT asset_id, date_trunc('hour', event_time) AS valid_at,
            date_trunc('hour', event_time) - INTERVAL '1 second' * (tie % 5 * 3600 - CASE WHEN tie % 11 = 0 THEN 1800 ELSE 0 END) AS available_at, k AS cloud_cover, k / 3 - 5 AS temperature_2m
        FROM raw""",
    "pair": """
        SELECT asset_id, CASE min(kind) WHEN 'error' THEN 'solar' WHEN 'view' THEN 'solar' WHEN 'signup' THEN 'hydro' ELSE 'wind' END AS asset_type,
            timestamp, greatest(0.0, avg(k) - 10) * 0.0987654321 AS expected_mw, avg(value - 1) * 0.0987654321 AS actual_mw
        FROM raw GROUP BY asset_id, timestamp""",
    "perf": """
        SELECT *, actual_mw - expected_mw AS absolute_deviation,
            CASE WHEN expected_mw < 1e-4 THEN CASE WHEN actual_mw < 1e-4 THEN 0.0 END ELSE (actual_mw - expected_mw) / expected_mw * 100 END AS percentage_deviation,
            CASE WHEN expected_mw < 1e-4 THEN CASE WHEN actual_mw < 1e-4 THEN 1.0 END ELSE actual_mw / expected_mw END AS performance_ratio,
            expected_mw < 1e-4 AND actual_mw >= 1e-4 AS zero_expected_edge_case
        FROM pair""",
    "hourly": """
        SELECT asset_id, date_trunc('hour', event_time) AS timestamp, CASE WHEN min(kind) IN ('view', 'error') THEN 'solar' ELSE 'wind' END AS energy_type,
            avg(value) * 0.987654321 AS actual_mw, CASE WHEN min(kind) IN ('view', 'click') THEN 400 + avg(k) END AS capacity_mw
        FROM raw GROUP BY 1, 2""",
    "hourly_perf": """
        SELECT h.*, avg(actual_mw) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS expected_mw FROM hourly h""",
    "wide": """
        SELECT date_trunc('hour', ts) AS utc_timestamp,
            avg(CASE WHEN event_type = 'view' THEN value END) AS DE_solar_generation_actual,
            avg(CASE WHEN event_type = 'click' THEN value END) AS DE_wind_onshore_generation_actual,
            avg(CASE WHEN event_type = 'error' THEN value END) AS AT_wind_offshore_generation_actual,
            avg(CASE WHEN event_type = 'purchase' THEN value END) AS NL_wind_generation_actual,
            max(CASE WHEN event_type = 'signup' THEN value END) AS DE_solar_capacity,
            max(CASE WHEN event_type = 'signup' AND value > 60 THEN value END) AS NL_wind_capacity
        FROM events GROUP BY 1""",
    "numbered": """
        SELECT asset_id, timestamp, demand_mw, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS pos,
            count(*) OVER (PARTITION BY asset_id) AS n FROM demand""",
    "splits": """
        SELECT *, CASE WHEN pos <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN pos <= CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
        FROM numbered""",
    "growth": """
        SELECT *, lead(demand_mw) OVER (PARTITION BY asset_id ORDER BY timestamp) AS next_mw FROM demand""",
    "zones": """
        SELECT zone_id, date_trunc('hour', event_time) AS hour, CAST(extract(minute FROM event_time) AS BIGINT) // 15 AS period,
            avg(value) * 0.987654321 AS v, avg(k) AS k, avg(CASE WHEN kind = 'view' THEN value END) * 0.987654321 AS solar_v,
            avg(CASE WHEN kind = 'click' THEN value END) * 0.987654321 AS wind_v,
            max(value) AS peak_v, count(*) AS n
        FROM raw GROUP BY 1, 2, 3""",
    "scenario_periods": """
        SELECT CAST(zone_id AS VARCHAR) || '@' || strftime(hour, '%Y-%m-%dT%H') AS scenario_id, period, hour AS start_time,
            90 + v AS demand_mw, coalesce(solar_v, 5) AS solar_mw, coalesce(wind_v, 4) AS wind_mw, 40 + k / 3 AS other_generation_mw,
            4 + k / 10 AS ev_demand_mw, 10 + k / 5 AS industrial_demand_mw
        FROM zones""",
    "resources": """
        SELECT CAST(zone_id AS VARCHAR) || '@' || strftime(hour, '%Y-%m-%dT%H') AS scenario_id, 150 + avg(v) AS grid_capacity_mw,
            5 + avg(k) / 2 AS current_soc_mwh, 5.0 AS min_soc_mwh, CASE WHEN max(peak_v) > 300 THEN 20.0 ELSE 50.0 END AS max_soc_mwh, 20.0 AS max_charge_mw,
            CASE WHEN min(k) < 5 THEN 0.0 ELSE 20.0 END AS max_discharge_mw, CASE WHEN max(peak_v) > 200 THEN 0.6 ELSE 0.9 END AS efficiency,
            12.0 AS ev_current_mw, CASE WHEN max(k) > 98 THEN 0.0 ELSE 0.4 END AS ev_fraction, 60 AS ev_window,
            28.0 AS ind_current_mw, 0.3 AS ind_fraction, CASE WHEN min(k) < 20 THEN 6.0 ELSE 12.0 END AS ind_cap_mw, 120 AS ind_window
        FROM zones GROUP BY zone_id, hour""",
    "plans": """
        SELECT s.scenario_id, p.plan_id, s.period,
            CASE p.plan_id WHEN 'store' THEN 6.0 + period WHEN 'mixed' THEN CASE WHEN period < 2 THEN 3.0 ELSE 0.0 END ELSE 0.0 END AS charge_mw,
            CASE p.plan_id WHEN 'release' THEN 5.0 + ind_fraction * period WHEN 'mixed' THEN CASE WHEN period >= 1 THEN 4.0 ELSE 0.0 END ELSE 0.0 END AS discharge_mw,
            CASE p.plan_id WHEN 'release' THEN ev_fraction * ev_demand_mw ELSE 0.0 END AS ev_shift_mw,
            CASE p.plan_id WHEN 'release' THEN 2.5 WHEN 'mixed' THEN 1.0 ELSE 0.0 END AS ind_shift_mw,
            CASE p.plan_id WHEN 'idle' THEN solar_mw / 4 WHEN 'mixed' THEN wind_mw / 8 ELSE 0.0 END AS curtail_mw
        FROM scenario_periods s JOIN resources USING (scenario_id), (VALUES ('idle'), ('store'), ('release'), ('mixed')) p(plan_id)""",
    "dispatch_rows": """
        SELECT p.plan_id, s.*, r.* EXCLUDE (scenario_id), p.charge_mw, p.discharge_mw, p.ev_shift_mw, p.ind_shift_mw, p.curtail_mw,
            solar_mw + wind_mw - curtail_mw AS used_mw,
            (demand_mw - ev_shift_mw - ind_shift_mw) - (other_generation_mw + (solar_mw + wind_mw - curtail_mw) + discharge_mw - charge_mw) AS residual,
            current_soc_mwh + sum(sqrt(efficiency) * charge_mw * 0.25 - discharge_mw / sqrt(efficiency) * 0.25)
                OVER (PARTITION BY p.scenario_id, p.plan_id ORDER BY p.period) AS soc_mwh
        FROM plans p JOIN scenario_periods s ON p.scenario_id = s.scenario_id AND p.period = s.period JOIN resources r ON r.scenario_id = s.scenario_id""",
    "dispatch_cost": """
        SELECT scenario_id, plan_id, any_value(grid_capacity_mw) AS grid_capacity_mw,
            sum(10 * curtail_mw + 100 * greatest(residual, 0) + greatest(-residual, 0) + 0.5 * (charge_mw + discharge_mw) + 2 * ev_shift_mw + 3 * ind_shift_mw) AS cost,
            sum(greatest(residual, 0)) AS deficit_mw, sum(greatest(-residual, 0)) AS oversupply_mw,
            0 AS missing_violations, sum(CASE WHEN least(charge_mw, discharge_mw, ev_shift_mw, ind_shift_mw, curtail_mw) < -1e-6 THEN 1 ELSE 0 END) AS negative_violations,
            sum(CASE WHEN soc_mwh < min_soc_mwh - 1e-6 OR soc_mwh > max_soc_mwh + 1e-6 THEN 1 ELSE 0 END) AS soc_violations,
            sum(CASE WHEN charge_mw > max_charge_mw + 1e-6 THEN 1 ELSE 0 END) AS charge_violations,
            sum(CASE WHEN discharge_mw > max_discharge_mw + 1e-6 THEN 1 ELSE 0 END) AS discharge_violations,
            sum(CASE WHEN charge_mw > 1e-6 AND discharge_mw > 1e-6 THEN 1 ELSE 0 END) AS both_violations,
            sum(CASE WHEN ev_shift_mw > ev_fraction * ev_demand_mw + 1e-6 THEN 1 ELSE 0 END) AS ev_violations,
            sum(CASE WHEN ind_shift_mw > least(ind_fraction * industrial_demand_mw, ind_cap_mw) + 1e-6 THEN 1 ELSE 0 END) AS ind_violations,
            sum(CASE WHEN curtail_mw < -1e-6 OR curtail_mw > solar_mw + wind_mw + 1e-6 THEN 1 ELSE 0 END) AS curtail_violations,
            sum(CASE WHEN other_generation_mw + used_mw + discharge_mw > grid_capacity_mw + 1e-6 THEN 1 ELSE 0 END) AS capacity_violations,
            avg(demand_mw - ev_shift_mw - ind_shift_mw) AS after_demand_mw, avg(used_mw) AS after_renewable_mw, avg(curtail_mw) AS after_curtailment_mw,
            least(1.0, greatest(0.0, avg(demand_mw - ev_shift_mw - ind_shift_mw) - avg(used_mw) - avg(other_generation_mw) - avg(discharge_mw - charge_mw)) / any_value(grid_capacity_mw)) AS after_stress
        FROM dispatch_rows GROUP BY scenario_id, plan_id""",
    "impossible_plans": """
        SELECT * FROM plans UNION ALL SELECT * REPLACE ('gaps' AS plan_id, 0.125 AS ev_shift_mw) FROM plans WHERE plan_id = 'mixed' AND period <> 2
        UNION ALL SELECT * REPLACE ('drain' AS plan_id, CASE WHEN period = 1 THEN -3.0 ELSE charge_mw END AS charge_mw, 0.0625 AS ind_shift_mw) FROM plans WHERE plan_id = 'store'
        UNION ALL SELECT * REPLACE ('beyond' AS plan_id, curtail_mw + 0.0625 AS curtail_mw) FROM plans WHERE plan_id = 'idle'
        UNION ALL SELECT * REPLACE ('beyond' AS plan_id, 7 AS period, 900.0 AS discharge_mw, 0.0 AS curtail_mw) FROM plans WHERE plan_id = 'idle' AND period = 0""",
    "partial_resources": """
        SELECT * REPLACE (CASE WHEN kind <> 0 THEN grid_capacity_mw END AS grid_capacity_mw, CASE WHEN kind <> 2 THEN current_soc_mwh END AS current_soc_mwh,
            CASE WHEN kind <> 2 THEN min_soc_mwh END AS min_soc_mwh, CASE WHEN kind <> 2 THEN max_soc_mwh END AS max_soc_mwh, CASE WHEN kind <> 2 THEN max_charge_mw END AS max_charge_mw,
            CASE WHEN kind <> 2 THEN max_discharge_mw END AS max_discharge_mw, CASE WHEN kind <> 2 THEN efficiency END AS efficiency)
        FROM (SELECT *, floor(current_soc_mwh)::BIGINT % 5 AS kind FROM resources) WHERE kind <> 1""",
    "impossible_rows": """
        SELECT *, solar_mw + wind_mw - curtail_mw AS used_mw,
            (demand_mw - ev_shift_mw - ind_shift_mw) - (other_generation_mw + (solar_mw + wind_mw - curtail_mw) + discharge_mw - charge_mw) AS residual,
            current_soc_mwh + sum(sqrt(efficiency) * charge_mw * 0.25 - discharge_mw / sqrt(efficiency) * 0.25) OVER (PARTITION BY scenario_id, plan_id ORDER BY period) AS soc_mwh
        FROM (SELECT scenario_id, plan_id, period, known IS NOT NULL AS known, listed IS NOT NULL AS listed,
                coalesce(demand_mw, 0) AS demand_mw, coalesce(solar_mw, 0) AS solar_mw, coalesce(wind_mw, 0) AS wind_mw, coalesce(other_generation_mw, 0) AS other_generation_mw,
                coalesce(ev_demand_mw, 0) AS ev_demand_mw, coalesce(industrial_demand_mw, 0) AS industrial_demand_mw, coalesce(charge_mw, 0) AS charge_mw, coalesce(discharge_mw, 0) AS discharge_mw,
                coalesce(ev_shift_mw, 0) AS ev_shift_mw, coalesce(ind_shift_mw, 0) AS ind_shift_mw, coalesce(curtail_mw, 0) AS curtail_mw, coalesce(grid_capacity_mw, 0) AS grid_capacity_mw,
                coalesce(current_soc_mwh, 0) AS current_soc_mwh, coalesce(min_soc_mwh, 0) AS min_soc_mwh, coalesce(max_soc_mwh, 0) AS max_soc_mwh, coalesce(max_charge_mw, 0) AS max_charge_mw,
                coalesce(max_discharge_mw, 0) AS max_discharge_mw, coalesce(efficiency, 1) AS efficiency, coalesce(ev_fraction, 0) AS ev_fraction, coalesce(ind_fraction, 0) AS ind_fraction, ind_cap_mw
            FROM (SELECT q.plan_id, s.*, true AS known FROM (SELECT DISTINCT scenario_id, plan_id FROM impossible_plans) q JOIN scenario_periods s USING (scenario_id))
                FULL JOIN (SELECT *, true AS listed FROM impossible_plans) USING (scenario_id, plan_id, period) LEFT JOIN partial_resources USING (scenario_id))""",
    "impossible_cost": """
        SELECT scenario_id, plan_id, any_value(grid_capacity_mw) AS grid_capacity_mw,
            sum(10 * curtail_mw + 100 * greatest(residual, 0) + greatest(-residual, 0) + 0.5 * (charge_mw + discharge_mw) + 2 * ev_shift_mw + 3 * ind_shift_mw) AS cost,
            sum(greatest(residual, 0)) AS deficit_mw, sum(greatest(-residual, 0)) AS oversupply_mw,
            sum(CASE WHEN listed THEN 0 ELSE 1 END) AS missing_violations, sum(CASE WHEN known THEN 0 ELSE 1 END) AS unknown_violations, sum(CASE WHEN least(charge_mw, discharge_mw, ev_shift_mw, ind_shift_mw, curtail_mw) < -1e-6 THEN 1 ELSE 0 END) AS negative_violations,
            sum(CASE WHEN soc_mwh < min_soc_mwh - 1e-6 OR soc_mwh > max_soc_mwh + 1e-6 THEN 1 ELSE 0 END) AS soc_violations,
            sum(CASE WHEN charge_mw > max_charge_mw + 1e-6 THEN 1 ELSE 0 END) AS charge_violations,
            sum(CASE WHEN discharge_mw > max_discharge_mw + 1e-6 THEN 1 ELSE 0 END) AS discharge_violations,
            sum(CASE WHEN charge_mw > 1e-6 AND discharge_mw > 1e-6 THEN 1 ELSE 0 END) AS both_violations,
            sum(CASE WHEN ev_shift_mw > ev_fraction * ev_demand_mw + 1e-6 THEN 1 ELSE 0 END) AS ev_violations,
            sum(CASE WHEN ind_shift_mw > least(ind_fraction * industrial_demand_mw, ind_cap_mw) + 1e-6 THEN 1 ELSE 0 END) AS ind_violations,
            sum(CASE WHEN curtail_mw < -1e-6 OR curtail_mw > solar_mw + wind_mw + 1e-6 THEN 1 ELSE 0 END) AS curtail_violations,
            sum(CASE WHEN other_generation_mw + used_mw + discharge_mw > grid_capacity_mw + 1e-6 THEN 1 ELSE 0 END) AS capacity_violations,
            avg(CASE WHEN known THEN demand_mw - ev_shift_mw - ind_shift_mw END) AS after_demand_mw, avg(CASE WHEN known THEN used_mw END) AS after_renewable_mw,
            avg(CASE WHEN known THEN curtail_mw END) AS after_curtailment_mw,
            CASE WHEN any_value(grid_capacity_mw) <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, avg(CASE WHEN known THEN demand_mw - ev_shift_mw - ind_shift_mw END) - avg(CASE WHEN known THEN used_mw END)
                - avg(CASE WHEN known THEN other_generation_mw END) - avg(CASE WHEN known THEN discharge_mw - charge_mw END)) / any_value(grid_capacity_mw)) END AS after_stress
        FROM impossible_rows GROUP BY scenario_id, plan_id""",
    "statuses": """
        SELECT p.asset_id, split_part(p.asset_id, '-', 2) AS zone_id, asset_type, timestamp, expected_mw, actual_mw, performance_ratio, percentage_deviation,
            coalesce(performance_ratio < 0.5, true) AS anomaly
        FROM perf p""",
    "diagnosis": """
        SELECT z.*, CASE WHEN invalid THEN 'data_quality_issue' WHEN low_run >= 4 AND NOT explained THEN 'possible_physical_fault'
                WHEN low AND explained THEN 'weather_driven_reduction' WHEN performance_ratio BETWEEN 0.9 AND 1.1 THEN 'normal_production' ELSE 'uncertain' END AS diagnostic_category,
            CASE WHEN invalid THEN 0.98 WHEN low_run >= 4 AND NOT explained THEN 0.70
                WHEN low AND explained THEN least(1.0, CASE WHEN asset_type = 'wind' THEN 0.90 ELSE 0.80 + 0.15 * cloud_cover / 100 END)
                WHEN performance_ratio BETWEEN 0.9 AND 1.1 THEN 0.95 ELSE 0.25 END AS diagnostic_confidence
        FROM (SELECT y.*, CASE WHEN low THEN row_number() OVER (PARTITION BY asset_id, island ORDER BY timestamp) - CASE WHEN island = 0 THEN 0 ELSE 1 END ELSE 0 END AS low_run
            FROM (SELECT x.*, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY timestamp) AS island
                FROM (SELECT p.*, w.cloud_cover, w.wind_speed_10m,
                    zero_expected_edge_case OR performance_ratio IS NULL OR actual_mw < 0 AS invalid,
                    performance_ratio < 0.70 AND NOT (zero_expected_edge_case OR performance_ratio IS NULL OR actual_mw < 0) AS low,
                    coalesce((asset_type = 'solar' AND w.cloud_cover >= 80) OR (asset_type = 'wind' AND w.wind_speed_10m <= 3), false) AS explained
                    FROM perf p LEFT JOIN weather w ON p.asset_id = w.asset_id AND p.timestamp = w.timestamp) x) y) z""",
}

_NAMES = re.compile(r"\b(" + "|".join(sorted(SQL_VIEWS, key=len, reverse=True)) + r")\b")


def _needs(text: str, found: list[str]) -> None:
    for name in _NAMES.findall(re.sub(r"'[^']*'", "", text)):
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text) and name not in found:
            _needs(SQL_VIEWS[name], found)
            found.append(name)


def with_views(sql: str) -> str:
    """Prefix the views a statement uses."""
    found: list[str] = []
    _needs(sql, found)
    if not found:
        return sql
    views = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in found)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {views}, {text[5:]}"
    return f"WITH {views} {text}"
