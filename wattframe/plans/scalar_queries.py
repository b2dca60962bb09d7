"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions import calendar as cal
from wattframe.functions import scalar as s
from wattframe.functions.physics import solar_position, turbine_fraction, wind_columns
from wattframe.operators import snapshot as snap
from wattframe.operators.reshape import rows_to_arrays
from wattframe.plans import views as v
from wattframe.plans.registry import query


@query("unit_convert", """
    SELECT asset_id, timestamp, CASE WHEN group_name IN ('solar_park', 'wind_park') THEN load ELSE load / 1e6 END AS demand_mw,
        CASE WHEN group_name IN ('solar_park', 'wind_park') THEN load ELSE load / 1e3 END AS demand_kw, greatest(load / 1e6, 0) AS generation_mw FROM loads""",
    ["demand_mw:3", "demand_kw:3", "generation_mw"])
def unit_convert(t):
    return v.load(t).select(
        "asset_id", "timestamp", s.load_mw("load", "group_name").alias("demand_mw"), s.load_kw("load", "group_name").alias("demand_kw"),
        s.generation_mw("load").alias("generation_mw"),
    )


CALENDAR = """extract(hour FROM ts) AS hour, extract(isodow FROM ts) - 1 AS day_of_week, CASE WHEN extract(isodow FROM ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN extract(month FROM ts) IN (12, 1, 2) THEN 1 WHEN extract(month FROM ts) IN (3, 4, 5) THEN 2 WHEN extract(month FROM ts) IN (6, 7, 8) THEN 3 ELSE 4 END AS season,
    sin(2 * pi() * extract(hour FROM ts) / 24) AS sin_hour, cos(2 * pi() * extract(hour FROM ts) / 24) AS cos_hour,
    sin(2 * pi() * (extract(isodow FROM ts) - 1) / 7) AS sin_dow, cos(2 * pi() * (extract(isodow FROM ts) - 1) / 7) AS cos_dow"""
HOLIDAY_DATES = """('2024-01-01'), ('2024-03-29'), ('2024-03-31'), ('2024-04-01'), ('2024-04-27'), ('2024-05-05'), ('2024-05-09'), ('2024-05-19'),
    ('2024-05-20'), ('2024-12-25'), ('2024-12-26')"""
# Orders spread over the days of 2024.
ORDER_DAYS = "SELECT o_orderkey, o_totalprice, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1 hour' * CAST(o_orderkey % 8784 AS INTEGER) AS ts FROM orders"


def order_days(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long")
    return t.read("orders").select("o_orderkey", "o_totalprice", F.timestamp_seconds(start + (F.col("o_orderkey") % 8784) * 3600).alias("ts"))


@query("calendar_features", f"""
    WITH o AS ({ORDER_DAYS}) SELECT o_orderkey, ts, {CALENDAR}, CASE WHEN h.d IS NULL THEN 0 ELSE 1 END AS is_holiday
    FROM o LEFT JOIN (VALUES {HOLIDAY_DATES}) h(d) ON strftime(ts, '%Y-%m-%d') = h.d""", ["sin_hour", "cos_hour", "sin_dow", "cos_dow"])
def calendar_features(t):
    return cal.with_calendar(order_days(t), "ts").drop("o_totalprice")


@query("holiday_flag", f"""
    WITH o AS ({ORDER_DAYS}) SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN h.d IS NULL THEN 0 ELSE 1 END AS is_holiday, count(*) AS orders
    FROM o LEFT JOIN (VALUES {HOLIDAY_DATES}) h(d) ON strftime(ts, '%Y-%m-%d') = h.d GROUP BY 1, 2""")
def holiday_flag(t):
    rows = cal.with_holiday(order_days(t), "ts")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "is_holiday").agg(F.count(F.lit(1)).alias("orders"))


CYCLES = """sin(2 * pi() * extract(hour FROM ts) / 24) AS hour_sin, cos(2 * pi() * extract(hour FROM ts) / 24) AS hour_cos,
    sin(2 * pi() * (extract(isodow FROM ts) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (extract(isodow FROM ts) - 1) / 7) AS day_of_week_cos,
    sin(2 * pi() * extract(doy FROM ts) / 366) AS day_of_year_sin, cos(2 * pi() * extract(doy FROM ts) / 366) AS day_of_year_cos,
    sin(2 * pi() * (extract(month FROM ts) - 1) / 12) AS month_sin, cos(2 * pi() * (extract(month FROM ts) - 1) / 12) AS month_cos"""
CYCLE_NAMES = [f"{n}_{w}" for n in ("hour", "day_of_week", "day_of_year", "month") for w in ("sin", "cos")]


@query("cyclic_calendar", f"WITH o AS ({ORDER_DAYS}) SELECT o_orderkey, {CYCLES} FROM o", CYCLE_NAMES)
def cyclic_calendar(t):
    return order_days(t).select("o_orderkey", *cal.cyclic_columns("ts"))


@query("time_of_day", f"""
    WITH o AS ({ORDER_DAYS}) SELECT o_orderkey, extract(hour FROM ts) AS hour_of_day, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute_of_day,
        extract(doy FROM ts) AS day_of_year, extract(month FROM ts) AS month, extract(isodow FROM ts) - 1 AS day_of_week, CASE WHEN extract(isodow FROM ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN extract(month FROM ts) IN (12, 1, 2) THEN 0 WHEN extract(month FROM ts) IN (3, 4, 5) THEN 1 WHEN extract(month FROM ts) IN (6, 7, 8) THEN 2 ELSE 3 END AS season FROM o""")
def time_of_day(t):
    return order_days(t).select("o_orderkey", *cal.clock_columns("ts", season=True))


SUN = """
    b AS (SELECT *, radians(lat) AS la, radians(360.0 / 365.0 * (extract(doy FROM ts) - 81)) AS bb FROM o),
    d AS (SELECT *, radians(23.45 * sin(bb)) AS de, 9.87 * sin(2 * bb) - 7.53 * cos(bb) - 1.5 * sin(bb) AS eot FROM b),
    h AS (SELECT *, radians((extract(hour FROM ts) * 60 + extract(minute FROM ts) + lon / 15 * 60 + eot) / 4 - 180) AS ha FROM d),
    e AS (SELECT *, asin(greatest(-1.0, least(1.0, sin(la) * sin(de) + cos(la) * cos(de) * cos(ha)))) AS el FROM h),
    z AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (sin(de) - sin(el) * sin(la)) / (cos(el) * cos(la) + 1e-10))))) AS az FROM e)"""


@query("solar_position", f"""
    WITH o AS (SELECT o_orderkey, ts, 50 + o_orderkey % 40 / 10.0 AS lat, 3 + o_orderkey % 30 / 10.0 AS lon FROM ({ORDER_DAYS})), {SUN}
    SELECT o_orderkey, degrees(el) AS solar_elevation_deg, CASE WHEN ha > 0 THEN 360 - az ELSE az END AS solar_azimuth_deg, greatest(0.0, sin(el)) AS cos_solar_zenith FROM z""",
    ["solar_elevation_deg", "solar_azimuth_deg:5", "cos_solar_zenith"])
def sun(t):
    rows = order_days(t).withColumn("lat", 50 + F.col("o_orderkey") % 40 / 10).withColumn("lon", 3 + F.col("o_orderkey") % 30 / 10)
    return rows.select("o_orderkey", *solar_position("ts", "lat", "lon"))


@query("wind_derived", """
    SELECT asset_id, timestamp, wind_speed_10m * wind_speed_10m * wind_speed_10m AS wind_speed_cubed, sin(radians(wind_direction_10m)) AS wind_dir_sin,
        cos(radians(wind_direction_10m)) AS wind_dir_cos, surface_pressure / nullif(temperature_2m + 273.15, 0) AS air_density_proxy FROM weather""",
    ["wind_speed_cubed", "wind_dir_sin", "wind_dir_cos", "air_density_proxy"])
def wind_derived(t):
    return v.weather(t).select("asset_id", "timestamp", *wind_columns())


@query("turbine_curve", """
    SELECT tie, CASE WHEN w >= 3 AND w < 12 THEN ((w - 3) / 9) ** 3 WHEN w >= 12 AND w <= 25 THEN 1.0 ELSE 0.0 END AS power_fraction FROM (SELECT tie, value / 4 AS w FROM raw)""",
    ["power_fraction"])
def turbine_curve(t):
    return v.raw(t).select("tie", turbine_fraction(F.col("value") / 4).alias("power_fraction"))


@query("load_growth", "SELECT asset_id, timestamp, (next_mw - demand_mw) / greatest(demand_mw, 0.10) * 100 AS growth_pct FROM growth", ["growth_pct"])
def growth(t):
    return v.growth(t).select("asset_id", "timestamp", s.load_growth("demand_mw", "next_mw").alias("growth_pct"))


NAMES = """SELECT tie, upper(asset_id) || CASE kind WHEN 'view' THEN '_solar_generation_actual' WHEN 'click' THEN '_wind_onshore_generation_actual'
    WHEN 'error' THEN '_wind_offshore_generation_actual' WHEN 'purchase' THEN '_wind_generation_actual' ELSE ' load/actual' END AS name FROM raw"""


@query("series_name_parse", f"""
    WITH n AS ({NAMES}) SELECT tie, nullif(regexp_extract(name, '^(.+)_(solar|wind)(?:_(?:onshore|offshore))?_generation_actual$', 1), '') AS region,
        nullif(regexp_extract(name, '^(.+)_(solar|wind)(?:_(?:onshore|offshore))?_generation_actual$', 2), '') AS energy_type,
        regexp_replace(name, '_generation_actual$', '_capacity') AS capacity_column, regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g') AS file_name FROM n""")
def series_name_parse(t):
    kind = F.col("kind")
    ending = (
        F.when(kind == "view", "_solar_generation_actual").when(kind == "click", "_wind_onshore_generation_actual")
        .when(kind == "error", "_wind_offshore_generation_actual").when(kind == "purchase", "_wind_generation_actual").otherwise(" load/actual")
    )
    rows = v.raw(t).select("tie", F.concat(F.upper("asset_id"), ending).alias("name"))
    return rows.select(
        "tie", s.series_region("name").alias("region"), s.series_energy("name").alias("energy_type"),
        s.capacity_name("name").alias("capacity_column"), s.safe_file_name("name").alias("file_name"),
    )


@query("flag_normalize", """
    SELECT tie, coalesce(lower(trim(w)) IN ('true', '1', 'yes', 'y', 'flagged'), false) AS from_text, tie % 3 <> 0 AS from_number, coalesce(k > 50, false) AS from_boolean
    FROM (SELECT tie, k, CASE tie % 7 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' WHEN 4 THEN 'Flagged' WHEN 5 THEN '0' END AS w FROM raw)""")
def flag_normalize(t):
    words = F.element_at(F.array(*[F.lit(x) for x in (" TRUE ", "1", "Yes", "no", "Flagged", "0", None)]), (F.col("tie") % 7 + 1).cast("int"))
    return v.raw(t).select(
        "tie", s.flag_truth(words).alias("from_text"), s.flag_truth(F.col("tie") % 3, "numeric").alias("from_number"),
        s.flag_truth(F.col("k") > 50, "boolean").alias("from_boolean"),
    )


@query("time_filter", """
    SELECT asset_id, timestamp, load FROM loads WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' AND lower(asset_id) = lower('VIEW-0')""", ["load:3"])
def time_filter(t):
    """Inclusive bounds; the condition is on the stored column, so it reaches the scan."""
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 12:15:00"))
    rows = v.raw(t, (F.col("ts") >= start) & (F.col("ts") < end)).where(F.lower("asset_id") == "view-0")
    return rows.groupBy("asset_id", "timestamp").agg(F.avg("load").alias("load"))


@query("perf_status_json", """
    SELECT asset_id AS assetId, asset_type AS assetType, strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, expected_mw AS expectedMw, actual_mw AS actualMw,
        performance_ratio AS performanceRatio, anomaly, CASE WHEN percentage_deviation / 100 BETWEEN 0 AND 1 THEN percentage_deviation / 100 END AS anomalyScore FROM statuses""",
    ["expectedMw", "actualMw", "performanceRatio", "anomalyScore"])
def perf_status_json(t):
    rows = v.statuses(t).withColumn("score", F.col("percentage_deviation") / 100)
    return rows.select(snap.status_struct().alias("s"), snap.probability_or_null("score").alias("anomalyScore")).select("s.*", "anomalyScore")


@query("fit_array_length", """
    WITH p AS (SELECT scenario_id, demand_mw, row_number() OVER (PARTITION BY scenario_id ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY scenario_id) AS n FROM scenario_periods),
    g AS (SELECT scenario_id, unnest(generate_series(0, 5)) AS place, any_value(n) AS n FROM p GROUP BY scenario_id)
    SELECT g.scenario_id, place, p.demand_mw FROM g JOIN p ON g.scenario_id = p.scenario_id AND p.i = g.place % g.n""", ["demand_mw"])
def fit_array_length(t):
    arrays = rows_to_arrays(v.scenario_periods(t), ["scenario_id"], ["demand_mw"])
    return arrays.select("scenario_id", F.posexplode(s.fit_array("demand_mw", 6)).alias("place", "demand_mw"))


@query("stress_severity", """
    SELECT tie, CASE WHEN value / 100 >= 0.90 THEN 'critical' WHEN value / 100 >= 0.75 THEN 'warning' ELSE 'normal' END AS severity FROM raw""")
def stress_severity(t):
    return v.raw(t).select("tie", s.stress_severity(F.col("value") / 100).alias("severity"))


@query("action_what_if", """
    WITH a AS (SELECT zone_id, hour, period, least(1.0, v / 100) AS stress, k AS soc, n * 2.5 AS mw, action FROM zones, (VALUES ('battery_discharge'), ('battery_charge'), ('shift_flexible_load'), ('hold')) x(action)),
    d AS (SELECT *, CASE WHEN action IN ('battery_discharge', 'shift_flexible_load') THEN -least(0.40, mw / 100 * 0.5) WHEN action = 'battery_charge' THEN mw / 100 * 0.3 ELSE 0.0 END AS delta,
        (CASE WHEN action IN ('battery_discharge', 'shift_flexible_load') AND mw > 20 THEN 1 ELSE 0 END) + (CASE WHEN action = 'battery_charge' AND soc >= 90 THEN 1 ELSE 0 END) AS warnings FROM a)
    SELECT zone_id, hour, period, action, greatest(0.10, least(1.0, stress + delta)) AS projected_stress, delta AS delta_stress, warnings = 0 AS feasible, warnings FROM d""",
    ["projected_stress", "delta_stress"])
def action_what_if(t):
    actions = F.array(*[F.lit(a) for a in ("battery_discharge", "battery_charge", "shift_flexible_load", "hold")])
    state = v.zones(t).select(
        "zone_id", "hour", "period", F.least(F.lit(1.0), F.col("v") / 100).alias("stress"), F.col("k").alias("soc"), (F.col("n") * 2.5).alias("mw"),
        F.explode(actions).alias("action"),
    )
    out = state.withColumn("r", s.what_if("action", "mw", "stress", "soc"))
    return out.select("zone_id", "hour", "period", "action", "r.projected_stress", "r.delta_stress", "r.feasible", F.size("r.warnings").alias("warnings"))


TEXTS = """SELECT tie AS text_id, CAST(zone_id AS VARCHAR) || '@' || strftime(event_time, '%Y-%m-%dT%H') AS run_id,
        CASE tie % 4 WHEN 0 THEN 'Please discharge ' || CAST(floor(value) / 4 AS VARCHAR) || ' MW now' WHEN 1 THEN 'CURTAIL 5.3 mw, then shift 4MWh of load'
            WHEN 2 THEN 'Nothing to dispatch today' ELSE 'recharge 10 MW; charge   4 mw' END AS text FROM raw
    UNION ALL SELECT -(conv_id * 10000 + turn) - 1, NULL, CASE WHEN turn % 3 = 0 THEN text || ' Dispatch 12.5 MW.' ELSE text END FROM conversations"""
CLAIMS = r"""(?i)\b(discharge|charge|dispatch|curtail|curtailment|shift)\s+(\d+(?:\.\d+)?)\s*(mw|mwh)\b"""


@query("dispatch_text_audit", f"""
    WITH x AS ({TEXTS}), m AS (SELECT text_id, run_id, regexp_extract_all(text, '{CLAIMS}', 0) AS c, regexp_extract_all(text, '{CLAIMS}', 2) AS p FROM x),
    f AS (SELECT text_id, run_id, unnest(range(len(c))) AS claim_no, unnest(c) AS claim, round(CAST(unnest(p) AS DOUBLE), 1) AS power_mw FROM m),
    r AS (SELECT scenario_id AS run_id, CASE WHEN max_discharge_mw = 0 THEN 'infeasible' ELSE 'feasible' END AS status FROM resources),
    a AS (SELECT DISTINCT scenario_id AS run_id, round(discharge_mw, 1) AS power_mw FROM plans)
    SELECT * FROM (SELECT f.*, CASE WHEN r.status IS NULL THEN 'no_run' WHEN r.status = 'infeasible' THEN 'infeasible_run'
        WHEN a.power_mw IS NULL AND f.power_mw > 0 THEN 'unverified_power' END AS violation FROM f LEFT JOIN r ON f.run_id = r.run_id LEFT JOIN a ON f.run_id = a.run_id AND f.power_mw = a.power_mw)
    WHERE violation IS NOT NULL""", ["power_mw"])
def dispatch_text_audit(t):
    which = F.col("tie") % 4
    text = (
        F.when(which == 0, F.concat(F.lit("Please discharge "), (F.floor("value") / 4).cast("string"), F.lit(" MW now")))
        .when(which == 1, "CURTAIL 5.3 mw, then shift 4MWh of load").when(which == 2, "Nothing to dispatch today").otherwise("recharge 10 MW; charge   4 mw")
    )
    run = F.concat(F.col("zone_id").cast("string"), F.lit("@"), F.date_format("event_time", "yyyy-MM-dd'T'HH"))
    logs = v.raw(t).select(F.col("tie").alias("text_id"), run.alias("run_id"), text.alias("text"))
    talk = t.read("conversations").select(
        (-(F.col("conv_id") * 10000 + F.col("turn")) - 1).alias("text_id"), F.lit(None).cast("string").alias("run_id"),
        F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Dispatch 12.5 MW."))).otherwise(F.col("text")).alias("text"),
    )
    runs = v.resources(t).select(
        F.col("scenario_id").alias("run_id"), F.when(F.col("max_discharge_mw") == 0, "infeasible").otherwise("feasible").alias("status")
    )
    actions = v.candidate_plans(t).select(F.col("scenario_id").alias("run_id"), F.col("discharge_mw").alias("power_mw"))
    return snap.dispatch_text_audit(logs.unionByName(talk), runs, actions)


POINTS = """SELECT zone_id, hour, period, 60 + v AS demand_mw, CASE WHEN k > 20 THEN 60 + v - k / 3 END AS lower_bound_mw, CASE WHEN k > 20 THEN 60 + v + k / 2 END AS upper_bound_mw, solar_v AS renewable_mw FROM zones"""


@query("net_load_trend", f"""
    SELECT zone_id, hour, period, greatest(0.0, demand_mw - coalesce(renewable_mw, 0)) AS net_load_mw,
        (coalesce(upper_bound_mw, demand_mw) - coalesce(lower_bound_mw, demand_mw)) / 2 AS half_band_mw FROM ({POINTS})""", ["net_load_mw", "half_band_mw"])
def net_load_trend(t):
    given = F.col("k") > 20
    points = v.zones(t).select(
        "zone_id", "hour", "period", (60 + F.col("v")).alias("demand_mw"), F.when(given, 60 + F.col("v") - F.col("k") / 3).alias("lower_bound_mw"),
        F.when(given, 60 + F.col("v") + F.col("k") / 2).alias("upper_bound_mw"), F.col("solar_v").alias("renewable_mw"),
    )
    return snap.net_load_trend(points).select("zone_id", "hour", "period", "net_load_mw", "half_band_mw")
