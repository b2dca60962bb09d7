"""Windows, splits, labels and feature frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import finite
from wattframe.operators import features as f
from wattframe.operators import splits as s
from wattframe.operators.diagnose import diag_block, in_blocks, low_run
from wattframe.operators.dispatch import action_window, dispatch_rows
from wattframe.operators.quantiles import exact_percentiles
from wattframe.operators.series import Running, attach, running
from wattframe.plans import views as v
from wattframe.plans.join_queries import _interp_sql, origins
from wattframe.plans.registry import query
from wattframe.plans.scalar_queries import CALENDAR, CYCLE_NAMES, CYCLES, HOLIDAY_DATES, SUN

W = "OVER (PARTITION BY asset_id ORDER BY timestamp"
LAGS = ", ".join(f"lag({{x}}, {m // 15}) {W}) AS demand_mw_lag_{m}m" for m in C.LAG_MINUTES)
LAG_NAMES = [f"demand_mw_lag_{m}m" for m in C.LAG_MINUTES]
SQL_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _rolling(x: str, windows=C.ROLLING_WINDOWS) -> str:
    return ", ".join(
        f"CASE WHEN count({x}) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {SQL_STATS[st]}({x}) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS {x}_roll_{st}_{n}"
        for n in windows for st in C.ROLLING_STATS
    )


ROLL_NAMES = [f"demand_mw_roll_{st}_{n}" for n in C.ROLLING_WINDOWS for st in C.ROLLING_STATS]


@query("lags", f"SELECT asset_id, timestamp, demand_mw, {LAGS.format(x='demand_mw')} FROM demand", ["demand_mw", *LAG_NAMES])
def lags(t):
    return f.lags(v.demand(t))


@query("lags_by_time", "SELECT d.asset_id, d.timestamp, d.demand_mw, " + ", ".join(f"l{m}.demand_mw AS demand_mw_lag_{m}m" for m in C.LAG_MINUTES) + " FROM demand d " + " ".join(
    f"LEFT JOIN demand l{m} ON d.asset_id = l{m}.asset_id AND l{m}.timestamp = d.timestamp - INTERVAL '{m} minutes'" for m in C.LAG_MINUTES), ["demand_mw", *LAG_NAMES])
def lags_by_time(t):
    return f.lags(v.demand(t), by="time")


@query("past_rolling", f"SELECT asset_id, timestamp, demand_mw, {_rolling('demand_mw')} FROM demand", ["demand_mw", *ROLL_NAMES])
def past_rolling(t):
    return f.past_rolling(v.demand(t))


@query("momentum", f"""
    SELECT asset_id, timestamp, lag(demand_mw, 1) {W}) - lag(demand_mw, 2) {W}) AS demand_mw_diff_15m, lag(demand_mw, 1) {W}) - lag(demand_mw, 4) {W}) AS demand_mw_diff_1h FROM demand""",
    ["demand_mw_diff_15m", "demand_mw_diff_1h"])
def momentum(t):
    return f.lags(v.demand(t)).select("asset_id", "timestamp", *f.momentum_columns("demand_mw"))


GEN_LAGS = ", ".join(f"lag(generation_mw, {k}) {W}) AS lag_{k}" for k in C.GENERATION_LAGS)


def _guard(stat: str, x: str, n: int, least: int) -> str:
    frame = f"{W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} >= {least} THEN {stat}({x}) {frame} END"


GEN_ROLLS = f"""{_guard('avg', 'generation_mw', 4, 2)} AS roll_mean_4, {_guard('avg', 'generation_mw', 96, 48)} AS roll_mean_96,
    coalesce({_guard('stddev_samp', 'generation_mw', 96, 48)}, 0) AS roll_std_96"""
GEN_NAMES = [*[f"lag_{k}" for k in C.GENERATION_LAGS], "roll_mean_4", "roll_mean_96", "roll_std_96"]


@query("gen_lags", f"SELECT asset_id, timestamp, generation_mw, {GEN_LAGS}, {GEN_ROLLS} FROM (SELECT asset_id, timestamp, CASE WHEN load IS NOT NULL THEN greatest(load / 1e6, 0) END AS generation_mw FROM dense)",
    ["generation_mw", *GEN_NAMES])
def gen_lags(t):
    from wattframe.functions.scalar import generation_mw

    return f.gen_lags(v.dense(t).select("asset_id", "timestamp", generation_mw("load").alias("generation_mw")))


HOURLY = ", ".join([f"lag(actual_mw, {k}) {W}) AS lag_{k}" for k in C.HOURLY_LAGS] + [f"{_guard('avg', 'actual_mw', n, n)} AS roll_mean_{n}" for n in C.HOURLY_WINDOWS])
HOURLY_NAMES = [*[f"lag_{k}" for k in C.HOURLY_LAGS], *[f"roll_mean_{n}" for n in C.HOURLY_WINDOWS]]


@query("hourly_lags", f"""
    SELECT * EXCLUDE (ts), CASE WHEN capacity_mw > 0 THEN lag_1 / capacity_mw END AS lagged_generation_ratio, CASE WHEN capacity_mw > 0 THEN 1.0 ELSE 0.0 END AS capacity_available, {CYCLES}
    FROM (SELECT *, timestamp AS ts, {HOURLY} FROM hourly)""", ["actual_mw", "capacity_mw", *HOURLY_NAMES, "lagged_generation_ratio", *CYCLE_NAMES])
def hourly_lags(t):
    return f.hourly_feature_frame(v.hourly(t))


@query("lead_target", "SELECT asset_id, timestamp, split, " + ", ".join(
    f"lead(demand_mw, {h // 15}) OVER (PARTITION BY asset_id, split ORDER BY timestamp) AS target_{h}m" for h in C.HORIZONS_MINUTES) + " FROM splits", [f"target_{h}m" for h in C.HORIZONS_MINUTES])
def lead_target(t):
    rows = s.lead_targets(v.split(t), "demand_mw", {f"target_{h}m": h // 15 for h in C.HORIZONS_MINUTES})
    return rows.select("asset_id", "timestamp", "split", *[f"target_{h}m" for h in C.HORIZONS_MINUTES])


TRAIN_GROWTH = """
    g AS (SELECT asset_id, timestamp, demand_mw, lead(demand_mw) OVER (PARTITION BY asset_id ORDER BY timestamp) AS next_mw FROM splits WHERE split = 'train'),
    gp AS (SELECT *, (next_mw - demand_mw) / greatest(demand_mw, 0.10) * 100 AS growth_pct, next_mw - demand_mw AS delta FROM g),
    th AS (SELECT asset_id, quantile_cont(growth_pct, 0.95) AS moderate_growth_pct, quantile_cont(growth_pct, 0.99) AS severe_growth_pct,
        quantile_cont(delta, 0.95) AS moderate_delta_mw, quantile_cont(delta, 0.99) AS severe_delta_mw FROM gp WHERE growth_pct IS NOT NULL GROUP BY 1)"""


def train_growth(t):
    return s.with_growth(v.split(t).where(F.col("split") == "train").select("asset_id", "timestamp", "demand_mw"))


@query("spike_label", f"""
    WITH {TRAIN_GROWTH}, a AS (SELECT *, (next_mw - demand_mw) / greatest(demand_mw, 0.10) * 100 AS growth_pct FROM growth)
    SELECT a.asset_id, a.timestamp, growth_pct, CASE WHEN growth_pct >= severe_growth_pct THEN 2 WHEN growth_pct >= moderate_growth_pct THEN 1 ELSE 0 END AS spike_class
    FROM a LEFT JOIN th ON a.asset_id = th.asset_id""", ["growth_pct"])
def spike_label(t):
    """Labels of all rows; assets whose train part shows no growth have no thresholds and class 0."""
    rows = attach(s.with_growth(v.demand(t)), s.spike_thresholds(train_growth(t)), ["asset_id"])
    label = s.spike_class(F.col("growth_pct"), F.col("moderate_growth_pct"), F.col("severe_growth_pct"))
    return rows.select("asset_id", "timestamp", "growth_pct", label.alias("spike_class"))


PEAK = _guard("max", "demand_mw", 96, 4)


@query("peak_24h", f"""
    WITH p AS (SELECT asset_id, timestamp, {PEAK} AS historical_peak_24h FROM demand)
    SELECT *, first_value(historical_peak_24h IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backfilled FROM p""",
    ["historical_peak_24h", "backfilled"])
def peak_24h(t):
    rows = f.peak_24h(v.demand(t)).select("asset_id", "timestamp", "historical_peak_24h")
    return running(rows, [Running("backfilled", "next", F.col("historical_peak_24h"))])


@query("rolling_ratio", f"""
    SELECT asset_id, timestamp, avg(performance_ratio) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling_performance_ratio FROM perf""", ["rolling_performance_ratio"])
def rolling_ratio(t):
    return f.rolling_ratio(v.perf(t)).select("asset_id", "timestamp", "rolling_performance_ratio")


@query("rolling_ratio_hourly", f"""
    WITH r AS (SELECT asset_id, timestamp, CASE WHEN abs(expected_mw) > 1e-6 THEN actual_mw / expected_mw END AS performance_ratio FROM hourly_perf)
    SELECT asset_id, timestamp, avg(performance_ratio) {W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_performance_ratio FROM r""", ["rolling_performance_ratio"])
def rolling_ratio_hourly(t):
    from wattframe.operators.diagnose import performance_capacity

    return f.rolling_ratio(performance_capacity(v.hourly_perf(t)), hourly=True).select("asset_id", "timestamp", "rolling_performance_ratio")


@query("low_run", f"""
    WITH l AS (SELECT asset_id, timestamp, coalesce(performance_ratio < 0.7, false) AS low FROM perf),
    i AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) {W}) AS island FROM l)
    SELECT asset_id, timestamp, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, island ORDER BY timestamp)::BIGINT AS low_run FROM i""")
def run_length(t):
    return low_run(v.perf(t), finite("performance_ratio") < C.LOW_RATIO).select("asset_id", "timestamp", "low_run")


@query("chrono_split", "SELECT asset_id, split, min(timestamp) AS split_start, max(timestamp) AS split_end, count(*) AS rows FROM splits GROUP BY 1, 2")
def chrono_split(t):
    return s.split_bounds(v.split(t))


@query("holdout_split", """
    SELECT asset_id, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split, min(timestamp) AS split_start, max(timestamp) AS split_end, count(*) AS rows
    FROM numbered GROUP BY 1, 2""")
def holdout_split(t):
    return s.split_bounds(s.holdout_split(v.demand(t)))


@query("naive_forecasts", f"""
    SELECT asset_id, timestamp, lag(demand_mw, 1) {W}) AS persistence_15, lag(demand_mw, 2) {W}) AS persistence_30, lag(demand_mw, 4) {W}) AS persistence_60,
        lag(demand_mw, 96) {W}) AS seasonal_naive FROM demand""", ["persistence_15", "persistence_30", "persistence_60", "seasonal_naive"])
def naive_forecasts(t):
    return s.baselines(v.demand(t)).drop("demand_mw")


@query("soc_path", "SELECT scenario_id, plan_id, period, soc_mwh FROM dispatch_rows", ["soc_mwh"])
def soc_path(t):
    return dispatch_rows(v.candidate_plans(t), v.scenario_periods(t), v.resources(t)).select("scenario_id", "plan_id", "period", "soc_mwh")


@query("action_window", """
    WITH a AS (SELECT scenario_id, plan_id, period, start_time, action_type, mw FROM (SELECT scenario_id, plan_id, period, start_time, discharge_mw AS battery_discharge, charge_mw AS battery_charge,
        ev_shift_mw AS shift_ev_load, ind_shift_mw AS shift_industrial_load, curtail_mw AS curtail FROM dispatch_rows)
        UNPIVOT (mw FOR action_type IN (battery_discharge, battery_charge, shift_ev_load, shift_industrial_load, curtail)))
    SELECT scenario_id, plan_id, action_type, coalesce(avg(CASE WHEN mw > 0.01 THEN mw END), 0) AS power_mw,
        min(start_time) + INTERVAL '15 minutes' * coalesce(min(CASE WHEN mw > 0.01 THEN period END), min(period))::INTEGER AS start_time,
        min(start_time) + INTERVAL '15 minutes' * (coalesce(max(CASE WHEN mw > 0.01 THEN period END), max(period)) + 1)::INTEGER AS end_time FROM a GROUP BY 1, 2, 3""", ["power_mw"])
def action_windows(t):
    return action_window(dispatch_rows(v.candidate_plans(t), v.scenario_periods(t), v.resources(t)))


OWN_BLOCK = "date_trunc('day', timestamp) - CASE WHEN extract(day FROM timestamp) % 2 = 0 THEN INTERVAL '1 day' ELSE INTERVAL '0 day' END"
# Orders as a long history, so that month ends occur.
ORDER_LOAD = "SELECT o_orderpriority AS asset_id, o_orderdate AS timestamp, sum(o_totalprice) AS load FROM orders GROUP BY 1, 2"


def order_load(t):
    rows = t.read("orders").select(F.col("o_orderpriority").alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_totalprice")
    return rows.groupBy("asset_id", "timestamp").agg(F.sum("o_totalprice").alias("load"))


@query("diag_block", f"""
    WITH o AS ({ORDER_LOAD}), b AS (SELECT *, {OWN_BLOCK} AS own FROM o),
    r AS (SELECT asset_id, timestamp, load, own AS block_start, true AS own_block FROM b UNION ALL
        SELECT asset_id, timestamp, load, own - INTERVAL '1 day', false FROM b WHERE extract(day FROM own) = 1 AND extract(day FROM own - INTERVAL '1 day') % 2 = 1 AND timestamp < own + INTERVAL '1 day')
    SELECT asset_id, CAST(block_start AS TIMESTAMP) AS block_start, own_block, count(*) AS row_count, sum(load) AS load FROM r GROUP BY 1, 2, 3""", ["load:2"])
def blocks(t):
    return in_blocks(order_load(t)).groupBy("asset_id", "block_start", "own_block").agg(F.count(F.lit(1)).alias("row_count"), F.sum("load").alias("load"))


@query("recent_ffill", """
    WITH w AS (SELECT asset_id, timestamp, CASE WHEN cloud_cover < 70 THEN cloud_cover END AS cloud_cover, CASE WHEN wind_speed_10m > 8 THEN wind_speed_10m END AS wind_speed_10m FROM weather),
    r AS (SELECT asset_id, timestamp, last_value(cloud_cover IGNORE NULLS) OVER x AS cloud_cover, last_value(wind_speed_10m IGNORE NULLS) OVER x AS wind_speed_10m,
        row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC) AS r FROM w WINDOW x AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT asset_id, timestamp, cloud_cover, wind_speed_10m, concat_ws(',', CASE WHEN cloud_cover IS NULL THEN 'cloud_cover' END, CASE WHEN wind_speed_10m IS NULL THEN 'wind_speed_10m' END) AS missing_features
    FROM r WHERE r = 1""", ["cloud_cover", "wind_speed_10m"])
def recent_ffill(t):
    rows = v.weather(t).select(
        "asset_id", "timestamp", F.when(F.col("cloud_cover") < 70, F.col("cloud_cover")).alias("cloud_cover"),
        F.when(F.col("wind_speed_10m") > 8, F.col("wind_speed_10m")).alias("wind_speed_10m"),
    )
    return f.recent_ffill(rows, ["cloud_cover", "wind_speed_10m"])


@query("exceed_targets", """
    WITH x AS (SELECT asset_id, timestamp, demand_mw AS load, split FROM splits), l AS (SELECT asset_id, quantile_cont(load, 0.98) AS upper_limit FROM x WHERE split = 'train' GROUP BY 1),
    st AS (SELECT asset_id, extract(hour FROM timestamp) * 60 + extract(minute FROM timestamp) AS m, extract(isodow FROM timestamp) AS d, avg(load) AS mu, stddev_samp(load) AS sd FROM x WHERE split = 'train' GROUP BY 1, 2, 3),
    a AS (SELECT *, lead(load, 4) OVER (PARTITION BY asset_id ORDER BY timestamp) AS nx, lead(timestamp, 4) OVER (PARTITION BY asset_id ORDER BY timestamp) AS nt FROM x)
    SELECT a.asset_id, a.timestamp, a.load, a.split, nx > upper_limit AS exceeds_limit, nx > mu + 2.5 * sd AS exceeds_usual, nx < 0 AS reverse_flow_ahead FROM a JOIN l ON a.asset_id = l.asset_id
    LEFT JOIN st ON a.asset_id = st.asset_id AND extract(hour FROM nt) * 60 + extract(minute FROM nt) = st.m AND extract(isodow FROM nt) = st.d""", ["load"])
def exceed_targets(t):
    rows = v.split(t).select("asset_id", "timestamp", F.col("demand_mw").alias("load"), "split")
    limits = exact_percentiles(rows.where("split = 'train'"), F.col("load"), {"upper_limit": 0.98}, ["asset_id"])
    return s.exceed_targets(rows, limits, 4)


# --- feature frames ---------------------------------------------------------

DEMAND_SQL_WEATHER = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "cloud_cover", "wind_speed_10m", "wind_direction_10m", "shortwave_radiation"]


DEMAND_FRAME_SQL = f"""
    WITH h AS (SELECT asset_id, timestamp, timestamp AS ts, demand_mw, {LAGS.format(x='demand_mw')}, {_rolling('demand_mw')} FROM demand)
    SELECT h.* EXCLUDE (ts), demand_mw_lag_15m - demand_mw_lag_30m AS demand_mw_diff_15m, demand_mw_lag_15m - demand_mw_lag_60m AS demand_mw_diff_1h, {CALENDAR},
        CASE WHEN x.d IS NULL THEN 0 ELSE 1 END AS is_holiday, {', '.join(DEMAND_SQL_WEATHER)}, 0.0 AS direct_radiation, 0.0 AS diffuse_radiation, 0.0 AS direct_normal_irradiance
    FROM h LEFT JOIN weather w ON h.asset_id = w.asset_id AND h.timestamp = w.timestamp LEFT JOIN (VALUES {HOLIDAY_DATES}) x(d) ON strftime(ts, '%Y-%m-%d') = x.d"""


@query("demand_feature_frame", DEMAND_FRAME_SQL,
    ["demand_mw", *LAG_NAMES, *ROLL_NAMES, "demand_mw_diff_15m", "demand_mw_diff_1h", "sin_hour", "cos_hour", "sin_dow", "cos_dow", *DEMAND_SQL_WEATHER])
def demand_feature_frame(t):
    return f.demand_feature_frame(v.demand(t), v.weather(t))


GATED = f.demand_feature_names()


@query("forecast_gate", f"""
    WITH f AS ({DEMAND_FRAME_SQL}), r AS (SELECT asset_id, timestamp, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC) AS r, count(*) OVER (PARTITION BY asset_id) AS history_rows,
        {", ".join(f"last_value({c} IGNORE NULLS) OVER x AS {c}" for c in GATED)} FROM f WINDOW x AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    g AS (SELECT asset_id, timestamp, history_rows, concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in GATED)}) AS missing_features FROM r WHERE r = 1)
    SELECT *, CASE WHEN history_rows < 96 THEN 'INSUFFICIENT_HISTORY' WHEN missing_features <> '' THEN 'MISSING_FEATURE' END AS error_code FROM g""")
def forecast_gate(t):
    """Which assets a forecast can start from, and why not from the others."""
    return f.forecast_gate(demand_feature_frame(t), GATED).select("asset_id", "timestamp", "history_rows", "missing_features", "error_code")


@query("spike_feature_frame", f"""
    WITH p AS (SELECT asset_id, timestamp, timestamp AS ts, demand_mw, {PEAK} AS historical_peak_24h, lag(demand_mw) {W}) AS forecast_load FROM demand)
    SELECT p.asset_id, p.timestamp, demand_mw AS current_load, forecast_load, (forecast_load - demand_mw) / greatest(demand_mw, 0.10) * 100 AS load_growth_pct, historical_peak_24h,
        coalesce(temperature_2m, 15) AS temp_c, coalesce(relative_humidity_2m, 70) AS humidity, coalesce(cloud_cover, 50) AS cloud_cover, coalesce(wind_speed_10m, 10) AS wind_speed,
        coalesce(shortwave_radiation, 0) AS solar_radiation, extract(hour FROM ts) AS hour, sin(2 * pi() * extract(hour FROM ts) / 24) AS hour_sin, cos(2 * pi() * extract(hour FROM ts) / 24) AS hour_cos,
        extract(isodow FROM ts) - 1 AS day_of_week, CASE WHEN extract(isodow FROM ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM p LEFT JOIN weather w ON p.asset_id = w.asset_id AND p.timestamp = w.timestamp""",
    ["current_load", "forecast_load", "load_growth_pct", "historical_peak_24h", "temp_c", "humidity", "cloud_cover", "wind_speed", "solar_radiation", "hour_sin", "hour_cos"])
def spike_feature_frame(t):
    return f.spike_feature_frame(v.demand(t), v.weather(t))


GEN_WEATHER = ["cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m"]
CLOCK = """extract(hour FROM ts) AS hour_of_day, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute_of_day, extract(doy FROM ts) AS day_of_year, extract(month FROM ts) AS month,
    extract(isodow FROM ts) - 1 AS day_of_week, CASE WHEN extract(isodow FROM ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"""


def generation_rows(t, group):
    rows = v.dense(t).where(F.col("asset_id").startswith(group)).withColumn("latitude", F.lit(52.1)).withColumn("longitude", F.lit(5.2))
    return rows.withColumn("load", F.coalesce("load", F.lit(0.0)))


def _generation_sql(kind: str, columns: list[str], extra: str, derived: str = "") -> str:
    return f"""
    WITH l AS (SELECT asset_id, timestamp, coalesce(load, 0) AS load FROM dense WHERE starts_with(asset_id, '{kind}')), {_interp_sql(GEN_WEATHER)},
    o AS (SELECT l.asset_id, l.timestamp, l.timestamp AS ts, greatest(load / 1e6, 0) AS generation_mw, 52.1 AS lat, 5.2 AS lon, {', '.join(GEN_WEATHER)} FROM l JOIN interpolated i ON l.asset_id = i.asset_id AND l.timestamp = i.timestamp),
    {SUN}, fr AS (SELECT asset_id, timestamp, generation_mw, {CLOCK}, degrees(el) AS solar_elevation_deg, CASE WHEN ha > 0 THEN 360 - az ELSE az END AS solar_azimuth_deg, greatest(0.0, sin(el)) AS cos_solar_zenith,
        {GEN_LAGS}, {GEN_ROLLS}, {', '.join(GEN_WEATHER)} {extra} FROM z)
    SELECT asset_id, timestamp, generation_mw, {', '.join(columns)} {derived} FROM fr WHERE lag_672 IS NOT NULL AND cloud_cover IS NOT NULL"""


SOLAR_ROUND = [c if c != "solar_azimuth_deg" else "solar_azimuth_deg:5" for c in f.SOLAR_FEATURES[6:]]


@query("solar_feature_frame", _generation_sql("view", list(f.SOLAR_FEATURES), ""), ["generation_mw", *SOLAR_ROUND])
def solar_feature_frame(t):
    return f.generation_feature_frame(generation_rows(t, "view"), v.weather(t), "solar")


WIND_PLAIN = [c for c in f.WIND_FEATURES if c not in ("season", "wind_speed_cubed", "wind_dir_sin", "wind_dir_cos", "air_density_proxy")]


@query("wind_feature_frame", _generation_sql(
    "click", WIND_PLAIN,
    f", {_guard('avg', 'wind_speed_10m', 4, 2)} AS wind_speed_roll_mean_4, {_guard('avg', 'wind_speed_10m', 96, 48)} AS wind_speed_roll_mean_96",
    """, CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month IN (3, 4, 5) THEN 1 WHEN month IN (6, 7, 8) THEN 2 ELSE 3 END AS season, wind_speed_10m ** 3 AS wind_speed_cubed,
        sin(radians(wind_direction_10m)) AS wind_dir_sin, cos(radians(wind_direction_10m)) AS wind_dir_cos, surface_pressure / (temperature_2m + 273.15) AS air_density_proxy"""),
    ["generation_mw", *f.WIND_FEATURES[7:]])
def wind_feature_frame(t):
    return f.generation_feature_frame(generation_rows(t, "click"), v.weather(t), "wind")


@query("input_gate", """
    SELECT d.asset_id, count(*) AS row_count, 'gust_speed' AS absent_columns, CASE WHEN count(*) > count(cloud_cover) THEN 'cloud_cover=' || (count(*) - count(cloud_cover)) ELSE '' END AS null_counts,
        'MISSING_COLUMNS' AS error_code FROM demand d LEFT JOIN weather w ON d.asset_id = w.asset_id AND d.timestamp = w.timestamp GROUP BY 1""")
def input_gate(t):
    rows = v.demand(t).join(v.weather(t), ["asset_id", "timestamp"], "left")
    return f.input_gate(rows, ["demand_mw", "cloud_cover", "gust_speed"], ["asset_id"])


@query("canonical_features", f"""
    WITH u AS (SELECT asset_id, group_name, timestamp, load, tie FROM raw QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY tie) = 1),
    h AS (SELECT *, CASE WHEN tie % 9 = 0 THEN NULL ELSE load END AS l FROM u),
    c AS (SELECT asset_id, group_name, timestamp, l IS NULL AND fl IS NOT NULL AS is_imputed, fl / 1e6 AS demand_mw, coalesce(fl < 0, false) AS is_reverse_flow
        FROM (SELECT *, last_value(l IGNORE NULLS) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fl FROM h))
    SELECT *, {LAGS.format(x='demand_mw')}, {_rolling('demand_mw', (4, 16))} FROM c""",
    ["demand_mw", *LAG_NAMES, *[f"demand_mw_roll_{st}_{n}" for n in (4, 16) for st in C.ROLLING_STATS]])
def canonical_features(t):
    """First end-to-end slice: deduplicate, fill, flag, then lags and rolling statistics."""
    from wattframe.operators.quality import fill_bounded, range_flags
    from wattframe.operators.series import POSITION, dedup, positions

    # Numbered once: neither the fill nor the features drop rows.
    rows = positions(dedup(v.raw(t).select("asset_id", "group_name", "timestamp", "load", "tie"), "tie"))
    rows = rows.withColumn("load", F.when(F.col("tie") % 9 != 0, F.col("load")))
    flagged = range_flags(fill_bounded(rows))
    base = flagged.select("asset_id", "group_name", "timestamp", "is_imputed", (F.col("load") / 1e6).alias("demand_mw"), "is_reverse_flow", POSITION)
    return f.demand_features(base, windows=(4, 16)).drop("demand_mw_diff_15m", "demand_mw_diff_1h", POSITION)
