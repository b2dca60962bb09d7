"""Cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import quality as q
from wattframe.operators.quantiles import exact_percentiles
from wattframe.operators.series import dedup
from wattframe.plans import views as v
from wattframe.plans.registry import query

# Texts with some stamps and loads that do not parse.
TEXT_ROWS = """
    SELECT asset_id, tie, CASE WHEN tie % 89 = 0 THEN 'not-a-timestamp' ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') END AS timestamp,
        CASE WHEN tie % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS load, available_at FROM raw"""


def text_rows(t):
    stamp = F.when(F.col("tie") % 89 == 0, "not-a-timestamp").otherwise(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))
    load = F.when(F.col("tie") % 97 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return v.raw(t).select("asset_id", "tie", stamp.alias("timestamp"), load.alias("load"), "available_at")


@query("schema_check", f"""
    WITH x AS ({TEXT_ROWS}), b AS (SELECT sum(CASE WHEN TRY_CAST(load AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS n FROM x)
    SELECT 'required' AS check_name, 'timestamp' AS column_name, 'error' AS severity, true AS passed, CAST(0 AS BIGINT) AS bad_rows
    UNION ALL SELECT 'required', 'load', 'error', true, 0 UNION ALL SELECT 'numeric', 'load', 'error', n = 0, CAST(n AS BIGINT) FROM b
    UNION ALL SELECT 'optional', 'available_at', 'warning', true, 0 UNION ALL SELECT 'optional', 'quality_code', 'warning', false, 0""")
def schema_check(t):
    return q.schema_check(text_rows(t), optional=("available_at", "quality_code"))


@query("ts_normalize", f"""
    WITH x AS ({TEXT_ROWS}), p AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM x),
    o AS (SELECT asset_id, ts, lag(ts) OVER (PARTITION BY asset_id ORDER BY tie) AS before FROM p WHERE ts IS NOT NULL)
    SELECT a.*, coalesce(m.monotonic, true) AS monotonic FROM
        (SELECT asset_id, count(*) AS rows_in, count(ts) AS rows_out, count(*) - count(ts) AS dropped, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1) a
        LEFT JOIN (SELECT asset_id, sum(CASE WHEN ts < before THEN 1 ELSE 0 END) = 0 AS monotonic FROM o GROUP BY 1) m ON a.asset_id = m.asset_id""")
def ts_normalize(t):
    return q.ts_report(text_rows(t), sequence="tie")


@query("dedup_first", """
    SELECT asset_id, timestamp, load, tie FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY tie) AS r FROM raw) WHERE r = 1""", ["load:3"])
def dedup_first(t):
    return dedup(v.raw(t).select("asset_id", "timestamp", "load", "tie"), "tie")


@query("duplicate_report", """
    WITH k AS (SELECT asset_id, timestamp, count(*) AS n FROM raw GROUP BY 1, 2),
    s AS (SELECT asset_id, string_agg(strftime(timestamp, '%Y-%m-%d %H:%M'), ',' ORDER BY timestamp) AS sample_stamps
        FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS r FROM k WHERE n > 1) WHERE r <= 10 GROUP BY 1)
    SELECT t.*, sample_stamps FROM (SELECT asset_id, CAST(sum(n) AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM k GROUP BY 1) t
    LEFT JOIN s ON t.asset_id = s.asset_id""")
def duplicate_report(t):
    return q.duplicate_report(v.raw(t))


GAPS = """
    d AS (SELECT asset_id, timestamp, lag(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp) AS before FROM loads),
    g AS (SELECT asset_id, count(*) AS actual, CAST(sum(CASE WHEN epoch(timestamp) - epoch(before) <> 900 THEN 1 ELSE 0 END) AS BIGINT) AS irregular_deltas FROM d GROUP BY 1),
    e AS (SELECT asset_id, count(*) AS expected FROM slots GROUP BY 1),
    a AS (SELECT s.asset_id, s.timestamp, row_number() OVER (PARTITION BY s.asset_id ORDER BY s.timestamp) AS r
        FROM slots s ANTI JOIN loads l ON s.asset_id = l.asset_id AND s.timestamp = l.timestamp),
    m AS (SELECT asset_id, count(*) AS missing, string_agg(CASE WHEN r <= 10 THEN strftime(timestamp, '%Y-%m-%d %H:%M') END, ',' ORDER BY timestamp) AS missing_sample FROM a GROUP BY 1)"""


@query("gap_detect", f"""
    WITH {GAPS} SELECT g.asset_id, expected, actual, coalesce(missing, 0) AS missing, coalesce(missing, 0) * 100.0 / expected AS missing_pct,
        coalesce(irregular_deltas, 0) AS irregular_deltas, missing_sample
    FROM g JOIN e ON g.asset_id = e.asset_id LEFT JOIN m ON g.asset_id = m.asset_id""", ["missing_pct"])
def gap_detect(t):
    return q.gap_detect(v.load(t))


FILL = "last_value(load IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("fill_bounded", f"""
    SELECT asset_id, timestamp, f AS load, load IS NULL AND f IS NOT NULL AS is_imputed, f IS NULL AS is_unresolved FROM (SELECT *, {FILL} AS f FROM dense)""", ["load:3"])
def fill_bounded(t):
    return q.fill_bounded(v.dense(t))


@query("null_policy", """
    SELECT asset_id, count(*) AS rows_in, count(*) - count(load) AS left_null, count(load) AS rows_after_drop, count(*) - count(load) AS dropped FROM dense GROUP BY 1""")
def null_policy(t):
    return q.null_policy_report(v.dense(t))


LIMITS = """CASE WHEN group_name IN ('solar_park', 'wind_park') THEN load NOT BETWEEN -1.05 AND 0.05 ELSE load NOT BETWEEN -500e6 AND 500e6 END"""


@query("range_flags", f"SELECT asset_id, timestamp, load, {LIMITS} AS is_out_of_range, load < 0 AS is_reverse_flow FROM loads", ["load:3"])
def range_flags(t):
    return q.range_flags(v.load(t)).drop("group_name")


@query("range_report", f"""
    SELECT asset_id, CAST(sum(CASE WHEN {LIMITS} THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, CAST(sum(CASE WHEN load < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reverse_flow,
        min(load) AS observed_min, max(load) AS observed_max FROM loads GROUP BY 1""", ["observed_min:3", "observed_max:3"])
def range_report(t):
    return q.range_report(q.range_flags(v.load(t)))


# Raw rows with every ninth load missing.
HOLES = "SELECT asset_id, group_name, timestamp, tie, CASE WHEN tie % 9 = 0 THEN NULL ELSE load END AS load, available_at FROM raw"


def holes(t):
    return v.raw(t).select(
        "asset_id", "group_name", "timestamp", "tie", F.when(F.col("tie") % 9 != 0, F.col("load")).alias("load"), "available_at"
    )


@query("canonicalize", f"""
    WITH h AS ({HOLES}), u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY tie) = 1),
    f AS (SELECT * EXCLUDE (load), load IS NULL AND {FILL} IS NOT NULL AS is_imputed, {FILL} AS load FROM u)
    SELECT timestamp, asset_id, group_name, load, CASE WHEN group_name IN ('solar_park', 'wind_park') THEN load ELSE load / 1e6 END AS demand_mw,
        CASE WHEN group_name IN ('solar_park', 'wind_park') THEN load ELSE load / 1e3 END AS demand_kw, available_at, is_imputed,
        coalesce({LIMITS}, false) AS is_out_of_range, coalesce(load < 0, false) AS is_reverse_flow FROM f""", ["load:3", "demand_mw:3", "demand_kw:3"])
def canonicalize(t):
    return q.canonicalize(holes(t), "tie")


@query("quality_report", f"""
    WITH h AS ({HOLES}), u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY tie) = 1),
    f AS (SELECT *, {FILL} AS filled FROM u), {GAPS},
    c AS (SELECT asset_id, count(*) AS rows_out, sum(CASE WHEN load IS NULL AND filled IS NOT NULL THEN 1 ELSE 0 END) AS imputed,
        sum(CASE WHEN filled IS NULL THEN 1 ELSE 0 END) AS unresolved, sum(CASE WHEN filled < 0 THEN 1 ELSE 0 END) AS reverse_flow, max(filled) AS observed_max FROM f GROUP BY 1),
    r AS (SELECT asset_id, count(*) AS rows_in FROM h GROUP BY 1)
    SELECT r.asset_id, rows_in, rows_out, rows_out * 100.0 / rows_in AS retention_pct, rows_in - rows_out AS extra_rows, expected, coalesce(missing, 0) AS missing,
        coalesce(irregular_deltas, 0) AS irregular_deltas, CAST(imputed AS BIGINT) AS imputed, CAST(unresolved AS BIGINT) AS unresolved, CAST(reverse_flow AS BIGINT) AS reverse_flow, observed_max
    FROM r JOIN c ON r.asset_id = c.asset_id JOIN e ON r.asset_id = e.asset_id JOIN g ON r.asset_id = g.asset_id LEFT JOIN m ON r.asset_id = m.asset_id""",
    ["retention_pct", "observed_max:3"])
def quality_report(t):
    return q.quality_report(holes(t), "tie").select(
        "asset_id", "rows_in", "rows_out", "retention_pct", "duplicates.extra_rows", "gaps.expected", "gaps.missing", "gaps.irregular_deltas",
        "missing_values.imputed", "missing_values.unresolved", "flags.reverse_flow", "observed.observed_max",
    )


CAPACITY = {
    "DE_solar_generation_actual": "DE_solar_capacity", "DE_wind_onshore_generation_actual": None,
    "AT_wind_offshore_generation_actual": None, "NL_wind_generation_actual": "NL_wind_capacity",
}


@query("series_quality", """
    WITH d AS (SELECT epoch(utc_timestamp) - epoch(lag(utc_timestamp) OVER (ORDER BY utc_timestamp)) AS gap FROM wide)
    SELECT row_count, CAST(0 AS BIGINT) AS invalid_stamps, missing_generation, missing_capacity, CAST(0 AS BIGINT) AS duplicate_stamps, irregular_steps, missing_steps, first_ts, last_ts,
        row_count * 4 AS normalized_rows, 1 AS solar_series, 3 AS wind_series, 2 AS series_with_capacity, 2 AS series_without_capacity
    FROM (SELECT count(*) AS row_count, min(utc_timestamp) AS first_ts, max(utc_timestamp) AS last_ts,
            4 * count(*) - count(DE_solar_generation_actual) - count(DE_wind_onshore_generation_actual) - count(AT_wind_offshore_generation_actual) - count(NL_wind_generation_actual) AS missing_generation,
            2 * count(*) - count(DE_solar_capacity) - count(NL_wind_capacity) AS missing_capacity FROM wide),
        (SELECT CAST(coalesce(sum(CASE WHEN gap <> 3600 THEN 1 ELSE 0 END), 0) AS BIGINT) AS irregular_steps,
            CAST(coalesce(sum(CASE WHEN gap > 3600 THEN greatest(floor(gap / 3600) - 1, 0) END), 0) AS BIGINT) AS missing_steps FROM d)""")
def series_quality(t):
    wide = v.wide(t)
    return q.series_quality(wide.withColumn("utc_timestamp", F.col("utc_timestamp").cast("string")), list(CAPACITY), CAPACITY, 3600)


@query("strict_order_gate", f"""
    WITH x AS ({TEXT_ROWS}), p AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM x),
    o AS (SELECT asset_id, ts, lag(ts) OVER (PARTITION BY asset_id ORDER BY tie) AS before FROM p WHERE ts IS NOT NULL)
    SELECT a.*, duplicate_stamps, not_increasing FROM (SELECT asset_id, count(*) - count(ts) AS invalid_stamps, count(*) AS row_count FROM p GROUP BY 1) a
    LEFT JOIN (SELECT asset_id, CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS duplicate_stamps FROM p WHERE ts IS NOT NULL GROUP BY 1) b ON a.asset_id = b.asset_id
    LEFT JOIN (SELECT asset_id, CAST(sum(CASE WHEN ts <= before THEN 1 ELSE 0 END) AS BIGINT) AS not_increasing FROM o GROUP BY 1) c ON a.asset_id = c.asset_id""")
def strict_order_gate(t):
    return q.strict_order_gate(text_rows(t), "timestamp", "tie", ["asset_id"])


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null, count(*) - count({c}) AS missing, "
        f"(count(*) - count({c})) * 100.0 / count(*) AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM {table}" for c, kind in columns.items()
    )


WIDE_TYPES = {"utc_timestamp": "timestamp"} | dict.fromkeys([
    "DE_solar_generation_actual", "DE_wind_onshore_generation_actual", "AT_wind_offshore_generation_actual", "NL_wind_generation_actual", "DE_solar_capacity", "NL_wind_capacity",
], "double")
EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("column_profile", f"""
    WITH rounded AS (SELECT {", ".join(f"round({c}, 6) AS {c}" if kind == "double" else c for c, kind in WIDE_TYPES.items())} FROM wide)
    {_profile_sql("events", EVENT_TYPES)} UNION ALL {_profile_sql("rounded", WIDE_TYPES)}""", ["missing_pct"])
def column_profile(t):
    wide = v.wide(t).withColumns({c: F.round(c, 6) for c, kind in WIDE_TYPES.items() if kind == "double"})
    return q.column_profile(t.read("events")).unionByName(q.column_profile(wide))


@query("sampling_freq", """
    WITH d AS (SELECT asset_id, (epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp))) / 60 AS delta_minutes FROM loads),
    c AS (SELECT asset_id, delta_minutes, count(*) AS steps FROM d WHERE delta_minutes IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY steps DESC, delta_minutes) AS rank FROM c)
    SELECT *, rank = 1 AS is_modal, 15 / delta_minutes = floor(15 / delta_minutes) AS divides_15, 30 / delta_minutes = floor(30 / delta_minutes) AS divides_30,
        60 / delta_minutes = floor(60 / delta_minutes) AS divides_60 FROM r WHERE rank <= 15""", ["delta_minutes"])
def sampling_freq(t):
    return q.sampling_freq(v.load(t))


@query("coverage_summary", """
    WITH u AS (SELECT asset_id, timestamp, count(*) AS n FROM raw GROUP BY 1, 2),
    d AS (SELECT asset_id, (epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp))) / 60 AS gap FROM u)
    SELECT a.*, median_gap, largest_gap, coalesce(intervals, 0) AS intervals FROM
        (SELECT asset_id, CAST(sum(n) AS BIGINT) AS row_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM u GROUP BY 1) a
        LEFT JOIN (SELECT asset_id, quantile_cont(gap, 0.5) AS median_gap, max(gap) AS largest_gap, count(gap) AS intervals FROM d WHERE gap IS NOT NULL GROUP BY 1) b ON a.asset_id = b.asset_id""",
    ["median_gap", "largest_gap"])
def coverage_summary(t):
    return q.coverage_summary(v.raw(t))


@query("dup_keys", """
    SELECT 'all_columns' AS key_set, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicates FROM raw
    UNION ALL SELECT 'timestamp', count(*) - count(DISTINCT timestamp) FROM raw
    UNION ALL SELECT 'timestamp_zone', count(*) - (SELECT count(*) FROM (SELECT DISTINCT zone_id, timestamp FROM raw)) FROM raw
    UNION ALL SELECT 'timestamp_feeder', count(*) - (SELECT count(*) FROM (SELECT DISTINCT asset_id, timestamp FROM raw)) FROM raw""")
def dup_keys(t):
    rows = v.raw(t)
    return q.dup_keys(rows, {
        "all_columns": tuple(rows.columns), "timestamp": ("timestamp",), "timestamp_zone": ("zone_id", "timestamp"), "timestamp_feeder": ("asset_id", "timestamp"),
    })


@query("value_profile", """
    WITH l AS (SELECT asset_id, load / 1000 AS load FROM loads),
    s AS (SELECT asset_id, string_agg(printf('%.4f', load), ',' ORDER BY load) AS smallest FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY load) AS r FROM l) WHERE r <= 5 GROUP BY 1),
    b AS (SELECT asset_id, string_agg(printf('%.4f', load), ',' ORDER BY load DESC) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY load DESC) AS r FROM l) WHERE r <= 5 GROUP BY 1)
    SELECT t.*, smallest, largest FROM (SELECT asset_id, CAST(sum(CASE WHEN load < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN load = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero,
        CAST(sum(CASE WHEN load > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, count(*) - count(load) AS missing, avg(load) AS mean, stddev_samp(load) AS std, min(load) AS min, max(load) AS max,
        quantile_cont(load, 0.5) AS median FROM l GROUP BY 1) t JOIN s ON t.asset_id = s.asset_id JOIN b ON t.asset_id = b.asset_id""", ["mean", "std", "min", "max", "median"])
def value_profile(t):
    rows = v.load(t).select("asset_id", (F.col("load") / 1000).alias("load"))
    middle = exact_percentiles(rows, F.col("load"), {"median": 0.5}, ["asset_id"])
    return q.value_profile(rows, "load", ["asset_id"]).join(middle, "asset_id")


LEAKY = "SELECT asset_id, demand_mw, next_mw AS target_next_mw, next_mw - demand_mw AS forecast_lead_mw FROM growth"


@query("leakage_columns", f"""
    WITH x AS ({LEAKY}) SELECT * FROM (SELECT 'target_next_mw' AS column_name, 'double' AS data_type, count(target_next_mw) AS non_null, count(*) - count(target_next_mw) AS missing,
        (count(*) - count(target_next_mw)) * 100.0 / count(*) AS missing_pct, 'target' AS matched FROM x
    UNION ALL SELECT 'forecast_lead_mw', 'double', count(forecast_lead_mw), count(*) - count(forecast_lead_mw), (count(*) - count(forecast_lead_mw)) * 100.0 / count(*), 'lead,forecast' FROM x)""",
    ["missing_pct"])
def leakage_columns(t):
    rows = v.growth(t).select("asset_id", "demand_mw", F.col("next_mw").alias("target_next_mw"), (F.col("next_mw") - F.col("demand_mw")).alias("forecast_lead_mw"))
    return q.leakage_columns(rows).drop("distinct_values")


@query("leakage_audit", """
    WITH l AS (SELECT asset_id, timestamp, demand_mw, CASE WHEN epoch(timestamp)::BIGINT % 86400 = 0 THEN demand_mw ELSE lag(demand_mw) OVER (PARTITION BY asset_id ORDER BY timestamp) END AS lag_1 FROM demand),
    p AS (SELECT *, lag(demand_mw) OVER (PARTITION BY asset_id ORDER BY timestamp) AS before FROM l)
    SELECT asset_id, count(lag_1 + before) AS checked, CAST(coalesce(sum(CASE WHEN abs(lag_1 - before) > 1e-10 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM p GROUP BY 1""")
def leakage_audit(t):
    from wattframe.operators.series import Running, epoch, running

    rows = running(v.demand(t), [Running("lag_1", "prev", F.col("demand_mw"))])
    # Midnight rows leak their own value on purpose, so the audit has something to find.
    rows = rows.withColumn("lag_1", F.when(epoch("timestamp") % 86400 == 0, F.col("demand_mw")).otherwise(F.col("lag_1")))
    return q.leakage_audit(rows, "demand_mw", "lag_1")


HOUR_TYPES = {"timestamp": "timestamp"} | dict.fromkeys([
    "cloud_cover", "wind_speed_10m", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_direction_10m", "shortwave_radiation", "load",
], "double")


@query("column_candidates", f"""
    WITH hours AS (SELECT w.timestamp, {", ".join(f"round({c}, 6) AS {c}" for c, kind in HOUR_TYPES.items() if kind == "double")}
        FROM weather w LEFT JOIN loads l ON w.asset_id = l.asset_id AND w.timestamp = l.timestamp),
    p AS ({_profile_sql("hours", HOUR_TYPES)}),
    c(role, column_name, matched) AS (VALUES ('timestamp', 'timestamp', 'timestamp,time'), ('demand_load', 'load', 'load'), ('weather', 'temperature_2m', 'temperature,temp'),
        ('weather', 'relative_humidity_2m', 'humidity'), ('weather', 'cloud_cover', 'cloud'), ('weather', 'wind_speed_10m', 'wind'), ('weather', 'wind_direction_10m', 'wind'),
        ('weather', 'surface_pressure', 'pressure'), ('weather', 'shortwave_radiation', 'radiation'), ('wind', 'wind_speed_10m', 'wind'), ('wind', 'wind_direction_10m', 'wind'))
    SELECT c.role, c.matched, p.* FROM c JOIN p ON c.column_name = p.column_name""", ["missing_pct"])
def column_candidates(t):
    hours = v.weather(t).join(v.load(t), ["asset_id", "timestamp"], "left")
    hours = hours.withColumns({c: F.round(c, 6) for c, kind in HOUR_TYPES.items() if kind == "double"})
    found = q.column_candidates(hours)
    return found.join(q.column_profile(hours, [c for c in hours.columns if c != "asset_id"]), "column_name")
