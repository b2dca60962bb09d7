"""Joins in time, set operations, reshaping, order and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import joins as j
from wattframe.operators import metrics as m
from wattframe.operators import quality as q
from wattframe.operators import reshape as r
from wattframe.operators.diagnose import ranked_contributions, weather_columns
from wattframe.operators.series import epoch, floor_time, from_epoch, grid
from wattframe.operators.splits import baselines, stacked_baselines
from wattframe.plans import views as v
from wattframe.plans.registry import query
from wattframe.session import work_folder
from wattframe.sources import scan

WEATHER = ["cloud_cover", "wind_speed_10m", "temperature_2m"]


@query("weather_left", """
    SELECT d.asset_id, d.timestamp, demand_mw, cloud_cover, wind_speed_10m, temperature_2m FROM demand d LEFT JOIN weather w ON d.asset_id = w.asset_id AND d.timestamp = w.timestamp""",
    ["demand_mw", *WEATHER])
def weather_left(t):
    return j.weather_left(v.demand(t), v.weather(t).select("asset_id", "timestamp", *WEATHER))


@query("weather_dedup_left", """
    WITH s AS (SELECT asset_id, time_bucket(INTERVAL '15 minutes', available_at) AS timestamp, k AS cloud_cover, tie FROM raw),
    w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY tie DESC) = 1)
    SELECT p.asset_id, p.timestamp, performance_ratio, cloud_cover FROM perf p LEFT JOIN w ON p.asset_id = w.asset_id AND p.timestamp = w.timestamp""", ["performance_ratio"])
def weather_dedup_left(t):
    """Weather counts from when it is known, so some rows have none and some stamps several."""
    weather = v.raw(t).select("asset_id", floor_time("available_at", 900).alias("timestamp"), F.col("k").alias("cloud_cover"), "tie")
    return weather_columns(v.perf(t).select("asset_id", "timestamp", "performance_ratio"), weather, "tie")


def _interp_sql(columns) -> str:
    parts = []
    for c in columns:
        parts.append(f"""last_value(CASE WHEN {c} IS NOT NULL THEN {c} END IGNORE NULLS) OVER b AS a_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN epoch(timestamp) END IGNORE NULLS) OVER b AS at_{c},
            first_value({c} IGNORE NULLS) OVER f AS z_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN epoch(timestamp) END IGNORE NULLS) OVER f AS zt_{c}""")
    picks = [f"CASE WHEN a_{c} IS NULL THEN NULL WHEN z_{c} IS NULL OR at_{c} = zt_{c} THEN a_{c} ELSE a_{c} + (z_{c} - a_{c}) * (epoch(timestamp) - at_{c}) / (zt_{c} - at_{c}) END AS {c}" for c in columns]
    values = ", ".join(f"w.{c}" for c in columns)
    return f"""
    u AS (SELECT asset_id, timestamp FROM l UNION SELECT asset_id, timestamp FROM weather),
    g AS (SELECT u.asset_id, u.timestamp, {values}, l.timestamp IS NOT NULL AS is_row FROM u LEFT JOIN weather w ON u.asset_id = w.asset_id AND u.timestamp = w.timestamp
        LEFT JOIN l ON u.asset_id = l.asset_id AND u.timestamp = l.timestamp),
    i AS (SELECT asset_id, timestamp, is_row, {", ".join(parts)} FROM g WINDOW b AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    interpolated AS (SELECT asset_id, timestamp, {", ".join(picks)} FROM i WHERE is_row)"""


INTERP = ["cloud_cover", "temperature_2m", "wind_speed_10m"]


@query("interp_join", f"WITH l AS (SELECT asset_id, timestamp FROM slots), {_interp_sql(INTERP)} SELECT * FROM interpolated", INTERP)
def interp_join(t):
    return j.interp_join(grid(v.load(t), 900), v.weather(t), INTERP)


@query("expected_actual", """
    SELECT a.asset_id, a.timestamp, actual_mw, predicted_mw FROM (SELECT asset_id, timestamp, load / 1e6 AS actual_mw FROM loads) a
    JOIN (SELECT asset_id, time_bucket(INTERVAL '15 minutes', available_at) AS timestamp, avg(k) / 10 AS predicted_mw FROM raw GROUP BY 1, 2) p ON a.asset_id = p.asset_id AND a.timestamp = p.timestamp""", ["actual_mw", "predicted_mw"])
def expected_actual(t):
    predicted = v.raw(t).groupBy("asset_id", floor_time("available_at", 900).alias("timestamp")).agg((F.avg("k") / 10).alias("predicted_mw"))
    return j.expected_actual(predicted, v.demand(t).withColumnRenamed("demand_mw", "actual_mw"))


ORIGINS = "SELECT DISTINCT asset_id, date_trunc('day', timestamp) + INTERVAL '727 minutes' AS origin FROM loads"


def origins(t):
    return v.load(t).select("asset_id", from_epoch(F.floor(epoch("timestamp") / 86400) * 86400 + 727 * 60).alias("origin")).distinct()


@query("asof_history", f"""
    WITH o AS ({ORIGINS}), h AS (SELECT o.asset_id, origin, timestamp, demand_mw, row_number() OVER (PARTITION BY o.asset_id, origin ORDER BY timestamp DESC) AS r
        FROM o JOIN demand d ON o.asset_id = d.asset_id AND d.timestamp <= origin),
    a AS (SELECT asset_id, origin, count(*) AS n, max(timestamp) AS newest_ts, avg(demand_mw) AS mean_mw FROM h WHERE r <= 96 GROUP BY 1, 2)
    SELECT o.asset_id, o.origin, coalesce(n, 0) AS available_rows, newest_ts, mean_mw, CASE WHEN coalesce(n, 0) < 96 THEN 'INSUFFICIENT_HISTORY' END AS error_code
    FROM o LEFT JOIN a ON o.asset_id = a.asset_id AND o.origin = a.origin""", ["mean_mw"])
def asof_history(t):
    asked = origins(t)
    history = j.asof_history(v.demand(t), asked)
    depth = j.history_depth(history, asked)
    return depth.join(history.groupBy("asset_id", "origin").agg(F.avg("demand_mw").alias("mean_mw")), ["asset_id", "origin"], "left")


@query("asof_available", """
    WITH o AS (SELECT DISTINCT asset_id, date_trunc('hour', event_time) + INTERVAL '31 minutes' AS decided_at FROM raw),
    f AS (SELECT asset_id, available_at, max(load) AS load FROM raw GROUP BY 1, 2)
    SELECT o.asset_id, o.decided_at, f.available_at AS known_available_at, f.load FROM o ASOF LEFT JOIN f ON o.asset_id = f.asset_id AND o.decided_at >= f.available_at""", ["load:3"])
def asof_available(t):
    rows = v.raw(t)
    asked = rows.select("asset_id", from_epoch(epoch(floor_time("event_time", 3600)) + 31 * 60).alias("decided_at")).distinct()
    return j.asof_join(asked, rows, "decided_at", "available_at", ["load"])


@query("weather_versioned", """
    WITH o AS (SELECT DISTINCT asset_id, timestamp AS decided_at, h AS horizon_minutes, timestamp + INTERVAL '1 minute' * h AS valid_at FROM raw, (VALUES (15), (30), (60), (180)) x(h)),
    f AS (SELECT asset_id, valid_at, available_at, max(cloud_cover) AS cloud_cover, max(temperature_2m) AS temperature_2m FROM weather_revisions GROUP BY 1, 2, 3)
    SELECT o.*, f.available_at AS known_available_at, cloud_cover, temperature_2m
    FROM o ASOF LEFT JOIN f ON o.asset_id = f.asset_id AND date_trunc('hour', o.valid_at) = f.valid_at AND o.decided_at >= f.available_at""", ["cloud_cover", "temperature_2m"])
def weather_versioned(t):
    """Forecast weather at each horizon of each quarter hour, as known then. The revisions are written as versioned weather files and scanned from there."""
    folder = work_folder(t.spark, "forecast")
    v.weather_revisions(t).withColumnRenamed("asset_id", "station").write.parquet(f"{folder}/weather_forecasts_versioned")
    revisions = scan.scan_weather(t.spark, folder, versioned=True).drop("asset_id", "source_path").withColumnRenamed("station", "asset_id")
    asked = v.raw(t).select("asset_id", F.col("timestamp").alias("decided_at")).distinct().withColumn("horizon_minutes", F.explode(F.array(*[F.lit(h) for h in (15, 30, 60, 180)])))
    asked = asked.withColumn("valid_at", from_epoch(epoch("decided_at") + F.col("horizon_minutes") * 60))
    return j.versioned_asof(asked, revisions, ["cloud_cover", "temperature_2m"])


@query("aligned_check", """
    SELECT (SELECT count(*) FROM loads) - (SELECT count(*) FROM loads WHERE load > 0) AS only_left, CAST(0 AS BIGINT) AS only_right,
        (SELECT count(*) FROM loads WHERE load <= 0) = 0 AS aligned""")
def aligned_check(t):
    rows = v.load(t)
    return j.aligned_check(rows, rows.where(F.col("load") > 0), ["asset_id", "group_name", "timestamp"])


@query("feature_attach", """
    SELECT p.asset_id, p.timestamp, performance_ratio, demand_mw, cloud_cover FROM perf p LEFT JOIN
        (SELECT d.asset_id, d.timestamp, demand_mw, cloud_cover FROM demand d JOIN weather w ON d.asset_id = w.asset_id AND d.timestamp = w.timestamp) f
        ON p.asset_id = f.asset_id AND p.timestamp = f.timestamp""", ["performance_ratio", "demand_mw", "cloud_cover"])
def feature_attach(t):
    features = v.demand(t).join(v.weather(t).select("asset_id", "timestamp", "cloud_cover"), ["asset_id", "timestamp"])
    return j.feature_attach(v.perf(t).select("asset_id", "timestamp", "performance_ratio"), features, ["demand_mw", "cloud_cover"])


BASELINES = """
    b AS (SELECT asset_id, timestamp, demand_mw, split, lag(demand_mw, 1) OVER w AS p15, lag(demand_mw, 2) OVER w AS p30, lag(demand_mw, 4) OVER w AS p60, lag(demand_mw, 96) OVER w AS s
        FROM splits WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
    st AS (SELECT 'persistence' AS model, 15 AS horizon_minutes, demand_mw AS actual, p15 AS predicted, split, asset_id, timestamp FROM b
        UNION ALL SELECT 'persistence', 30, demand_mw, p30, split, asset_id, timestamp FROM b UNION ALL SELECT 'persistence', 60, demand_mw, p60, split, asset_id, timestamp FROM b
        UNION ALL SELECT 'seasonal_naive', h, demand_mw, s, split, asset_id, timestamp FROM b, (VALUES (15), (30), (60)) x(h)
        UNION ALL SELECT 'blend', h, demand_mw, (p15 + s) / 2, split, asset_id, timestamp FROM b, (VALUES (15), (30), (60)) x(h)),
    sc AS (SELECT model, horizon_minutes, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
        avg(CASE WHEN abs(actual) > 1e-4 THEN abs(actual - predicted) / abs(actual) END) * 100 AS mape, count(predicted) AS n
        FROM st WHERE split = 'test' AND predicted IS NOT NULL GROUP BY 1, 2)"""


def scored_models(t):
    rows = baselines(v.split(t).where(F.lit(True)))
    test = rows.where(F.col("split") == "test")
    stacked = stacked_baselines(test).select("model", "horizon_minutes", "predicted", "actual")
    blend = test.select(
        F.lit("blend").alias("model"), F.explode(F.array(*[F.lit(h) for h in (15, 30, 60)])).alias("horizon_minutes"),
        ((F.col("persistence_15") + F.col("seasonal_naive")) / 2).alias("predicted"), F.col("demand_mw").alias("actual"),
    )
    keys = ["model", "horizon_minutes"]
    return m.stack_models(m.forecast_metrics(blend, keys), m.forecast_metrics(stacked, keys))


@query("model_vs_baseline", f"""
    WITH {BASELINES} SELECT *, row_number() OVER (PARTITION BY horizon_minutes ORDER BY mae, model) AS rank,
        row_number() OVER (PARTITION BY horizon_minutes ORDER BY mae, model) = 1 AS is_winner FROM sc""", ["mae", "rmse", "mape"])
def model_vs_baseline(t):
    return m.ranked_models(scored_models(t))


@query("winner", f"WITH {BASELINES} SELECT horizon_minutes, arg_min(model, mae) AS model, min(mae) AS mae FROM sc GROUP BY 1", ["mae"])
def winner(t):
    return m.winner(scored_models(t))


@query("grid_except", "SELECT s.asset_id, s.timestamp FROM slots s ANTI JOIN loads l ON s.asset_id = l.asset_id AND s.timestamp = l.timestamp")
def grid_except(t):
    return q.missing_stamps(v.load(t))


@query("grid_union", "SELECT asset_id, timestamp FROM loads UNION SELECT asset_id, timestamp FROM weather")
def grid_union(t):
    return r.grid_union(v.load(t), v.weather(t))


LONG = """SELECT utc_timestamp AS timestamp, 'DE_solar_generation_actual' AS asset_id, 'solar' AS energy_type, DE_solar_generation_actual AS actual_mw, DE_solar_capacity AS capacity_mw, 'power_system' AS source FROM wide
    UNION ALL SELECT utc_timestamp, 'DE_wind_onshore_generation_actual', 'wind', DE_wind_onshore_generation_actual, NULL, 'power_system' FROM wide
    UNION ALL SELECT utc_timestamp, 'AT_wind_offshore_generation_actual', 'wind', AT_wind_offshore_generation_actual, NULL, 'power_system' FROM wide
    UNION ALL SELECT utc_timestamp, 'NL_wind_generation_actual', 'wind', NL_wind_generation_actual, NL_wind_capacity, 'power_system' FROM wide"""


@query("unpivot_series", LONG, ["actual_mw", "capacity_mw"])
def unpivot_series(t):
    return r.unpivot_series(v.wide(t))


@query("union_series", f"SELECT timestamp, asset_id, energy_type, actual_mw, capacity_mw, 'telemetry' AS source FROM hourly UNION ALL {LONG}", ["actual_mw", "capacity_mw"])
def union_series(t):
    return r.union_series(v.hourly(t).withColumn("source", F.lit("telemetry")), r.unpivot_series(v.wide(t)))


@query("one_hot", """
    SELECT asset_id, timestamp, CASE WHEN diagnostic_category = 'normal_production' THEN 1.0 ELSE 0.0 END AS c_normal_production,
        CASE WHEN diagnostic_category = 'uncertain' THEN 1.0 ELSE 0.0 END AS c_uncertain, 0.0 AS c_never_seen FROM diagnosis""")
def one_hot(t):
    rows = v.diagnosis(t).select("asset_id", "timestamp", "diagnostic_category")
    return r.one_hot(rows, "diagnostic_category", ["normal_production", "uncertain", "never_seen"], "c").drop("diagnostic_category")


@query("periods_to_rows", "SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY period) - 1 AS period, demand_mw, solar_mw, wind_mw FROM scenario_periods",
    ["demand_mw", "solar_mw", "wind_mw"])
def periods_to_rows(t):
    names = ["demand_mw", "solar_mw", "wind_mw"]
    return r.arrays_to_rows(r.rows_to_arrays(v.scenario_periods(t), ["scenario_id"], names), names)


@query("stable_sort", "SELECT timestamp, asset_id, load FROM loads ORDER BY timestamp, asset_id", ["load:3"])
def stable_sort(t):
    return v.load(t).select("timestamp", "asset_id", "load").orderBy("timestamp", "asset_id")


@query("top_features", """
    WITH c AS (SELECT asset_id, timestamp, f AS feature, x AS contribution FROM (SELECT asset_id, timestamp, cloud_cover - 50 AS cloud_cover, wind_speed_10m - 14 AS wind_speed_10m,
        temperature_2m AS temperature_2m, relative_humidity_2m / 7 AS relative_humidity_2m FROM weather) UNPIVOT (x FOR f IN (cloud_cover, wind_speed_10m, temperature_2m, relative_humidity_2m)))
    SELECT * FROM (SELECT *, sum(abs(contribution)) OVER (PARTITION BY asset_id, timestamp) AS magnitude,
        row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY abs(contribution) DESC, feature) AS rank FROM c) WHERE rank <= 3""", ["contribution", "magnitude"])
def top_features(t):
    return ranked_contributions(contributions(t))


def contributions(t):
    given = {
        "cloud_cover": F.col("cloud_cover") - 50, "wind_speed_10m": F.col("wind_speed_10m") - 14, "temperature_2m": F.col("temperature_2m"),
        "relative_humidity_2m": F.col("relative_humidity_2m") / 7,
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("contribution")) for n, c in given.items()])
    return v.weather(t).select("asset_id", "timestamp", F.explode(pairs).alias("_p")).select("asset_id", "timestamp", "_p.*")


@query("sample_keys", """
    SELECT asset_id, string_agg(strftime(timestamp, '%Y-%m-%d %H:%M'), ',' ORDER BY timestamp) AS sample_stamps
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS r FROM loads WHERE load < 0) WHERE r <= 10 GROUP BY 1""")
def sample_keys(t):
    return q.first_stamps(v.load(t).where(F.col("load") < 0))


@query("even_sample", """
    SELECT asset_id, timestamp, demand_mw, pos FROM numbered WHERE n < 10 OR list_contains(list_transform(range(10), lambda x: CAST(floor(x * ((n - 1) / 9.0::DOUBLE)) AS BIGINT) + 1), pos)""", ["demand_mw"])
def even_sample(t):
    return r.even_sample(v.demand(t)).select("asset_id", "timestamp", "demand_mw", F.col("_pos").alias("pos"))
