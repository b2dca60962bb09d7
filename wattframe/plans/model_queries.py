"""Fitting and scoring jobs. Fitted models have no SQL form; their closed-form parts do."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.models import anomaly, boosted, cause, hourly, store
from wattframe.operators import diagnose as g
from wattframe.operators import features as f
from wattframe.operators import metrics as m
from wattframe.operators import splits as s
from wattframe.operators.series import attach, epoch
from wattframe.operators.snapshot import status_struct
from wattframe.plans import views as v
from wattframe.plans.diagnosis_queries import CURTAILED, flagged
from wattframe.plans.registry import query
from wattframe.plans.scalar_queries import SUN
from wattframe.plans.window_queries import CLOCK, DEMAND_FRAME_SQL, GEN_LAGS, GEN_ROLLS, GEN_WEATHER, LAG_NAMES, ROLL_NAMES, _guard, train_growth
from wattframe.session import cut_lineage, work_folder


def demand_models(t):
    return boosted.demand_forecast_fit(f.demand_feature_frame(v.demand(t), v.weather(t)))


@query("demand_forecast_fit")
def demand_forecast_fit(t):
    """Test scores of the boosted horizons next to the baselines on the same rows."""
    fitted, test = demand_models(t)
    boosted_rows = boosted.stacked_predictions(fitted.predict(test)).select("model", "horizon_minutes", "predicted", "actual")
    naive = s.stacked_baselines(s.baselines(v.split(t)).where(F.col("split") == "test")).select("model", "horizon_minutes", "predicted", "actual")
    keys = ["model", "horizon_minutes"]
    return m.ranked_models(m.stack_models(m.forecast_metrics(boosted_rows, keys), m.forecast_metrics(naive, keys)))


@query("generation_fit")
def generation_fit(t):
    """Pooled solar and wind regressors with absolute loss, scored on the last fifth of each series."""
    hourly = s.holdout_split(f.hourly_feature_frame(v.hourly(t)).na.drop(subset=["lag_168", "roll_mean_168"]))
    frame = cut_lineage(hourly)
    names = [*f.HOURLY_FEATURES, "lagged_generation_ratio", "capacity_available"]
    rows = lambda kind, part: frame.where((F.col("energy_type") == kind) & (F.col("split") == part))
    fit = lambda kind: lambda: boosted.pooled_fit(rows(kind, "train"), names, "actual_mw", C.HOURLY_ROUNDS, "absolute", patience=C.HOURLY_PATIENCE)
    fitted = boosted.fit_together({kind: fit(kind) for kind in C.MAPE_RULES if kind != "hourly"})
    parts = []
    for kind, model in fitted.items():
        parts.append(m.gen_metrics(model.predict(rows(kind, "validation"), "predicted", floor=0.0), ["energy_type"], "hourly", "actual_mw", "predicted"))
    return parts[0].unionByName(parts[1])


@query("forecast_points")
def forecast_points(t):
    """The forecast from the newest row of each asset, one row per point with the spike risk, or one row with the reason why there is none."""
    features = cut_lineage(f.demand_feature_frame(v.demand(t), v.weather(t)))
    fitted, _ = boosted.demand_forecast_fit(features)
    gated = cut_lineage(f.forecast_gate(features, fitted.names))
    usable = gated.where("error_code IS NULL").drop("missing_features", "history_rows", "error_code")
    scored = cut_lineage(boosted.forecast_points(fitted.predict(usable), fitted.rmse))
    spikes, _ = spike_models(t, features)
    keys = ["asset_id", "timestamp"]
    next_quarter = scored.select(*keys, F.col("predicted_15").alias("forecast_mw"))
    inputs = f.spike_feature_frame(v.demand(t).join(next_quarter, keys, "left"), v.weather(t), "forecast_mw")
    risk = spikes.predict(inputs.join(usable.select(*keys), keys, "left_semi"))
    records = boosted.forecast_contract(scored.join(risk.select(*keys, "level", "probability"), keys, "left"))
    points = records.select(
        "zone_id", "generated_at", "horizon_minutes", F.explode("points").alias("_p"), "spike_risk.level", "spike_risk.probability", "spike_risk.predicted_peak_mw"
    ).select("zone_id", "generated_at", "horizon_minutes", "level", "probability", "predicted_peak_mw", F.col("_p.timestamp").alias("point_at"), "_p.demand_mw", "_p.lower_bound_mw", "_p.upper_bound_mw")
    failed = gated.where("error_code IS NOT NULL").select(F.col("asset_id").alias("zone_id"), F.col("timestamp").alias("generated_at"), "error_code")
    return points.unionByName(failed, allowMissingColumns=True)


@query("forecast_band", """
    WITH p AS (SELECT asset_id, timestamp, demand_mw AS p15, lag(demand_mw) OVER w AS p30, lag(demand_mw, 3) OVER w AS p60 FROM demand WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
    x AS (SELECT asset_id, timestamp, m, CASE m WHEN 15 THEN p15 WHEN 30 THEN p30 WHEN 45 THEN (p30 + p60) / 2 ELSE p60 END AS value,
        CASE m WHEN 15 THEN 0.0829 WHEN 30 THEN 0.0972 WHEN 45 THEN (0.0972 + 0.1257) / 2 ELSE 0.1257 END AS e FROM p, (VALUES (15), (30), (45), (60)) q(m)),
    y AS (SELECT *, CASE WHEN value IS NOT NULL THEN greatest(value, 0) END AS d FROM x)
    SELECT asset_id, timestamp AS origin, timestamp + INTERVAL '1 minute' * m AS timestamp, d AS demand_mw, CASE WHEN d IS NOT NULL THEN greatest(d - 1.96 * e, 0) END AS lower_bound_mw, d + 1.96 * e AS upper_bound_mw FROM y""",
    ["demand_mw", "lower_bound_mw", "upper_bound_mw"])
def forecast_band(t):
    """Band arithmetic on known values: persistence in place of the models."""
    from wattframe.operators.series import row_windows

    w = lambda w: [F.col("demand_mw").alias("predicted_15"), F.lag("demand_mw", 1).over(w).alias("predicted_30"), F.lag("demand_mw", 3).over(w).alias("predicted_60")]
    rows = row_windows(v.demand(t), w, before=3)
    points = boosted.forecast_points(rows, C.FALLBACK_RMSE)
    return points.select("asset_id", F.col("timestamp").alias("origin"), F.explode("points").alias("_p")).select("asset_id", "origin", "_p.*")


@query("anomaly_forest")
def anomaly_forest(t):
    """48-hour block forests on 15-minute rows."""
    found = anomaly.detect_anomalies(g.apply_curtailment(flagged(t), "curtailed"))
    return found.select("asset_id", "timestamp", "diagnostic_category", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly", "anomaly_suppressed_reason")


@query("anomaly_forest_hourly")
def anomaly_forest_hourly(t):
    """Per-series forests on hourly rows, counted per series."""
    found = anomaly.hourly_anomalies(v.hourly_perf(t))
    return m.anomaly_manifest(found, ["asset_id", "energy_type"])


def crossed(features):
    """Demand rows with the 15-minute forecast of a model that has not seen them."""
    return boosted.cross_fitted_forecast(boosted.cross_fit_frame(features))


_FULL = " AND ".join(f"{c} IS NOT NULL" for c in (*LAG_NAMES, *ROLL_NAMES))


@query("spike_cross_fit", f"""
    WITH f AS ({DEMAND_FRAME_SQL}),
    p AS (SELECT asset_id, timestamp, split, CASE WHEN split = 'train' THEN CAST(floor((pos - 1) * {C.CROSS_FOLDS} / floor(n * 0.7::DOUBLE)) AS BIGINT) ELSE {C.CROSS_FOLDS} END AS fold FROM splits),
    l AS (SELECT *, lead(fold) OVER (PARTITION BY asset_id ORDER BY timestamp) = fold AS within FROM p),
    r AS (SELECT l.* FROM f JOIN l ON f.asset_id = l.asset_id AND f.timestamp = l.timestamp WHERE {_FULL}),
    c AS (SELECT fold, split, count(*) AS rows FROM r GROUP BY 1, 2)
    SELECT fold, split, rows, CASE WHEN fold = 0 THEN 0 ELSE rows END AS forecasts, (SELECT count(*) FROM r WHERE r.fold < c.fold AND within) AS learnt_rows, 0 AS negative FROM c""")
def spike_cross_fit(t):
    """Rows of each fold, those with a forecast, and the rows its model learnt."""
    frame = cut_lineage(boosted.cross_fit_frame(f.demand_feature_frame(v.demand(t), v.weather(t))))
    counted = boosted.cross_fitted_forecast(frame).groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("forecast_mw").alias("forecasts"), F.count_if(F.col("forecast_mw") < 0).alias("negative")
    )
    known = frame.groupBy("fold").agg(F.count("_target").alias("_n"))
    earlier = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    learnt = known.select("fold", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("learnt_rows"))
    return counted.join(learnt, "fold")


def spike_models(t, features=None):
    features = features if features is not None else f.demand_feature_frame(v.demand(t), v.weather(t))
    forecasts = cut_lineage(crossed(features)).select("asset_id", "timestamp", "forecast_mw")
    rows = f.spike_feature_frame(v.demand(t).join(forecasts, ["asset_id", "timestamp"], "left"), v.weather(t), "forecast_mw")
    limits = s.spike_thresholds(train_growth(t))
    labelled = attach(s.with_growth(v.split(t)), limits, ["asset_id"]).select(
        "asset_id", "timestamp", "split", s.spike_class(F.col("growth_pct"), F.col("moderate_growth_pct"), F.col("severe_growth_pct")).alias("spike_class")
    )
    frame = cut_lineage(rows.join(labelled, ["asset_id", "timestamp"]).where(F.col("historical_peak_24h").isNotNull()))
    return boosted.spike_fit(frame.where(F.col("split") == "train")), frame


@query("spike_fit")
def spike_fit(t):
    model, frame = spike_models(t)
    scored = model.predict(frame.where(F.col("split") == "test")).withColumn("series", F.lit("all"))
    return m.class_report(scored, ["series"], actual="spike_class", predicted="predicted_class")


CLOCK_NAMES = ("hour_of_day", "minute_of_day", "day_of_year", "month", "day_of_week", "is_weekend", "season")
CAUSE_PLAIN = sorted({n for names in C.CAUSE_INPUTS.values() for n in names} - {"anomaly"})


def cause_frame(t, found):
    return cause.cause_frame(found.withColumns({n: F.lit(x) for n, x in (("latitude", 52.1), ("longitude", 5.2))}), v.weather(t))


@query("cause_inputs", f"""
    WITH c AS ({CURTAILED}), o AS (SELECT c.asset_id, c.timestamp, c.timestamp AS ts, asset_type, diagnostic_category, actual_mw AS generation_mw, 52.1 AS lat, 5.2 AS lon,
        {', '.join(f'w.{c}' for c in GEN_WEATHER)} FROM c LEFT JOIN weather w ON c.asset_id = w.asset_id AND c.timestamp = w.timestamp),
    {SUN}, fr AS (SELECT asset_id, timestamp, asset_type, diagnostic_category, {CLOCK}, degrees(el) AS solar_elevation_deg, greatest(0.0, sin(el)) AS cos_solar_zenith, {GEN_LAGS}, {GEN_ROLLS},
        {', '.join(GEN_WEATHER)}, {_guard('avg', 'wind_speed_10m', 4, 2)} AS wind_speed_roll_mean_4, {_guard('avg', 'wind_speed_10m', 96, 48)} AS wind_speed_roll_mean_96 FROM z),
    derived AS (SELECT *, CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month IN (3, 4, 5) THEN 1 WHEN month IN (6, 7, 8) THEN 2 ELSE 3 END AS season, wind_speed_10m ** 3 AS wind_speed_cubed,
        sin(radians(wind_direction_10m)) AS wind_dir_sin, cos(radians(wind_direction_10m)) AS wind_dir_cos, surface_pressure / (temperature_2m + 273.15) AS air_density_proxy FROM fr)
    SELECT asset_id, timestamp, asset_type, {', '.join(CAUSE_PLAIN)} FROM derived""", [n for n in CAUSE_PLAIN if n not in CLOCK_NAMES])
def cause_inputs(t):
    """Every input of the cause models of both types but the anomaly flag, for all rows."""
    return cause_frame(t, g.apply_curtailment(flagged(t), "curtailed")).select("asset_id", "timestamp", "asset_type", *CAUSE_PLAIN)


@query("cause_report", f"""
    WITH c AS ({CURTAILED}), f AS (SELECT * FROM c WHERE percentage_deviation IS NOT NULL AND expected_mw > {C.CAUSE_MIN_EXPECTED_MW}),
    n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS pos, count(*) OVER (PARTITION BY asset_id) AS n FROM f),
    p AS (SELECT *, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM n),
    a AS (SELECT asset_type, count(*) AS rows, count(CASE WHEN split = 'train' THEN 1 END) AS train_rows, count(CASE WHEN split = 'validation' THEN 1 END) AS validation_rows,
        count(CASE WHEN split = 'test' THEN 1 END) AS test_rows, count(DISTINCT CASE WHEN split = 'train' THEN diagnostic_category END) AS k,
        string_agg(DISTINCT CASE WHEN split = 'train' THEN diagnostic_category END, ',' ORDER BY CASE WHEN split = 'train' THEN diagnostic_category END) AS categories FROM p GROUP BY 1)
    SELECT t.asset_type, rows, train_rows, validation_rows, test_rows, categories, CASE t.asset_type WHEN 'solar' THEN 24 + k WHEN 'wind' THEN 30 + k END AS inputs,
        CASE WHEN t.asset_type = 'hydro' THEN 'unsupported asset type' END AS skipped FROM (SELECT DISTINCT asset_type FROM c) t JOIN a ON t.asset_type = a.asset_type""")
def cause_report(t):
    """What the cause model of each asset type would learn, or why there is none."""
    rows = g.apply_curtailment(flagged(t), "curtailed")
    return cause.cause_report(rows, cause.cause_rows(rows)).withColumn("categories", F.array_join("categories", ","))


def found_anomalies(t):
    """The anomaly scan of all diagnosed rows; they are used twice, as inputs of the forests and beside the scores."""
    return anomaly.detect_anomalies(cut_lineage(g.apply_curtailment(flagged(t), "curtailed")))


def deviation_models(t, found=None):
    found = found if found is not None else found_anomalies(t)
    fitted, placed, _ = cause.cause_fits(cut_lineage(cause_frame(t, found)))
    return fitted, placed


@query("deviation_fit")
def deviation_fit(t):
    fitted, frame = deviation_models(t)
    parts = []
    for kind, model in fitted.items():
        rest = frame.where((F.col("asset_type") == kind) & (F.col("split") != "train"))
        parts.append(m.forecast_metrics(model.predict(rest, "predicted"), ["asset_type", "split"], "percentage_deviation", "predicted"))
    return parts[0].unionByName(parts[1])


@query("contributions")
def contribution_rows(t):
    """Mean absolute contribution of each feature on all rows with a finite deviation."""
    fitted, frame = deviation_models(t)
    parts = []
    for kind, model in fitted.items():
        tall = model.contributions(frame.where(F.col("asset_type") == kind))
        parts.append(tall.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.count(F.lit(1)).alias("rows")).withColumn("asset_type", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("renewable_status")
def renewable_status(t):
    """Performance, diagnosis, curtailment, forest and cause for all assets in one plan, anomalies only."""
    found = cut_lineage(found_anomalies(t))
    fitted, frame = deviation_models(t, found)
    found = cut_lineage(g.full_blocks(found).where("full_block").drop("block_start", "full_block"))
    keys = ["asset_id", "timestamp"]
    anomalous = found.where("anomaly")
    tall = None
    for kind, model in fitted.items():
        rows = frame.join(anomalous.where(F.col("asset_type") == kind).select(*keys), keys, "left_semi")
        part = model.contributions(rows, keys)
        tall = part if tall is None else tall.unionByName(part)
    explained = g.cause_category(anomalous, tall)
    return explained.select(status_struct(cause=True).alias("s"), "diagnostic_category").select("s.*", "diagnostic_category")


@query("full_blocks", f"""
    WITH o AS (SELECT asset_id, timestamp, date_trunc('day', timestamp) - INTERVAL '1 day' * (CASE WHEN day(timestamp) % 2 = 0 THEN 1 ELSE 0 END) AS own FROM perf WHERE hour(timestamp) = 3),
    m AS (SELECT asset_id, timestamp, own AS block_start, true AS mine FROM o UNION ALL
        SELECT asset_id, timestamp, own - INTERVAL '1 day', false FROM o WHERE day(own) = 1 AND day(own - INTERVAL '1 day') % 2 = 1 AND timestamp < own + INTERVAL '1 day'),
    c AS (SELECT asset_id, block_start, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT m.asset_id, timestamp, m.block_start::TIMESTAMP AS block_start, n >= {C.MIN_BLOCK_ROWS} AS full_block FROM m JOIN c ON m.asset_id = c.asset_id AND m.block_start = c.block_start WHERE mine""")
def full_blocks(t):
    """The rows of one hour of the night, so that some blocks are too small to be analysed."""
    rows = v.perf(t).select("asset_id", "timestamp").where(F.hour("timestamp") == 3)
    return g.full_blocks(rows)


REREAD = ", ".join(f"CASE WHEN count(*) > 0 THEN 0.0 END AS off_{h}" for h in C.HORIZONS_MINUTES)


@query("model_artifacts", f"""
    WITH f AS ({DEMAND_FRAME_SQL}) SELECT count(*) AS rows, {REREAD} FROM f JOIN splits s ON f.asset_id = s.asset_id AND f.timestamp = s.timestamp
    WHERE s.split = 'test' AND {" AND ".join(f"{c} IS NOT NULL" for c in (*LAG_NAMES, *ROLL_NAMES))}""", [f"off_{h}" for h in C.HORIZONS_MINUTES])
def model_artifacts(t):
    """Save the horizon boosters with their metadata, load them again, and compare predictions."""
    fitted, test = demand_models(t)
    rows = [(h, len(fitted.names), float(e)) for h, e in fitted.rmse.items()]
    metadata = t.spark.createDataFrame(rows, "horizon_minutes int, features int, validation_rmse double")
    folder = boosted.save_models({f"h{h}": x for h, x in fitted.models.items()}, fitted.medians, work_folder(t.spark, "models"), metadata)
    again = boosted.DemandModels(
        {h: boosted.load_regressor(folder, f"h{h}") for h in fitted.models}, t.spark.read.parquet(f"{folder}/medians"), fitted.names, fitted.rmse
    )
    both = fitted.predict(test).select("asset_id", "timestamp", *[F.col(f"predicted_{h}").alias(f"a{h}") for h in fitted.models]).join(
        again.predict(test).select("asset_id", "timestamp", *[F.col(f"predicted_{h}").alias(f"b{h}") for h in fitted.models]), ["asset_id", "timestamp"]
    )
    off = both.agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.abs(F.col(f"a{h}") - F.col(f"b{h}"))).alias(f"off_{h}") for h in fitted.models])
    return off


REGISTRY_ROUNDS = 4  # the query is about which version serves a row


@query("model_versions", """
    WITH b AS (SELECT CAST(epoch(min(timestamp)) AS BIGINT) AS a, CAST(epoch(max(timestamp)) AS BIGINT) AS z, min(asset_id) AS first FROM hourly),
    x AS (SELECT asset_id, energy_type, asset_id = first AS own, epoch(timestamp) >= a + (z - a) // 4 AS v1, epoch(timestamp) >= a + (z - a) // 2 AS v2 FROM hourly, b)
    SELECT asset_id, CASE WHEN v1 THEN CASE WHEN own THEN asset_id ELSE energy_type END END AS model_key, CASE WHEN v1 THEN CASE WHEN v2 AND NOT own THEN 'v2' ELSE 'v1' END END AS model_version,
        count(*) AS rows, count(CASE WHEN v1 THEN 1 END) AS scored, CASE WHEN bool_or(v1) THEN 0.0 END AS off
    FROM x GROUP BY 1, 2, 3""", ["off"])
def model_versions(t):
    """Per asset, the model that serves its hours: two versions for each pool, one for the first asset alone, one that was staged and never published.

    `off` is the largest difference between the scores of loaded models and of those in memory.
    """
    frame = cut_lineage(f.hourly_feature_frame(v.hourly(t)))
    ends = frame.agg(F.min(epoch("timestamp")), F.max(epoch("timestamp")), F.min("asset_id")).first()
    stamp = lambda quarters: datetime.fromtimestamp(ends[0] + (ends[1] - ends[0]) * quarters // 4, timezone.utc)
    known = lambda of, end: frame.where(of & (F.col("timestamp") < F.lit(end)) & F.col("actual_mw").isNotNull())
    fit = lambda of, end: lambda: boosted.pooled_fit(known(of, end), f.HOURLY_FEATURES, "actual_mw", REGISTRY_ROUNDS, patience=1)
    pool = lambda kind: F.col("energy_type") == kind
    wanted = {(kind, f"v{q}"): fit(pool(kind), stamp(q)) for kind in ("solar", "wind") for q in (1, 2)} | {(ends[2], "v1"): fit(F.col("asset_id") == ends[2], stamp(1))}
    fitted = boosted.fit_together(wanted)
    root = work_folder(t.spark, "registry")
    for q in (1, 2):
        batch = {("generation", key): model for (key, version), model in fitted.items() if version == f"v{q}"}
        store.publish(t.spark, store.stage(root, batch, f"v{q}", stamp(q)))
    store.stage(root, {("generation", kind): fitted[kind, "v1"] for kind in ("solar", "wind")}, "v3", stamp(3))
    published = store.manifest(t.spark, root)
    keys = ["asset_id", "timestamp", "model_key", "model_version"]
    scored = cut_lineage(store.predict_at_time(frame, published, "generation", "predicted"))
    memory = None
    for (key, version), model in fitted.items():
        rows = scored.where((F.col("model_key") == key) & (F.col("model_version") == version)).drop("predicted")
        part = model.predict(rows, "memory").select(*keys, "memory")
        memory = part if memory is None else memory.unionByName(part)
    both = scored.select(*keys, "predicted").join(memory.select("asset_id", "timestamp", "memory"), ["asset_id", "timestamp"], "left")
    return both.groupBy("asset_id", "model_key", "model_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count("predicted").alias("scored"), F.max(F.abs(F.col("predicted") - F.col("memory"))).alias("off")
    )


_HOURLY_READY = ", ".join([*[f"lag(actual_mw, {k}) OVER w AS lag_{k}" for k in C.HOURLY_LAGS], *[f"count(actual_mw) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} AS full_{n}" for n in C.HOURLY_WINDOWS]])
_HOURLY_COMPLETE = " AND ".join([*[f"lag_{k} IS NOT NULL" for k in C.HOURLY_LAGS], *[f"full_{n}" for n in C.HOURLY_WINDOWS]])


@query("hourly_status", f"""
    WITH p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY asset_id) AS n, {_HOURLY_READY} FROM hourly WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
    e AS (SELECT *, {_HOURLY_COMPLETE} AS eligible, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN CAST(floor((pos - 1) * {C.HOURLY_FOLDS} / floor(n * 0.8::DOUBLE)) AS BIGINT) ELSE {C.HOURLY_FOLDS} END AS fold FROM p),
    k AS (SELECT energy_type, min(CASE WHEN eligible THEN fold END) AS oldest FROM e GROUP BY 1),
    x AS (SELECT e.*, eligible AND fold > oldest AS forecast FROM e JOIN k USING (energy_type)),
    a AS (SELECT asset_id, timestamp, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS place, count(*) OVER (PARTITION BY asset_id) AS size FROM x WHERE forecast AND actual_mw IS NOT NULL)
    SELECT x.asset_id, energy_type, count(*) AS rows, count(CASE WHEN forecast THEN 1 END) AS expected_rows,
        count(CASE WHEN size >= 30 AND place > floor(size * 0.8::DOUBLE) THEN 1 END) AS evaluated_rows, 0 AS unexplained_categories, 0 AS negative_expectations
    FROM x LEFT JOIN a ON x.asset_id = a.asset_id AND x.timestamp = a.timestamp GROUP BY 1, 2""")
def hourly_status(t):
    """The whole chain over all hours; per series: hours, those with an expectation, those evaluated, and those that break a rule of the status."""
    status = hourly.hourly_status(v.hourly(t))
    known = F.col("root_cause") != hourly.NO_EVIDENCE
    return status.groupBy("asset_id", "energy_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("expected_mw").alias("expected_rows"), F.count("anomaly_flag").alias("evaluated_rows"),
        F.count_if(known & ~F.coalesce("anomaly_flag", F.lit(False))).alias("unexplained_categories"), F.count_if(F.col("expected_mw") < 0).alias("negative_expectations"),
    )
