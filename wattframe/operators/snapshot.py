"""Zone totals, the zone snapshot, contract rows and the text audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.scalar import finite, stress_severity
from wattframe.functions.text import claim_amounts, claim_texts


def zone_totals(statuses: DataFrame, keys: Sequence[str] = ("zone_id", "timestamp")) -> DataFrame:
    """Solar and wind actuals, expectation of all types, anomalies and assets per zone and stamp."""
    by = lambda kind: F.coalesce(F.sum(F.when(F.col("asset_type") == kind, F.col("actual_mw"))), F.lit(0.0))
    return statuses.groupBy(*keys).agg(
        by("solar").alias("solar_mw"), by("wind").alias("wind_mw"), F.sum("expected_mw").alias("expected_mw"),
        F.count_if("anomaly").alias("anomaly_count"), F.count(F.lit(1)).alias("asset_count"),
    ).withColumn("renewable_mw", F.col("solar_mw") + F.col("wind_mw"))


def zone_anomalies(statuses: DataFrame) -> DataFrame:
    """The anomalous assets, one row each, as listed in a snapshot."""
    return statuses.where("anomaly").select("zone_id", "timestamp", "asset_id", "asset_type", "expected_mw", "actual_mw")


def latest_per_asset(df: DataFrame, value: str, keys: Sequence[str] = ("asset_id",), ts: str = "timestamp") -> DataFrame:
    """Newest value per asset, null unless it is above zero."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts), F.max_by(value, F.col(ts)).alias(value))
    return newest.withColumn(value, F.when(F.col(value) > 0, F.col(value)))


def newest_row(df: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r")).select(*keys, "_r.*")


def grid_snapshot(zones: DataFrame, state: DataFrame | None, forecast: DataFrame | None, totals: DataFrame | None, dispatch: DataFrame | None) -> DataFrame:
    """One record per zone. A missing input gives an unavailable section and is listed.

    Each input has one row per zone at most: state (demand_mw, stress_index,
    frequency_hz, curtailment_mw, soc_percent), forecast (h15, h30, h60, spike_level), totals
    (see `zone_totals`), dispatch (mitigated_mw).
    """
    rows = zones.select("zone_id").distinct()
    fields = {
        "state": ("demand_mw", "stress_index", "frequency_hz", "curtailment_mw", "soc_percent"),
        "forecast": ("h15", "h30", "h60", "spike_level"),
        "totals": ("solar_mw", "wind_mw", "renewable_mw", "anomaly_count", "asset_count"), "dispatch": ("mitigated_mw",),
    }
    given = {"state": state, "forecast": forecast, "totals": totals, "dispatch": dispatch}
    for name, part in given.items():
        if part is None:
            for f in fields[name]:
                rows = rows.withColumn(f, F.lit(None))
            rows = rows.withColumn(f"_has_{name}", F.lit(False))
        else:
            marked = part.select("zone_id", *fields[name]).withColumn(f"_has_{name}", F.lit(True))
            rows = rows.join(marked, "zone_id", "left").withColumn(f"_has_{name}", F.coalesce(f"_has_{name}", F.lit(False)))
    status = lambda name: F.when(F.col(f"_has_{name}"), "available").otherwise("unavailable")
    absent = F.array_compact(F.array(
        F.when(~F.col("_has_state"), "data_telemetry"), F.when(~F.col("_has_forecast"), "forecasting"),
        F.when(~F.col("_has_totals"), "renewable"), F.when(~F.col("_has_dispatch"), "optimization"),
    ))
    return rows.select(
        "zone_id",
        F.struct(status("state").alias("status"), F.col("demand_mw").alias("value_mw")).alias("current_demand"),
        F.struct(status("forecast").alias("status"), "h15", F.coalesce("h30", "h15").alias("h30"), "h60", "spike_level").alias("forecast_demand"),
        F.struct(status("totals").alias("status"), "solar_mw", "wind_mw", F.col("renewable_mw").alias("total_mw"), "asset_count").alias("renewable_generation"),
        F.struct(status("totals").alias("status"), F.col("anomaly_count").alias("count")).alias("renewable_anomalies"),
        F.struct(status("state").alias("status"), "soc_percent").alias("available_flexible_resources"),
        F.struct(status("state").alias("status"), "curtailment_mw", F.when(F.col("_has_state"), F.coalesce("mitigated_mw", F.lit(0.0))).alias("mitigated_mw")).alias("curtailment"),
        F.struct(status("state").alias("status"), "stress_index", "frequency_hz", stress_severity("stress_index").alias("severity")).alias("grid_stress"),
        F.struct((F.size(absent) > 0).alias("is_degraded"), absent.alias("unavailable_dependencies")).alias("system_health"),
    )


def status_struct(cause: bool = False) -> Column:
    """Row to contract fields: ISO stamp, a ratio that cannot be computed stays null.

    An anomaly score outside 0..1 is not a probability and is left out.
    """
    fields = [
        F.col("asset_id").alias("assetId"), F.col("asset_type").alias("assetType"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("timestamp"), F.col("expected_mw").alias("expectedMw"),
        F.col("actual_mw").alias("actualMw"), finite("performance_ratio").alias("performanceRatio"), F.col("anomaly").alias("anomaly"),
    ]
    if cause:
        known = F.col("cause_confidence").between(0.0, 1.0) & F.col("cause_category").isNotNull() & (F.col("cause_category") != "uncertain")
        fields.append(F.when(known & (F.col("cause_confidence") > 0), F.struct(
            F.col("cause_category").alias("category"), F.col("cause_confidence").alias("confidence")
        )).alias("likelyRootCause"))
    return F.struct(*fields)


def probability_or_null(score: str) -> Column:
    return F.when(finite(score).between(0.0, 1.0), F.col(score))


def net_load_trend(points: DataFrame) -> DataFrame:
    """Net load and half band width per forecast point. Needs demand, bounds, renewable_mw."""
    lower, upper = F.coalesce("lower_bound_mw", "demand_mw"), F.coalesce("upper_bound_mw", "demand_mw")
    return points.withColumn(
        "net_load_mw", F.greatest(F.lit(0.0), F.col("demand_mw") - F.coalesce("renewable_mw", F.lit(0.0)))
    ).withColumn("half_band_mw", (upper - lower) / 2)


def dispatch_text_audit(texts: DataFrame, runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Dispatch claims in texts that no solver action backs.

    texts (text_id, run_id, text), runs (run_id, status), actions (run_id,
    power_mw). A claim is a violation when its text has no run, the run is
    infeasible, or no action of the run has its power to one decimal.
    """
    found = texts.select("text_id", "run_id", claim_texts("text").alias("claim"), claim_amounts("text").alias("amount"))
    claims = found.select("text_id", "run_id", F.posexplode(F.arrays_zip("claim", "amount")).alias("claim_no", "_c")).select(
        "text_id", "run_id", "claim_no", F.col("_c.claim").alias("claim"), F.round("_c.amount", 1).alias("power_mw")
    )
    known = runs.select("run_id", "status").distinct()
    allowed = actions.select("run_id", F.round("power_mw", 1).alias("power_mw")).distinct().withColumn("_ok", F.lit(True))
    # Texts without a run need no look-up; kept out of the joins, they cannot gather in one task.
    without = claims.where("run_id IS NULL").withColumn("violation", F.lit("no_run"))
    joined = claims.where("run_id IS NOT NULL").join(known, "run_id", "left").join(allowed, ["run_id", "power_mw"], "left")
    problem = (
        F.when(F.col("status").isNull(), "no_run").when(F.col("status") == "infeasible", "infeasible_run")
        .when(F.col("_ok").isNull() & (F.col("power_mw") > 0), "unverified_power")
    )
    return joined.withColumn("violation", problem).where(F.col("violation").isNotNull()).drop("_ok", "status").unionByName(without)
