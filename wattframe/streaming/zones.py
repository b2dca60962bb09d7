"""Quarter-hour zone totals, emitted once a window can no longer change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.scalar import stress_severity
from wattframe.streaming.ingest import LATENESS

WINDOW = "15 minutes"


def zone_windows(rows: DataFrame, capacity_mw: float, event_time: str = "event_time") -> DataFrame:
    """Totals and stress per zone and window. Works on a table and on a stream.

    Needs zone_id, asset_type, actual_mw, demand_mw.
    """
    by = lambda kind: F.coalesce(F.sum(F.when(F.col("asset_type") == kind, F.col("actual_mw"))), F.lit(0.0))
    totals = rows.groupBy(F.window(event_time, WINDOW), "zone_id").agg(
        by("solar").alias("solar_mw"), by("wind").alias("wind_mw"), F.sum("demand_mw").alias("demand_mw"), F.count(F.lit(1)).alias("row_count")
    )
    net = F.greatest(F.lit(0.0), F.col("demand_mw") - F.col("solar_mw") - F.col("wind_mw"))
    stress = F.least(F.lit(1.0), net / capacity_mw)
    return totals.select(
        "zone_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "solar_mw", "wind_mw", "demand_mw", "row_count",
        stress.alias("stress_index"), stress_severity(stress).alias("severity"),
    )


def stream_snapshot(rows: DataFrame, capacity_mw: float, event_time: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    return zone_windows(rows.withWatermark(event_time, lateness), capacity_mw, event_time)
