"""Unusual rows of expected-against-actual tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.calendar import cyclic_columns
from wattframe.functions.scalar import finite
from wattframe.models.forest import isolation_scores
from wattframe.models.impute import impute, impute_medians
from wattframe.operators.diagnose import anomaly_policy, data_quality_row, in_blocks, performance_capacity, suppressed_row
from wattframe.operators.features import rolling_ratio
from wattframe.operators.splits import holdout_split
from wattframe.session import cut_lineage

BLOCK_FEATURES = (
    "actual_mw", "expected_mw", "absolute_deviation", "percentage_deviation", "performance_ratio", "rolling_performance_ratio",
    "solar_cloud_cover", "wind_speed",
)
HOURLY_FEATURES = (
    "actual_mw", "expected_mw", "absolute_deviation_mw", "absolute_error_mw", "percentage_deviation", "performance_ratio",
    "generation_capacity_ratio", "expected_capacity_ratio", "rolling_performance_ratio", "hour_sin", "hour_cos",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
)


def block_features(diagnosed: DataFrame) -> DataFrame:
    """Inputs of the 15-minute forest; weather only where it acts on the asset type."""
    rows = diagnosed.select(*[c for c in diagnosed.columns if c != "performance_ratio"], finite("performance_ratio").alias("performance_ratio"))
    rows = rolling_ratio(rows)
    kind = F.col("asset_type")
    cloud = F.when(kind == "solar", F.col("cloud_cover")) if "cloud_cover" in rows.columns else F.lit(None).cast("double")
    wind = next((c for c in ("wind_speed_10m", "wind_speed") if c in rows.columns), None)
    speed = F.when(kind == "wind", F.col(wind)) if wind else F.lit(None).cast("double")
    return rows.withColumn("solar_cloud_cover", cloud).withColumn("wind_speed", speed)


def detect_anomalies(
    diagnosed: DataFrame, contamination: float = C.FOREST_CONTAMINATION, suppress: bool = True, trees: int = C.FOREST_TREES
) -> DataFrame:
    """Score each 48-hour block of each asset and apply the operating rules.

    Rows that feed two blocks are reported from their own.
    """
    rows = block_features(diagnosed)
    rows = rows.withColumn("fit", ~(F.coalesce(data_quality_row(), F.lit(True)) | suppressed_row(suppress)))
    rows = in_blocks(rows).withColumn("_model", F.concat_ws("|", "asset_id", F.col("block_start").cast("string")))
    keys = ["asset_id", "timestamp"]
    slim = cut_lineage(rows.select("_model", *keys, "fit", "own_block", *BLOCK_FEATURES))
    filled = impute(slim, impute_medians(slim.where("fit"), list(BLOCK_FEATURES), ["_model"]), list(BLOCK_FEATURES), ["_model"])
    scored = isolation_scores(filled, list(BLOCK_FEATURES), "_model", keys, trees=trees, contamination=contamination, keep=[*keys, "fit", "own_block"])
    own = scored.where("own_block").select(*keys, F.when(F.col("fit"), F.col("anomaly_score")).alias("anomaly_score"))
    return anomaly_policy(diagnosed.join(own, keys, "left"), suppress=suppress)


def hourly_anomalies(performance_rows: DataFrame, contamination: float = C.FOREST_CONTAMINATION, trees: int = C.FOREST_TREES, min_rows: int = 30) -> DataFrame:
    """Per-series forest fitted on the first 80 percent of valid rows, reported on the rest.

    Rows outside the evaluation part carry a null flag. Scores come from batch
    features, so the rolling ratio is real for every row.
    """
    rows = performance_capacity(performance_rows)
    valid = rows.where(F.col("actual_mw").isNotNull() & F.col("expected_mw").isNotNull())
    placed = holdout_split(valid)
    featured = rolling_ratio(placed, hourly=True).where(F.col("_n") >= min_rows).withColumn("fit", F.col("split") == "train")
    # Day-of-year waves are not among the inputs.
    slim = cut_lineage(featured.select("*", *cyclic_columns("timestamp", year_days=False)).select("asset_id", "timestamp", "energy_type", "fit", *HOURLY_FEATURES))
    names = list(HOURLY_FEATURES)
    filled = impute(slim, impute_medians(slim.where("fit"), names, ["asset_id"]), names, ["asset_id"])
    scored = isolation_scores(filled, names, "asset_id", ["timestamp"], trees=trees, contamination=contamination, keep=["asset_id", "energy_type", "timestamp", "fit"])
    flag = F.when(~F.col("fit"), F.col("anomaly_score") < 0)
    return scored.select("asset_id", "energy_type", "timestamp", "fit", "anomaly_score", flag.alias("anomaly_flag"))
