"""Expected against actual generation, and what the difference says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import finite, first_true, flag_truth
from wattframe.operators.joins import one_per_stamp
from wattframe.operators.series import ASSET, POSITION, TS, Running, epoch, from_epoch, row_windows, running


def performance(df: DataFrame) -> DataFrame:
    """Deviation and ratio columns. Near zero on both sides is a nominal non-event."""
    expected, actual = F.col("expected_mw"), F.col("actual_mw")
    no_expected = expected < C.NEAR_ZERO_MW
    quiet = no_expected & (actual < C.NEAR_ZERO_MW)
    unknown = expected.isNull() | actual.isNull()
    return df.select(
        "*",
        (actual - expected).alias("absolute_deviation"),
        F.when(quiet, 0.0).when(~no_expected, (actual - expected) / expected * 100).alias("percentage_deviation"),
        F.when(quiet, 1.0).when(~no_expected, actual / expected).alias("performance_ratio"),
        F.when(unknown, F.lit(False)).otherwise(no_expected & (actual >= C.NEAR_ZERO_MW)).alias("zero_expected_edge_case"),
    )


def check_asset_types(df: DataFrame) -> DataFrame:
    """Fail on a blank asset or an asset type outside solar, wind and hydro."""
    bad = (F.length(F.trim("asset_id")) == 0) | ~F.col("asset_type").isin(*C.GENERATION_TYPES)
    problem = F.raise_error(F.concat(F.lit("bad asset or type: "), F.col("asset_id"), F.lit(" "), F.col("asset_type")))
    return df.withColumn("asset_type", F.when(bad, problem.cast("string")).otherwise(F.col("asset_type")))


def performance_capacity(df: DataFrame) -> DataFrame:
    """Hourly form with capacity ratios; nothing is divided by an expectation near zero."""
    expected, actual, capacity = F.col("expected_mw"), F.col("actual_mw"), F.col("capacity_mw")
    valid = F.coalesce(F.abs(expected) > C.NEAR_ZERO_HOURLY_MW, F.lit(False))
    return df.select(
        "*",
        (actual - expected).alias("absolute_deviation_mw"),
        F.abs(actual - expected).alias("absolute_error_mw"),
        F.when(valid, (actual - expected) / expected * 100).alias("percentage_deviation"),
        F.when(valid, actual / expected).alias("performance_ratio"),
        F.when(capacity > 0, actual / capacity).alias("generation_capacity_ratio"),
        F.when(capacity > 0, expected / capacity).alias("expected_capacity_ratio"),
        (~valid).alias("zero_or_missing_expected"),
    )


def weather_columns(df: DataFrame, weather: DataFrame, tie: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Left join of weather on the same stamp (and asset, if weather has one).

    Repeated weather rows keep the last by `tie` (the largest row without one), so the row count never grows.
    """
    keys = list(keys) if keys is not None else [c for c in ("asset_id",) if c in weather.columns]
    weather = one_per_stamp(weather, keys, TS, tie, "last")
    fresh = [c for c in weather.columns if c in {*keys, TS} or c not in df.columns]
    return df.join(weather.select(*fresh), [*keys, TS], "left")


def low_run(df: DataFrame, low: Column, name: str = "low_run", keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Length of the current run of `low` rows, whatever its length.

    The run is the distance to the last row that was not low, a running maximum.
    """
    rows = df.withColumn("_low", F.coalesce(low, F.lit(False)))
    rows = running(rows, [Running(POSITION, "position")], keys, ts)
    rows = running(rows, [Running("_break", "max", F.when(~F.col("_low"), F.col(POSITION)))], keys, ts)
    run = F.when(F.col("_low"), F.col(POSITION) - F.coalesce("_break", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn(name, run).drop("_low", "_break", POSITION)


def invalid_row() -> Column:
    ratio = finite("performance_ratio")
    return F.coalesce("zero_expected_edge_case", F.lit(False)) | ratio.isNull() | F.coalesce(F.col("actual_mw") < 0, F.lit(False))


def classify_deviation(df: DataFrame, weather: DataFrame | None = None, tie: str | None = None, keep_evidence: bool = False) -> DataFrame:
    """Category and confidence of each deviation; the first matching rule wins."""
    rows = weather_columns(df, weather, tie) if weather is not None else df
    ratio, kind = finite("performance_ratio"), F.col("asset_type")
    rows = rows.withColumn("_invalid", invalid_row()).withColumn(
        "_low_now", F.coalesce(ratio < C.LOW_RATIO, F.lit(False)) & ~F.col("_invalid")
    )
    # Only "at least four in a row" matters here, which a frame of four rows decides.
    n = C.PERSISTENT_LOW_ROWS
    rows = row_windows(
        rows, lambda w: [F.sum(F.col("_low_now").cast("int")).over(w.rowsBetween(1 - n, 0)).alias("_lows")], before=n - 1
    )
    cloudy = F.lit(False)
    if "cloud_cover" in rows.columns:
        cloudy = F.coalesce((kind == "solar") & (F.col("cloud_cover") >= C.HIGH_CLOUD_PERCENT), F.lit(False))
    wind = next((c for c in ("wind_speed_10m", "wind_speed") if c in rows.columns), None)
    calm = F.coalesce((kind == "wind") & (F.col(wind) <= C.CALM_WIND_MS), F.lit(False)) if wind else F.lit(False)
    explained = cloudy | calm
    cloud_confidence = F.col("cloud_cover") / 100 * 0.15 + 0.80 if "cloud_cover" in rows.columns else F.lit(0.80)
    low, invalid = F.col("_low_now"), F.col("_invalid")
    persistent = F.col("_lows") == n
    normal = ratio.between(*C.NORMAL_RATIO)
    category = first_true(
        (invalid, "data_quality_issue"), (persistent & ~explained, "possible_physical_fault"),
        (low & explained, "weather_driven_reduction"), (normal, "normal_production"), otherwise="uncertain",
    )
    confidence = first_true(
        (invalid, 0.98), (persistent & ~explained, 0.70), (low & calm, 0.90), (low & explained, cloud_confidence),
        (normal, 0.95), otherwise=0.25,
    )
    evidence = [c for c in rows.columns if c in ("cloud_cover", "wind_speed_10m", "wind_speed")] if keep_evidence else []
    kept = [c for c in df.columns] + [c for c in evidence if c not in df.columns]
    return rows.select(
        *kept, category.alias("diagnostic_category"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("diagnostic_confidence"),
    )


def apply_curtailment(df: DataFrame, flag: str | None, kind: str = "string") -> DataFrame:
    """An explicit curtailment flag overrides the rules; without the column nothing is inferred."""
    if not flag or flag not in df.columns:
        return df
    flagged = flag_truth(flag, kind)
    return df.withColumn(
        "diagnostic_category", F.when(flagged, "intentional_curtailment").otherwise(F.col("diagnostic_category"))
    ).withColumn("diagnostic_confidence", F.when(flagged, 0.98).otherwise(F.col("diagnostic_confidence")))


def data_quality_row() -> Column:
    return F.coalesce("zero_expected_edge_case", F.lit(False)) | (F.col("diagnostic_category") == "data_quality_issue")


def suppressed_row(suppress: bool = True) -> Column:
    return (F.col("diagnostic_category") == "intentional_curtailment") & F.lit(suppress)


def anomaly_policy(df: DataFrame, score: str = "anomaly_score", suppress: bool = True) -> DataFrame:
    """Turn scores (below zero is unusual) into flags under the operating rules."""
    quality, suppressed = data_quality_row(), suppressed_row(suppress)
    weather = F.col("diagnostic_category") == "weather_driven_reduction"
    flag = F.when(quality, True).when(suppressed | weather, False).otherwise(F.coalesce(F.col(score) < 0, F.lit(False)))
    kept = F.when(quality | suppressed, 0.0).otherwise(F.coalesce(F.col(score), F.lit(0.0)))
    return df.withColumn(score, kept).withColumn("anomaly", flag).withColumn(
        "anomaly_suppressed_reason", F.when(suppressed, "intentional_curtailment")
    )


def deviation_category(percentage: str = "percentage_deviation") -> Column:
    d = finite(percentage)
    return first_true(
        (d.isNull(), "insufficient evidence"), (F.abs(d) < C.NEGLIGIBLE_DEVIATION_PERCENT, "expected/normal temporal variation"),
        (d < 0, "unusually low generation relative to expected"), otherwise="unusually high generation relative to expected",
    )


def cause_table(df: DataFrame) -> DataFrame:
    """Feature to category, a fixed list."""
    return df.sparkSession.createDataFrame(list(C.CAUSE_CATEGORIES.items()), "feature string, category string")


def ranked_contributions(contributions: DataFrame, keys: Sequence[str] = (*ASSET, TS), top: int = 3) -> DataFrame:
    """The strongest features per row with the row's total magnitude.

    Input is tall: keys, feature, contribution; one row has a few dozen features.
    """
    size = F.abs("contribution")
    per_row = Window.partitionBy(*keys)
    ranked = contributions.withColumn("magnitude", F.sum(size).over(per_row)).withColumn(
        "rank", F.row_number().over(per_row.orderBy(size.desc(), F.col("feature")))
    )
    return ranked.where(F.col("rank") <= top)


def cause_category(rows: DataFrame, contributions: DataFrame, keys: Sequence[str] = (*ASSET, TS)) -> DataFrame:
    """Category and confidence from the strongest contribution of each row.

    A small deviation on a row that is not anomalous stays uncertain.
    """
    best = ranked_contributions(contributions, keys, 1).join(F.broadcast(cause_table(rows)), "feature", "left")
    joined = rows.join(best.select(*keys, "feature", "contribution", "magnitude", "category"), list(keys), "left")
    negligible = (F.abs("percentage_deviation") < C.NEGLIGIBLE_DEVIATION_PERCENT) & ~F.col("anomaly")
    unknown = F.coalesce(negligible, F.lit(False)) | F.col("feature").isNull()
    share = F.when(F.col("magnitude") == 0, 0.0).otherwise(F.abs("contribution") / F.col("magnitude"))
    return joined.withColumn(
        "cause_category", F.when(unknown, "uncertain").otherwise(F.coalesce("category", F.lit("other_factor")))
    ).withColumn("cause_confidence", F.when(unknown, 0.0).otherwise(F.least(F.lit(1.0), share))).drop(
        "category", "contribution", "magnitude"
    ).withColumnRenamed("feature", "top_feature")


def diag_block(ts: str | Column = TS) -> Column:
    """Start of the 48-hour block of a stamp: its day, or the day before on even days."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.floor(epoch(ts) / 86_400) * 86_400
    return from_epoch(day - F.when(F.dayofmonth(ts) % 2 == 0, 86_400).otherwise(0))


def in_blocks(df: DataFrame, ts: str = TS) -> DataFrame:
    """Rows with every block they feed: their own, and an earlier one still open.

    A block runs for two days. After a 31st the block that starts that day
    also covers the 1st, which starts its own; such rows feed both and are
    reported from their own (`own_block`).
    """
    own = diag_block(ts)
    previous = from_epoch(epoch(own) - 86_400)
    overlaps = (F.dayofmonth(own) == 1) & (F.dayofmonth(previous) % 2 == 1) & (epoch(ts) < epoch(own) + 86_400)
    blocks = F.array_compact(F.array(
        F.struct(own.alias("block_start"), F.lit(True).alias("own_block")),
        F.when(overlaps, F.struct(previous.alias("block_start"), F.lit(False).alias("own_block"))),
    ))
    return df.withColumn("_b", F.explode(blocks)).select(*df.columns, "_b.block_start", "_b.own_block")


def full_blocks(df: DataFrame, least: int = C.MIN_BLOCK_ROWS, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Add `block_start`, the row's own block, and `full_block`: whether at least `least` rows feed it; smaller blocks are not analysed."""
    members = in_blocks(df, ts)
    sizes = members.groupBy(*keys, "block_start").agg(F.count(F.lit(1)).alias("_rows"))
    own = members.where("own_block").drop("own_block")
    return own.join(sizes, [*keys, "block_start"]).select(*df.columns, "block_start", (F.col("_rows") >= least).alias("full_block"))
