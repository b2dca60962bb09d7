"""Past-only features over series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.calendar import clock_columns, cyclic_columns, wave, with_calendar
from wattframe.functions.physics import solar_position, wind_columns
from wattframe.functions.scalar import at_least, generation_mw, load_growth
from wattframe.operators.joins import interp_join, weather_left
from wattframe.operators.series import ASSET, TS, Running, dedup, row_windows, running, time_windows


def guarded(stat: Column, value: str, frame: WindowSpec, needed: int) -> Column:
    """A rolling statistic that is null until `needed` values are present."""
    return F.when(F.count(value).over(frame) >= needed, stat.over(frame))


def lag_columns(value: str, w: WindowSpec, minutes: Sequence[int] = C.LAG_MINUTES, step: int = 15) -> list[Column]:
    return [F.lag(value, m // step).over(w).alias(f"{value}_lag_{m}m") for m in minutes]


STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling_columns(value: str, w: WindowSpec, windows: Sequence[int] = C.ROLLING_WINDOWS, stats: Sequence[str] = C.ROLLING_STATS) -> list[Column]:
    """Statistics of the rows before the current one; null unless the window is full."""
    return [
        guarded(STATS[s](value), value, w.rowsBetween(-n, -1), n).alias(f"{value}_roll_{s}_{n}") for n in windows for s in stats
    ]


def momentum_columns(value: str) -> list[Column]:
    base = F.col(f"{value}_lag_15m")
    return [
        (base - F.col(f"{value}_lag_30m")).alias(f"{value}_diff_15m"), (base - F.col(f"{value}_lag_60m")).alias(f"{value}_diff_1h")
    ]


def lags(df: DataFrame, value: str = "demand_mw", keys: Sequence[str] = ASSET, ts: str = TS, by: str = "rows") -> DataFrame:
    """Lags by row, as published, or by time where gaps must not shift meaning."""
    if by == "rows":
        return row_windows(df, lambda w: lag_columns(value, w), before=max(C.LAG_MINUTES) // 15, keys=keys, order=ts)

    def build(w: WindowSpec) -> list[Column]:
        return [F.first(value).over(w.rangeBetween(-m * 60, -m * 60)).alias(f"{value}_lag_{m}m") for m in C.LAG_MINUTES]

    return time_windows(df, build, before_seconds=max(C.LAG_MINUTES) * 60, keys=keys, order=ts)


def past_rolling(df: DataFrame, value: str = "demand_mw", windows: Sequence[int] = C.ROLLING_WINDOWS) -> DataFrame:
    return row_windows(df, lambda w: rolling_columns(value, w, windows), before=max(windows))


def demand_features(df: DataFrame, value: str = "demand_mw", windows: Sequence[int] = C.ROLLING_WINDOWS) -> DataFrame:
    """Lags, rolling statistics and momentum from one chunked pass."""
    reach = max(max(C.LAG_MINUTES) // 15, max(windows))
    rows = row_windows(df, lambda w: [*lag_columns(value, w), *rolling_columns(value, w, windows)], before=reach)
    return rows.select("*", *momentum_columns(value))


def demand_feature_names(value: str = "demand_mw") -> list[str]:
    """The fixed order of the model inputs."""
    return [
        *C.WEATHER_INPUTS, *[f"{value}_lag_{m}m" for m in C.LAG_MINUTES],
        *[f"{value}_roll_{s}_{n}" for n in C.ROLLING_WINDOWS for s in C.ROLLING_STATS],
        f"{value}_diff_15m", f"{value}_diff_1h", *C.CALENDAR_FEATURES,
    ]


def demand_feature_frame(df: DataFrame, weather: DataFrame | None = None, value: str = "demand_mw") -> DataFrame:
    """Model inputs in order; a weather column nobody supplies is 0.0, values stay null where unknown."""
    rows = with_calendar(demand_features(df, value))
    if weather is not None:
        rows = weather_left(rows, weather)
    names = demand_feature_names(value)
    for missing in [n for n in names if n not in rows.columns]:
        rows = rows.withColumn(missing, F.lit(0.0))
    return rows.select("asset_id", TS, value, *names)


def feature_metadata(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [(i, n, "calendar" if n in C.CALENDAR_FEATURES else "weather" if n in C.WEATHER_INPUTS else "history") for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature_order int, feature string, source string")


def peak_column(value: str, w: WindowSpec, rows: int = C.DAY_STEPS, needed: int = 4) -> Column:
    return guarded(F.max(value), value, w.rowsBetween(-rows, -1), needed)


def peak_24h(df: DataFrame, value: str = "demand_mw", backfill: bool = False) -> DataFrame:
    """Largest of the prior 96 rows, at least four of them.

    `backfill` repeats the first known peak before it exists. That looks ahead,
    so it is off by default.
    """
    rows = row_windows(df, lambda w: [peak_column(value, w).alias("historical_peak_24h")], before=C.DAY_STEPS)
    if not backfill:
        return rows
    filled = running(rows, [Running("_next", "next", F.col("historical_peak_24h"))])
    return filled.withColumn("historical_peak_24h", F.col("_next")).drop("_next")


def spike_feature_frame(df: DataFrame, weather: DataFrame | None = None, forecast: str | None = None, value: str = "demand_mw") -> DataFrame:
    """The 14 spike inputs. Where there is no forecast (column `forecast` of `df`) it is the previous value."""
    rows = row_windows(
        df, lambda w: [peak_column(value, w).alias("historical_peak_24h"), F.lag(value, 1).over(w).alias("_lag")], before=C.DAY_STEPS
    )
    rows = rows.withColumn("forecast_load", F.coalesce(at_least(forecast, 0.0), F.col("_lag")) if forecast else F.col("_lag"))
    if weather is not None:
        rows = weather_left(rows, weather)
    source = {
        "temp_c": "temperature_2m", "humidity": "relative_humidity_2m", "cloud_cover": "cloud_cover",
        "wind_speed": "wind_speed_10m", "solar_radiation": "shortwave_radiation",
    }
    known = {
        name: F.coalesce(F.col(column), F.lit(C.SPIKE_WEATHER_DEFAULTS[name])) if column in rows.columns
        else F.lit(C.SPIKE_WEATHER_DEFAULTS[name]) for name, column in source.items()
    }
    hour, day = F.hour(TS), F.weekday(TS)
    sine, cosine = wave(hour, 24.0)
    return rows.select(
        "asset_id", TS, F.col(value).alias("current_load"), "forecast_load",
        load_growth(value, "forecast_load").alias("load_growth_pct"), "historical_peak_24h",
        *[c.alias(n) for n, c in known.items()], hour.alias("hour"), sine.alias("hour_sin"), cosine.alias("hour_cos"),
        day.alias("day_of_week"), (day >= 5).cast("int").alias("is_weekend"),
    )


# --- generation -----------------------------------------------------------


def generation_history(value: str, w: WindowSpec, speed: str | None = None) -> list[Column]:
    out = [F.lag(value, k).over(w).alias(f"lag_{k}") for k in C.GENERATION_LAGS]
    short, long = w.rowsBetween(-4, -1), w.rowsBetween(-96, -1)
    out += [
        guarded(F.avg(value), value, short, 2).alias("roll_mean_4"), guarded(F.avg(value), value, long, 48).alias("roll_mean_96"),
        F.coalesce(guarded(F.stddev_samp(value), value, long, 48), F.lit(0.0)).alias("roll_std_96"),
    ]
    if speed:
        out += [
            guarded(F.avg(speed), speed, short, 2).alias("wind_speed_roll_mean_4"),
            guarded(F.avg(speed), speed, long, 48).alias("wind_speed_roll_mean_96"),
        ]
    return out


def gen_lags(df: DataFrame, value: str = "generation_mw", speed: str | None = None) -> DataFrame:
    return row_windows(df, lambda w: generation_history(value, w, speed), before=max(C.GENERATION_LAGS))


SOLAR_FEATURES = (
    "hour_of_day", "minute_of_day", "day_of_year", "month", "day_of_week", "is_weekend",
    "solar_elevation_deg", "solar_azimuth_deg", "cos_solar_zenith",
    "cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure",
    "lag_1", "lag_2", "lag_4", "lag_8", "lag_96", "lag_192", "lag_672", "roll_mean_4", "roll_mean_96", "roll_std_96",
)
WIND_FEATURES = (
    "hour_of_day", "minute_of_day", "day_of_year", "month", "day_of_week", "is_weekend", "season",
    "wind_speed_10m", "wind_speed_cubed", "wind_dir_sin", "wind_dir_cos", "temperature_2m", "surface_pressure", "air_density_proxy",
    "lag_1", "lag_2", "lag_4", "lag_8", "lag_96", "lag_192", "lag_672", "roll_mean_4", "roll_mean_96", "roll_std_96",
    "wind_speed_roll_mean_4", "wind_speed_roll_mean_96",
)


def generation_feature_frame(
    load: DataFrame, weather: DataFrame, energy_type: str, latitude: str = "latitude", longitude: str = "longitude", keep_warmup: bool = False
) -> DataFrame:
    """Solar or wind model inputs; rows still in warm-up are dropped. Stamps unique per asset."""
    rows = load.withColumn("generation_mw", generation_mw("load"))
    if energy_type == "solar":
        measures = [c for c in ("cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure") if c in weather.columns]
        rows = rows.select("*", *clock_columns(TS), *solar_position(TS, latitude, longitude))
        names, speed = SOLAR_FEATURES, None
    else:
        measures = [
            c for c in ("cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m")
            if c in weather.columns
        ]
        if "wind_speed_10m" not in measures:
            raise ValueError("wind features need wind_speed_10m in the weather table")
        rows = rows.select("*", *clock_columns(TS, season=True))
        names, speed = WIND_FEATURES, "wind_speed_10m"
    rows = interp_join(rows, weather, measures)
    if energy_type == "wind":
        rows = rows.select("*", *wind_columns())
    rows = gen_lags(rows, "generation_mw", speed).select("asset_id", TS, "generation_mw", *names)
    return rows if keep_warmup else rows.na.drop(subset=list(names))


def hourly_feature_frame(df: DataFrame, value: str = "actual_mw", capacity: str = "capacity_mw") -> DataFrame:
    """Hourly lags, full-window means, cyclic calendar and capacity ratio."""
    def build(w: WindowSpec) -> list[Column]:
        out = [F.lag(value, k).over(w).alias(f"lag_{k}") for k in C.HOURLY_LAGS]
        return out + [guarded(F.avg(value), value, w.rowsBetween(-n, -1), n).alias(f"roll_mean_{n}") for n in C.HOURLY_WINDOWS]

    rows = row_windows(df, build, before=max(C.HOURLY_LAGS))
    cap = F.col(capacity)
    return rows.select(
        "*", *cyclic_columns(TS), F.when(cap > 0, F.col("lag_1") / cap).alias("lagged_generation_ratio"),
        F.coalesce(cap > 0, F.lit(False)).cast("double").alias("capacity_available"),
    )


HOURLY_FEATURES = (
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos",
    *[f"lag_{k}" for k in C.HOURLY_LAGS], *[f"roll_mean_{n}" for n in C.HOURLY_WINDOWS],
)


def rolling_ratio(df: DataFrame, hourly: bool = False, ratio: str = "performance_ratio") -> DataFrame:
    """Mean ratio of the last four rows, or of the 24 rows before an hourly row."""
    back, last = (24, -1) if hourly else (3, 0)
    return row_windows(df, lambda w: [F.avg(ratio).over(w.rowsBetween(-back, last)).alias("rolling_performance_ratio")], before=back)


def recent_ffill(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Newest row of each series with nulls filled from its last three rows, and what is still missing."""
    rows = row_windows(
        df, lambda w: [F.last(c, ignorenulls=True).over(w.rowsBetween(-2, 0)).alias(f"_f_{c}") for c in names], before=2, keys=keys, order=ts
    )
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(ts)).alias("_r")).select("_r.*")
    filled = newest.select(*[c for c in df.columns if c not in names], *[F.col(f"_f_{c}").alias(c) for c in names])
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))
    return filled.withColumn("missing_features", F.array_join(missing, ","))


def forecast_gate(df: DataFrame, names: Sequence[str], steps: int = C.DAY_STEPS, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """The newest row of each series, filled as by `recent_ffill`, with `history_rows` and the reason why no forecast can start from it, if any.

    Too short a history comes before inputs that stay unknown.
    """
    depth = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("history_rows"))
    newest = recent_ffill(df, names, keys, ts).join(depth, [*keys])
    error = F.when(F.col("history_rows") < steps, "INSUFFICIENT_HISTORY").when(F.col("missing_features") != "", "MISSING_FEATURE")
    return newest.withColumn("error_code", error)


def input_gate(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Columns that are absent, and null counts of those present, as a typed report."""
    absent = [n for n in names if n not in df.columns]
    present = [n for n in names if n in df.columns]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(n).isNull()).alias(f"_{n}") for n in present]
    )
    holes = F.array_compact(F.array(*[F.when(F.col(f"_{n}") > 0, F.concat(F.lit(f"{n}="), F.col(f"_{n}"))) for n in present]))
    error = F.when(F.lit(bool(absent)), "MISSING_COLUMNS").when(F.size(holes) > 0, "MISSING_FEATURE")
    return counted.select(
        *keys, "row_count", F.lit(",".join(absent)).alias("absent_columns"), F.array_join(holes, ",").alias("null_counts"), error.alias("error_code")
    )
