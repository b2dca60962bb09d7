"""Chronological splits, leads, baselines and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import load_growth
from wattframe.operators.quantiles import exact_percentiles
from wattframe.operators.series import ASSET, POSITION, TOTAL, TS, Running, attach, positions, row_windows, running
from wattframe.session import cut_lineage


def cut_points(train: float, validation: float) -> tuple[Column, Column]:
    """Row counts at which train and validation end: int(n * share)."""
    n = F.col(TOTAL)
    return F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))


def chronological_split(
    df: DataFrame, train: float = 0.70, validation: float = 0.15, keys: Sequence[str] = ASSET, ts: str = TS
) -> DataFrame:
    """Label each row train, validation or test by its place in its series (adds `_pos`, `_n`)."""
    rows = df if POSITION in df.columns and TOTAL in df.columns else positions(df, keys, ts)
    first, second = cut_points(train, validation)
    label = F.when(F.col(POSITION) <= first, "train").when(F.col(POSITION) <= second, "validation").otherwise("test")
    return rows.withColumn("split", label)


def holdout_split(df: DataFrame, share: float = 0.80, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """One cut: the last rows validate."""
    rows = df if POSITION in df.columns and TOTAL in df.columns else positions(df, keys, ts)
    label = F.when(F.col(POSITION) <= F.floor(F.col(TOTAL) * F.lit(share)), "train").otherwise("validation")
    return rows.withColumn("split", label)


def split_bounds(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """First and last stamp and size of each split."""
    return df.groupBy(*keys, "split").agg(
        F.min(ts).alias("split_start"), F.max(ts).alias("split_end"), F.count(F.lit(1)).alias("rows")
    )


def lead_targets(
    df: DataFrame, value: str, steps: dict[str, int], keys: Sequence[str] = ASSET, ts: str = TS
) -> DataFrame:
    """Value `h` rows ahead, null where that row lies in a later split. Needs `split`."""
    def build(w):
        return [
            F.when(F.lead("split", h).over(w) == F.col("split"), F.lead(value, h).over(w)).alias(name)
            for name, h in steps.items()
        ]

    return row_windows(df, build, before=0, after=max(steps.values()), keys=keys, order=ts)


def baselines(
    df: DataFrame, value: str = "demand_mw", horizons: Sequence[int] = C.HORIZONS_MINUTES,
    season: int = C.DAY_STEPS, keys: Sequence[str] = ASSET, ts: str = TS, step_minutes: int = 15,
) -> DataFrame:
    """Persistence per horizon and the seasonal naive forecast for each row."""
    def build(w):
        out = [F.lag(value, h // step_minutes).over(w).alias(f"persistence_{h}") for h in horizons]
        return [*out, F.lag(value, season).over(w).alias("seasonal_naive")]

    return row_windows(df, build, before=max(season, max(horizons) // step_minutes), keys=keys, order=ts)


def stacked_baselines(df: DataFrame, value: str = "demand_mw", horizons: Sequence[int] = C.HORIZONS_MINUTES) -> DataFrame:
    """Rows (model, horizon, actual, predicted) from the columns of `baselines`."""
    rows = [
        F.struct(F.lit(model).alias("model"), F.lit(h).alias("horizon_minutes"), F.col(source).alias("predicted"))
        for h in horizons
        for model, source in (("persistence", f"persistence_{h}"), ("seasonal_naive", "seasonal_naive"))
    ]
    return df.withColumn("_m", F.explode(F.array(*rows))).select(
        *[c for c in df.columns if not c.startswith(("persistence_", "seasonal_naive"))],
        "_m.*", F.col(value).alias("actual"),
    )


# --- spikes ---------------------------------------------------------------


def with_growth(df: DataFrame, value: str = "demand_mw", keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Next value and growth in percent one step ahead."""
    ahead = running(df, [Running("next_mw", "lead", F.col(value))], keys, ts)
    return ahead.withColumn("growth_pct", load_growth(value, "next_mw"))


def spike_thresholds(train: DataFrame, value: str = "demand_mw", keys: Sequence[str] = ASSET) -> DataFrame:
    """Cut points of growth and of the MW change, with class counts. Input from `with_growth`.

    The rows are read three times (sketch, counts, classes), so they are materialised first.
    """
    moderate, severe = C.SPIKE_PERCENTILES
    train = cut_lineage(train.select(*keys, value, "next_mw", "growth_pct"))
    tall = train.select(*keys, F.explode(F.array(
        F.struct(F.lit("growth").alias("m"), F.col("growth_pct").alias("x")),
        F.struct(F.lit("delta").alias("m"), (F.col("next_mw") - F.col(value)).alias("x")),
    )).alias("_p")).select(*keys, "_p.m", "_p.x")
    cuts = exact_percentiles(tall, F.col("x"), {"moderate": moderate, "severe": severe}, [*keys, "m"])
    wide = cuts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("m") == m, F.col(c))).alias(name)
        for m, c, name in (
            ("growth", "moderate", "moderate_growth_pct"), ("growth", "severe", "severe_growth_pct"),
            ("delta", "moderate", "moderate_delta_mw"), ("delta", "severe", "severe_delta_mw"),
        )
    ])
    g = F.col("growth_pct")
    counted = attach(train.where(g.isNotNull()), wide, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(g < F.col("moderate_growth_pct")).alias("normal_rows"),
        F.count_if((g >= F.col("moderate_growth_pct")) & (g < F.col("severe_growth_pct"))).alias("moderate_rows"),
        F.count_if(g >= F.col("severe_growth_pct")).alias("severe_rows"),
    )
    return wide.join(counted, list(keys))


def spike_class(growth: Column, moderate: Column, severe: Column, null_class: int | None = 0) -> Column:
    """0 normal, 1 moderate, 2 severe; unknown growth is class 0 unless told otherwise."""
    known = F.when(growth >= severe, 2).when(growth >= moderate, 1).when(growth.isNotNull(), 0)
    return known if null_class is None else F.coalesce(known, F.lit(null_class))


def positive_growth_thresholds(df: DataFrame, value: str = "demand_mw", keys: Sequence[str] = ASSET) -> DataFrame:
    """90th and 99th percentile of positive step changes. Needs `prev_mw`."""
    change = (F.col(value) / F.nullif(F.col("prev_mw"), F.lit(0.0)) - 1) * 100
    return exact_percentiles(
        df.select(*keys, change.alias("x")).where(F.col("x") > 0), F.col("x"), {"moderate_pct": 0.90, "severe_pct": 0.99}, keys
    )


def exceed_targets(
    df: DataFrame, limits: DataFrame, steps: int, value: str = "load", keys: Sequence[str] = ASSET, ts: str = TS, sigmas: float = 2.5
) -> DataFrame:
    """Targets `steps` rows ahead: above the upper limit, above mean + 2.5 sd of its slot, below zero.

    `df` carries `split`; slot statistics come from the train split only, and
    there is one row per asset, minute of day and weekday.
    """
    slots = df.where(F.col("split") == "train").groupBy(*keys, _minute(ts), _day(ts)).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    )
    ahead = row_windows(
        df, lambda w: [F.lead(value, steps).over(w).alias("_next"), F.lead(ts, steps).over(w).alias("_next_ts")],
        before=0, after=steps, keys=keys, order=ts,
    ).select("*", _minute("_next_ts"), _day("_next_ts"))
    joined = attach(ahead.join(slots, [*keys, "_minute", "_day"], "left"), limits, keys)
    nxt = F.col("_next")
    return joined.select(
        *df.columns, (nxt > F.col("upper_limit")).alias("exceeds_limit"),
        (nxt > F.col("_mean") + sigmas * F.col("_sd")).alias("exceeds_usual"), (nxt < 0).alias("reverse_flow_ahead"),
    )


def _minute(ts: str) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).alias("_minute")


def _day(ts: str) -> Column:
    return F.weekday(ts).alias("_day")
