"""Calendar features. Monday is day 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import col

TWO_PI = 6.283185307179586


def wave(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * TWO_PI / period
    return F.sin(angle), F.cos(angle)


def season_code(month: Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 autumn."""
    return (
        F.when(month.isin(12, 1, 2), 1).when(month.isin(3, 4, 5), 2).when(month.isin(6, 7, 8), 3).otherwise(4)
    )


def season_index(month: Column) -> Column:
    """0 winter, 1 spring, 2 summer, 3 autumn, the code of the wind features."""
    return F.when(month.isNotNull(), season_code(month) - 1)


def calendar_columns(ts: str | Column) -> list[Column]:
    """Hour, weekday, weekend, season and their waves (the demand calendar without the holiday)."""
    ts = col(ts)
    hour, day = F.hour(ts), F.weekday(ts)
    (sin_hour, cos_hour), (sin_day, cos_day) = wave(hour, 24.0), wave(day, 7.0)
    return [
        hour.alias("hour"), day.alias("day_of_week"), (day >= 5).cast("int").alias("is_weekend"),
        season_code(F.month(ts)).alias("season"), sin_hour.alias("sin_hour"), cos_hour.alias("cos_hour"),
        sin_day.alias("sin_dow"), cos_day.alias("cos_dow"),
    ]


def holidays(df: DataFrame, days: dict[str, str] | None = None) -> DataFrame:
    """The holiday list as a table of a few rows."""
    rows = list((C.HOLIDAYS if days is None else days).items())
    table = df.sparkSession.createDataFrame(rows, "holiday_date string, holiday_name string")
    return table.withColumn("holiday_date", F.to_date("holiday_date"))


def with_holiday(df: DataFrame, ts: str = "timestamp", days: dict[str, str] | None = None) -> DataFrame:
    """Add `is_holiday` and `holiday_name`; the list has a few dozen rows at most."""
    joined = df.withColumn("holiday_date", F.to_date(ts)).join(F.broadcast(holidays(df, days)), "holiday_date", "left")
    return joined.withColumn("is_holiday", F.col("holiday_name").isNotNull().cast("int")).drop("holiday_date")


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return with_holiday(df.select("*", *calendar_columns(ts)), ts).drop("holiday_name")


def cyclic_columns(ts: str | Column, year_days: bool = True) -> list[Column]:
    """Sine and cosine of hour, weekday, day of year and month for the hourly models."""
    ts = col(ts)
    parts = [("hour", F.hour(ts), 24), ("day_of_week", F.weekday(ts), 7)]
    if year_days:
        parts.append(("day_of_year", F.dayofyear(ts), 366))
    parts.append(("month", F.month(ts) - 1, 12))
    out = []
    for name, value, period in parts:
        sine, cosine = wave(value, period)
        out += [sine.alias(f"{name}_sin"), cosine.alias(f"{name}_cos")]
    return out


def clock_columns(ts: str | Column, season: bool = False) -> list[Column]:
    """Time-of-day features of the generation models."""
    ts = col(ts)
    day = F.weekday(ts)
    out = [
        F.hour(ts).alias("hour_of_day"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute_of_day"),
        F.dayofyear(ts).alias("day_of_year"), F.month(ts).alias("month"), day.alias("day_of_week"),
        (day >= 5).cast("int").alias("is_weekend"),
    ]
    return [*out, season_index(F.month(ts)).alias("season")] if season else out
