"""Sun position and wind physics as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import col


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def solar_position(ts: str | Column, latitude: str | Column, longitude: str | Column) -> list[Column]:
    """Elevation, azimuth (clockwise from north) in degrees, and the clipped cosine of the zenith.

    Spencer declination and equation of time; stamps are UTC.
    """
    ts, lat, lon = col(ts), F.radians(col(latitude)), col(longitude)
    year_angle = F.radians((F.dayofyear(ts) - 81) * (360.0 / 365.0))
    declination = F.radians(F.sin(year_angle) * 23.45)
    time_equation = F.sin(year_angle * 2) * 9.87 - F.cos(year_angle) * 7.53 - F.sin(year_angle) * 1.5
    solar_minutes = F.hour(ts) * 60 + F.minute(ts) + lon * 4.0 + time_equation
    hour_angle = F.radians(solar_minutes / 4 - 180)
    sine = _clip(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(hour_angle))
    elevation = F.asin(sine)
    bearing = F.degrees(F.acos(_clip(
        (F.sin(declination) - F.sin(elevation) * F.sin(lat)) / (F.cos(elevation) * F.cos(lat) + 1e-10)
    )))
    return [
        F.degrees(elevation).alias("solar_elevation_deg"),
        F.when(hour_angle > 0, 360 - bearing).otherwise(bearing).alias("solar_azimuth_deg"),
        F.greatest(F.lit(0.0), F.sin(elevation)).alias("cos_solar_zenith"),
    ]


def wind_columns(
    speed: str = "wind_speed_10m", direction: str = "wind_direction_10m",
    temperature: str = "temperature_2m", pressure: str = "surface_pressure",
) -> list[Column]:
    v, angle = F.col(speed), F.radians(F.col(direction))
    return [
        (v * v * v).alias("wind_speed_cubed"), F.sin(angle).alias("wind_dir_sin"), F.cos(angle).alias("wind_dir_cos"),
        (F.col(pressure) / F.nullif(F.col(temperature) + 273.15, F.lit(0.0))).alias("air_density_proxy"),
    ]


def turbine_fraction(speed: str | Column) -> Column:
    """Share of rated power: cubic between cut-in and rated speed, 1 up to cut-out."""
    v = col(speed)
    return (
        F.when((v >= C.CUT_IN) & (v < C.RATED), F.pow((v - C.CUT_IN) / (C.RATED - C.CUT_IN), F.lit(3.0)))
        .when((v >= C.RATED) & (v <= C.CUT_OUT), 1.0)
        .when(v.isNotNull(), 0.0)
    )
