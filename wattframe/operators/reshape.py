"""Wide to long, arrays to rows, categories to columns, samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.scalar import SERIES_NAME, finite
from wattframe.operators.series import ASSET, POSITION, TOTAL, TS, positions


def discover_series(columns: Sequence[str]) -> dict[str, str | None]:
    """Generation columns of a wide frame and the capacity column of each, by name."""
    out = {}
    for name in columns:
        if re.match(SERIES_NAME, name):
            capacity = name.removesuffix("_generation_actual") + "_capacity"
            out[name] = capacity if capacity in columns else None
    return out


def unpivot_series(df: DataFrame, source: str = "power_system", ts: str = "utc_timestamp") -> DataFrame:
    """One row per stamp and generation column: asset, energy type, MW, capacity."""
    series = discover_series(df.columns)
    if not series:
        raise ValueError("no generation columns found")
    rows = [
        F.struct(
            F.lit(name).alias("asset_id"), F.lit(re.match(SERIES_NAME, name).group(2)).alias("energy_type"),
            finite(name).alias("actual_mw"), (finite(capacity) if capacity else F.lit(None).cast("double")).alias("capacity_mw"),
        )
        for name, capacity in series.items()
    ]
    return df.select(F.col(ts).alias(TS), F.explode(F.array(*rows)).alias("_s")).select(TS, "_s.*", F.lit(source).alias("source"))


def union_series(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def grid_union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    return a.select(*keys, ts).unionByName(b.select(*keys, ts)).distinct()


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """0/1 columns for a fitted list of categories; others give zeros."""
    prefix = prefix or column
    return df.select("*", *[F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)).alias(f"{prefix}_{c}") for c in categories])


def arrays_to_rows(df: DataFrame, arrays: Sequence[str], position: str = "period") -> DataFrame:
    """Equal-length arrays to one row per position."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias(position, "_z")).select(*rest, position, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def rows_to_arrays(df: DataFrame, keys: Sequence[str], values: Sequence[str], position: str = "period") -> DataFrame:
    """Back to ordered arrays; meant for the few periods of one scenario."""
    packed = F.array_sort(F.collect_list(F.struct(position, *values)))
    grouped = df.groupBy(*keys).agg(packed.alias("_p"))
    return grouped.select(*keys, *[F.col(f"_p.{v}").alias(v) for v in values])


def even_sample(df: DataFrame, count: int = 10, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """`count` evenly spaced rows per series; short series stay whole."""
    rows = positions(df, keys, ts)
    n = F.col(TOTAL)
    picks: Column = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * ((n - 1) / F.lit(float(count - 1)))) + 1)
    return rows.where((n < count) | F.array_contains(picks, F.col(POSITION)))
