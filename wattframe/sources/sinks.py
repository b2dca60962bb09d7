"""Writers. Tables are partitioned by asset group; reports are small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("group_name",), mode: str = "overwrite") -> str:
    """Canonical and feature tables. Rows of a group are spread by month, so a large group gives many files."""
    keys = [c for c in partition_by if c in df.columns]
    if keys and "timestamp" in df.columns:
        df = df.repartition(*keys, F.date_format("timestamp", "yyyy-MM"), F.pmod(F.xxhash64("asset_id"), F.lit(16)))
    df.write.mode(mode).partitionBy(*keys).parquet(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Quality reports, metrics and manifests: one row per asset or model, so they stay small."""
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported report format {fmt!r}")
    return path
