"""Readers: format by suffix, asset trees, weather, catalogue, wide CSV."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.operators.quality import nan_to_null
from wattframe.operators.reshape import discover_series

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("asset_id", T.StringType()), T.StructField("group_name", T.StringType()),
    T.StructField("load", T.DoubleType()), T.StructField("available_at", T.TimestampType()),
])

# Seconds per row for each resolution of the wide source, and its file name.
RESOLUTIONS = {"15min": 900, "30min": 1800, "60min": 3600}


def suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read parquet, CSV, JSON or JSON lines, chosen by the suffix of the path."""
    kind = suffix(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in (".parquet", ".pq", ""):
        return reader.parquet(path)
    if kind == ".csv":
        # Without a schema every column stays text; a sampled guess would cost a full extra pass.
        return reader.option("header", True).csv(path)
    if kind in (".jsonl", ".ndjson"):
        return reader.json(path)
    if kind == ".json":
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unsupported file type {kind!r}: {path}")


def scan_telemetry(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Load telemetry with missing values as null; only parquet and CSV are telemetry formats."""
    if suffix(path) not in (".parquet", ".pq", ".csv", ""):
        raise ValueError(f"unsupported telemetry file type: {path}")
    if schema is None and suffix(path) == ".csv":
        schema = TELEMETRY_SCHEMA
    return clean_columns(nan_to_null(scan_table(spark, path, schema)))


def clean_columns(df: DataFrame) -> DataFrame:
    """`datetime` or a saved index becomes `timestamp`; zone-free stamps are read as UTC.

    Nanosecond stamps arrive as numbers when the session reads them so
    (`spark.sql.legacy.parquet.nanosAsLong`, on in `build_session`).
    """
    for old in ("datetime", "__index_level_0__"):
        if old in df.columns and "timestamp" not in df.columns:
            df = df.withColumnRenamed(old, "timestamp")
    for name in ("timestamp", "available_at"):
        if name in df.columns:
            nanos = dict(df.dtypes)[name] == "bigint"
            df = df.withColumn(name, F.timestamp_micros(F.expr(f"`{name}` div 1000")) if nanos else F.col(name).cast("timestamp"))
    return df


def asset_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.(?:parquet|pq)$", 1)


def scan_asset_tree(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One file per asset anywhere below `folder`, read as one table with `asset_id` from the file name."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader if schema is None else reader.schema(schema)
    df = reader.parquet(folder)
    return clean_columns(nan_to_null(df.select("*", asset_from_path(F.col("_metadata.file_path")).alias("asset_id"), F.col("_metadata.file_path").alias("source_path"))))


def resolve_assets(tree: DataFrame) -> DataFrame:
    """Files per asset; more than one is ambiguous, unless exactly one lies directly in the folder."""
    files = tree.select("asset_id", "source_path").distinct()
    depth = F.size(F.split("source_path", "/"))
    counted = files.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("files"), F.min_by("source_path", F.struct(depth, "source_path")).alias("source_path"), F.min(depth).alias("_depth")
    )
    top = counted.agg(F.min("_depth").alias("_top"))
    joined = counted.withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    return joined.select("asset_id", "files", "source_path", ((F.col("files") > 1) & (F.col("_depth") > F.col("_top"))).alias("ambiguous"))


def require_unambiguous(resolved: DataFrame) -> DataFrame:
    text = F.concat(F.lit("several files for asset "), F.col("asset_id"))
    return resolved.withColumn("asset_id", F.when(F.col("ambiguous"), F.raise_error(text).cast("string")).otherwise(F.col("asset_id")))


def scan_weather(spark: SparkSession, folder: str, versioned: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """Observed weather, or versioned forecasts that carry `available_at`."""
    df = scan_asset_tree(spark, os.path.join(folder, "weather_forecasts_versioned" if versioned else "weather_measurements"), schema)
    if versioned and "available_at" not in df.columns:
        raise ValueError("versioned weather needs available_at")
    return df


def catalogue(df: DataFrame) -> DataFrame:
    """Asset dimension: name, group, coordinates, limits."""
    return df.select("asset_id", "group_name", *[c for c in ("latitude", "longitude", "lower_limit", "upper_limit") if c in df.columns])


def catalogue_assets(assets: DataFrame, group: str) -> DataFrame:
    return assets.where(F.col("group_name") == group).select("asset_id")


def with_coordinates(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Coordinates of each row's asset. Spark picks the join by the size of the catalogue."""
    return rows.join(assets.select("asset_id", "latitude", "longitude"), "asset_id", "left")


def wide_csv_path(folder: str, resolution: str = "60min") -> str:
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unsupported resolution {resolution!r}; choose one of {tuple(RESOLUTIONS)}")
    return os.path.join(folder, f"time_series_{resolution}_singleindex.csv")


def scan_wide_csv(spark: SparkSession, folder: str, resolution: str = "60min") -> DataFrame:
    """The wide generation file: stamp and the generation and capacity columns found in its header."""
    path = wide_csv_path(folder, resolution)
    df = scan_table(spark, path)
    if "utc_timestamp" not in df.columns:
        raise ValueError(f"missing utc_timestamp in {path}")
    series = discover_series(df.columns)
    if not series:
        raise ValueError(f"no generation columns found in {path}")
    measures: Sequence[str] = [*series, *dict.fromkeys(c for c in series.values() if c)]
    stamp = F.expr("try_to_timestamp(utc_timestamp)").alias("utc_timestamp")
    return df.select(stamp, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in measures])


def safe_name(asset_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", asset_id)
