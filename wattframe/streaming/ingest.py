"""Telemetry as it arrives: one row per asset and stamp, flagged, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattframe.operators.quality import range_flags

# Rows may arrive this late: the span a forward fill may bridge (four steps).
LATENESS = "1 hour"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, name_filter: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.format(fmt).load(folder)


def stream_ingest(rows: DataFrame, keys: tuple[str, ...] = ("asset_id", "timestamp"), lateness: str = LATENESS) -> DataFrame:
    """Drop repeats that arrive within the lateness bound and add range flags.

    State is one key per asset and stamp, forgotten once the watermark passes.
    """
    unique = rows.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(list(keys))
    return range_flags(unique)


def append_to(stream: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append to parquet; the checkpoint makes restarts exactly-once. `drain` stops when the input is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="1 minute")).start()
