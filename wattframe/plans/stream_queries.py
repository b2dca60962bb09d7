"""Streams drained over the given files; their batch twins are the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.plans import views as v
from wattframe.plans.registry import Tables, query
from wattframe.session import work_folder
from wattframe.streaming.ingest import append_to, read_stream, stream_ingest
from wattframe.streaming.zones import stream_snapshot

CAPACITY_MW = 40.0


class StreamedTables(Tables):
    """The same bindings over a stream of the files of a table."""

    def read(self, name):
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return read_stream(self.spark, self.folder, schema, f"{name}.parquet")


def drained(t, stream, name):
    folder = work_folder(t.spark, name)
    append_to(stream, f"{folder}/rows", f"{folder}/checkpoint", drain=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_ingest", """
    SELECT asset_id, count(DISTINCT timestamp) AS row_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM raw GROUP BY 1""")
def ingest(t):
    rows = v.raw(StreamedTables(t.spark, t.folder)).select("asset_id", "group_name", "timestamp", "load", "tie")
    kept = drained(t, stream_ingest(rows), "ingest")
    return kept.groupBy("asset_id").agg(F.count(F.lit(1)).alias("row_count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("stream_snapshot", f"""
    WITH w AS (SELECT zone_id, timestamp AS window_start, timestamp + INTERVAL '15 minutes' AS window_end, coalesce(sum(CASE WHEN kind = 'view' THEN value / 97.3 END), 0) AS solar_mw,
        coalesce(sum(CASE WHEN kind = 'click' THEN value / 97.3 END), 0) AS wind_mw, sum(value / 9.73) AS demand_mw, count(*) AS row_count FROM raw GROUP BY 1, 2),
    s AS (SELECT *, least(1.0, greatest(0.0, demand_mw - solar_mw - wind_mw) / {CAPACITY_MW}) AS stress_index FROM w)
    SELECT *, CASE WHEN stress_index >= 0.9 THEN 'critical' WHEN stress_index >= 0.75 THEN 'warning' ELSE 'normal' END AS severity FROM s
    WHERE window_end <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""", ["solar_mw", "wind_mw", "demand_mw", "stress_index"])
def snapshot(t):
    kind = F.col("kind")
    rows = v.raw(StreamedTables(t.spark, t.folder)).select(
        "event_time", "zone_id", F.when(kind == "view", "solar").when(kind == "click", "wind").otherwise("other").alias("asset_type"),
        (F.col("value") / 97.3).alias("actual_mw"), (F.col("value") / 9.73).alias("demand_mw"),
    )
    return drained(t, stream_snapshot(rows, CAPACITY_MW), "zones")
