"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.plans import views as v
from wattframe.plans.registry import query
from wattframe.operators.reshape import discover_series
from wattframe.session import work_folder
from wattframe.sources import scan, sinks


@query("scan_telemetry", """
    SELECT event_type, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts, sum(value) AS total FROM events GROUP BY event_type""", ["total"])
def scan_telemetry(t):
    rows = scan.scan_telemetry(t.spark, f"{t.folder}/events.parquet")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("value").alias("total")
    )


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TABLE_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("asset_resolve", " UNION ALL ".join(f"SELECT '{n}' AS asset_id, count(*) AS row_count, 1 AS files, FALSE AS ambiguous FROM {n}" for n in TABLE_FILES))
def asset_resolve(t):
    """The data folder as an asset tree: every file, its rows and whether its name is unique. No column of the files is read."""
    tree = scan.scan_asset_tree(t.spark, t.folder, "unread string")
    rows = tree.groupBy("asset_id").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.join(scan.resolve_assets(tree).select("asset_id", "files", "ambiguous"), "asset_id")


@query("weather_scan", "SELECT * FROM weather", [
    "cloud_cover", "wind_speed_10m", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_direction_10m", "shortwave_radiation"])
def weather_scan(t):
    """Weather written below `weather_measurements` and scanned from there; the files are named by Spark, so the asset is a column of its own."""
    folder = work_folder(t.spark, "observed")
    v.weather(t).withColumnsRenamed({"asset_id": "station", "timestamp": "datetime"}).write.parquet(f"{folder}/weather_measurements")
    return scan.scan_weather(t.spark, folder).drop("asset_id", "source_path").withColumnRenamed("station", "asset_id")


@query("catalogue_filter", """
    SELECT r.asset_id, any_value(group_name) AS group_name, any_value(52 + n / 1000.0) AS latitude, any_value(4 + n / 2000.0) AS longitude, count(*) AS row_count
    FROM raw r JOIN (SELECT asset_id, count(*) AS n FROM raw GROUP BY 1) c ON r.asset_id = c.asset_id
    WHERE group_name IN ('solar_park', 'wind_park') GROUP BY r.asset_id""", ["latitude", "longitude"])
def catalogue_filter(t):
    rows = v.raw(t)
    assets = rows.groupBy("asset_id", "group_name").agg(F.count(F.lit(1)).alias("n"))
    assets = scan.catalogue(assets.withColumn("latitude", 52 + F.col("n") / 1000).withColumn("longitude", 4 + F.col("n") / 2000))
    parks = assets.where(F.col("group_name").isin("solar_park", "wind_park"))
    joined = scan.with_coordinates(rows.where(F.col("group_name").isin("solar_park", "wind_park")), parks)
    return joined.groupBy("asset_id", "group_name", "latitude", "longitude").agg(F.count(F.lit(1)).alias("row_count"))


@query("wide_csv_scan", "SELECT * FROM wide", [
    "DE_solar_generation_actual", "DE_wind_onshore_generation_actual", "AT_wind_offshore_generation_actual", "NL_wind_generation_actual",
    "DE_solar_capacity", "NL_wind_capacity"])
def wide_csv_scan(t):
    folder = work_folder(t.spark, "wide")
    v.wide(t).write.option("header", True).csv(scan.wide_csv_path(folder))
    return scan.scan_wide_csv(t.spark, folder)


@query("format_scan", """
    SELECT f.format, e.* FROM (VALUES ('csv'), ('json'), ('parquet')) f(format), (SELECT event_type, count(*) AS row_count, sum(value) AS total, CAST(sum(event_id) AS BIGINT) AS ids,
        CAST(sum(user_id) AS BIGINT) AS users, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(length(props)) AS BIGINT) AS props_chars FROM events GROUP BY 1) e""", ["total"])
def format_scan(t):
    base = t.read("events")
    folder, parts = work_folder(t.spark, "formats"), []
    for fmt, ending in (("csv", "csv"), ("json", "jsonl"), ("parquet", "parquet")):
        path = f"{folder}/{fmt}.{ending}"
        # The usual stamp formats of text files stop at milliseconds.
        text = {} if fmt == "parquet" else {"timestampFormat": MICROS, "timestampNTZFormat": MICROS}
        writer = base.write.options(**text).option("header", True) if fmt == "csv" else base.write.options(**text)
        getattr(writer, fmt)(path)
        parts.append(scan.scan_table(t.spark, path, base.schema).withColumn("format", F.lit(fmt)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("format", "event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total"), F.sum("event_id").alias("ids"), F.sum("user_id").alias("users"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.sum(F.length("props")).alias("props_chars"),
    )


@query("parquet_sink", """
    SELECT group_name, strftime(timestamp, '%Y-%m') AS month, count(*) AS row_count, sum(load) AS load FROM loads GROUP BY 1, 2""", ["load:1"])
def parquet_sink(t):
    path = sinks.write_table(v.load(t), work_folder(t.spark, "canonical"))
    back = t.spark.read.parquet(path)
    return back.groupBy("group_name", F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("load").alias("load")
    )


@query("report_sink", "SELECT asset_id, count(*) AS row_count, avg(load) AS mean_load FROM raw GROUP BY 1", ["mean_load:3"])
def report_sink(t):
    report = v.raw(t).groupBy("asset_id").agg(F.count(F.lit(1)).alias("row_count"), F.avg("load").alias("mean_load"))
    path = sinks.write_report(report, work_folder(t.spark, "report"))
    return t.spark.read.schema(report.schema).json(path)


@query("wide_schema", """
    SELECT c.asset_id, c.capacity_column, count(*) AS row_count FROM wide,
        (VALUES ('DE_solar_generation_actual', 'DE_solar_capacity'), ('DE_wind_onshore_generation_actual', NULL),
            ('AT_wind_offshore_generation_actual', NULL), ('NL_wind_generation_actual', 'NL_wind_capacity')) c(asset_id, capacity_column)
    GROUP BY 1, 2""")
def wide_schema(t):
    wide = v.wide(t)
    series = discover_series(wide.columns)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(g).alias("asset_id"), F.lit(c).cast("string").alias("capacity_column")) for g, c in series.items()
    ]))
    return wide.select(pairs.alias("_s")).groupBy("_s.asset_id", "_s.capacity_column").agg(F.count(F.lit(1)).alias("row_count"))
