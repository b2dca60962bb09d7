"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build_session(app: str = "wattframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.parquet.nanosAsLong", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All stamps are UTC; expressions must resolve in that zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a table next to the checkpoints and read it back.

    Used where a result feeds several later passes. The rows are computed once
    (an eager checkpoint computes its last stage twice), stay columnar, and
    outlive any executor.
    """
    spark = df.sparkSession
    path = work_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, shared by all executors of a cluster."""
    return f"{shared_folder(spark)}/wattframe-{uuid.uuid4().hex}/{name}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session whose executors are threads of the driver may go without; it gets one temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="wattframe-")
        shared = _LOCAL[application]
    return shared.rstrip("/")


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")
