"""Status of hourly generation: forecasts of unseen hours, performance, unusual hours, and what their deviation leans on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.models import boosted
from wattframe.models.anomaly import hourly_anomalies
from wattframe.operators.diagnose import deviation_category, performance_capacity, ranked_contributions
from wattframe.operators.features import HOURLY_FEATURES, hourly_feature_frame
from wattframe.operators.series import POSITION, TOTAL, positions
from wattframe.operators.splits import chronological_split, holdout_split
from wattframe.session import work_folder

KEYS = ["asset_id", "timestamp"]
INPUTS = [*HOURLY_FEATURES, "lagged_generation_ratio", "capacity_available"]
NO_EVIDENCE = "insufficient evidence"
EVIDENCE = 5
STATUS_BUCKETS = 16


@dataclass
class Run:
    """Tables of one run of a job in `folder`. A stage whose table is complete is read, not computed again, so a run that was ended goes on where it stopped."""

    spark: SparkSession
    folder: str
    computed: list[str] = field(default_factory=list)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._complete(path):
            build().write.mode("overwrite").parquet(path)
            self.computed.append(name)
        return self.spark.read.parquet(path)

    def _complete(self, path: str) -> bool:
        context = self.spark.sparkContext
        marker = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(context._jsc.hadoopConfiguration()).exists(marker)


def hourly_folds(rows: DataFrame, folds: int = C.HOURLY_FOLDS) -> DataFrame:
    """Inputs of every hour, whether they are complete (`eligible`), and `fold`: the first four fifths of each series in equal stretches from 0 on, later hours `folds`."""
    placed = holdout_split(positions(rows))
    first = F.floor(F.col(TOTAL) * F.lit(0.80))
    fold = F.when(F.col("split") == "train", F.floor((F.col(POSITION) - 1) * F.lit(folds) / first)).otherwise(F.lit(folds))
    framed = hourly_feature_frame(placed.withColumn("fold", fold.cast("int")).drop(POSITION, TOTAL))
    complete = F.lit(True)
    for name in HOURLY_FEATURES:
        complete = complete & F.col(name).isNotNull()
    return framed.withColumn("eligible", complete)


def hourly_expectations(frame: DataFrame, folds: int = C.HOURLY_FOLDS, iterations: int = C.HOURLY_ROUNDS) -> DataFrame:
    """`frame` with expected_mw: the forecast, by a pooled model of the energy type, of hours that the model and its inputs' medians have not seen.

    Fold k is forecast by a model of the folds before k; fold 0 and hours with incomplete inputs have no expectation. All fits run side by side.
    """
    usable = frame.where(F.col("eligible") & F.col("actual_mw").isNotNull())
    sizes = {(r["energy_type"], r["fold"]): r["count"] for r in usable.groupBy("energy_type", "fold").count().collect()}
    wanted = [(kind, k) for kind in sorted({kind for kind, _ in sizes}) for k in range(1, folds + 1) if any((kind, j) in sizes for j in range(k))]

    def fit(kind: str, k: int) -> Callable[[], boosted.Regression]:
        rows = usable.where((F.col("energy_type") == kind) & (F.col("fold") < k))
        return lambda: boosted.pooled_fit(rows, INPUTS, "actual_mw", iterations, "absolute", patience=C.HOURLY_PATIENCE)

    models = boosted.fit_together({(kind, k): fit(kind, k) for kind, k in wanted})
    mine = lambda kind, k: F.col("eligible") & (F.col("energy_type") == kind) & (F.col("fold") == k)
    covered = F.lit(False)
    for kind, k in wanted:
        covered = covered | F.coalesce(mine(kind, k), F.lit(False))
    out = frame.where(~covered).withColumn("expected_mw", F.lit(None).cast("double"))
    for (kind, k), model in models.items():
        out = out.unionByName(model.predict(frame.where(mine(kind, k)), "expected_mw", floor=0.0))
    return out


def cause_rows(performed: DataFrame) -> DataFrame:
    """Hours whose deviation can be learnt, placed in time."""
    deviates = F.col("percentage_deviation").isNotNull() & (F.abs("expected_mw") > C.HOURLY_CAUSE_MIN_EXPECTED_MW)
    return chronological_split(performed.where(deviates).drop("split"))


def hourly_deviation_fits(performed: DataFrame, min_rows: int = C.HOURLY_CAUSE_MIN_ROWS) -> tuple[dict[str, boosted.Regression], DataFrame]:
    """A deviation model of each energy type, and a report: rows of each part, and the reason where a type has no model."""
    rows = cause_rows(performed).persist()
    try:
        counted = performed.select("energy_type").distinct().join(rows.groupBy("energy_type").agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")]
        ), "energy_type", "left").na.fill(0)
        report = counted.withColumn("skipped", F.when(F.col("rows") < min_rows, "insufficient finite deviation rows"))
        kinds = [r["energy_type"] for r in report.where("skipped IS NULL").collect()]
        train = lambda kind: rows.where((F.col("energy_type") == kind) & (F.col("split") == "train"))
        fit = lambda kind: lambda: boosted.pooled_fit(train(kind), C.HOURLY_CAUSE_FEATURES, "percentage_deviation", C.HOURLY_CAUSE_ROUNDS, depth=C.CAUSE_DEPTH)
        return boosted.fit_together({kind: fit(kind) for kind in kinds}), report
    finally:
        rows.unpersist()


def evidence(performed: DataFrame, flagged: DataFrame, fits: dict[str, boosted.Regression]) -> DataFrame:
    """asset_id, timestamp, evidence: the strongest inputs of each unusual hour with their values and contributions."""
    shape = "asset_id string, timestamp timestamp, evidence array<struct<feature:string,value:double,contribution:double>>"
    out = performed.sparkSession.createDataFrame([], shape)
    unusual = performed.join(flagged.where("anomaly_flag").select(*KEYS), KEYS, "left_semi")
    values = F.create_map(*[x for n in C.HOURLY_CAUSE_FEATURES for x in (F.lit(n), F.col(n).cast("double"))])
    for kind, model in fits.items():
        rows = unusual.where(F.col("energy_type") == kind)
        ranked = ranked_contributions(boosted.contributions(model, rows, KEYS), KEYS, EVIDENCE).join(rows.select(*KEYS, values.alias("_v")), KEYS)
        listed = F.array_sort(F.collect_list(F.struct("rank", "feature", F.element_at("_v", F.col("feature")).alias("value"), "contribution")))
        out = out.unionByName(ranked.groupBy(*KEYS).agg(listed.alias("_e")).select(
            *KEYS, F.transform("_e", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"))).alias("evidence")
        ))
    return out


def root_cause(modelled: Column) -> tuple[Column, Column]:
    """Category and the reason why there is none: only evaluated anomalies of a modelled type with a finite deviation have one."""
    unusual = F.coalesce("anomaly_flag", F.lit(False))
    reason = (
        F.when(~unusual, "row is not an evaluated anomaly").when(~modelled, "cause model unavailable").when(F.col("percentage_deviation").isNull(), "percentage deviation is unavailable")
    )
    return F.when(reason.isNull(), deviation_category()).otherwise(NO_EVIDENCE), reason


def hourly_status(rows: DataFrame, run: Run | None = None, min_rows: int = C.HOURLY_CAUSE_MIN_ROWS, iterations: int = C.HOURLY_ROUNDS) -> DataFrame:
    """The status of every hour of `rows` (asset_id, timestamp, energy_type, actual_mw, capacity_mw).

    Stages, each a table of the run: inputs, expectations of unseen hours, performance, anomalies, evidence. Flags are null where an hour is not evaluated.
    """
    run = run or Run(rows.sparkSession, work_folder(rows.sparkSession, "hourly"))
    frame = run.stage("inputs", lambda: hourly_folds(rows))
    expected = run.stage("expectations", lambda: hourly_expectations(frame, iterations=iterations))
    performed = run.stage("performance", lambda: performance_capacity(expected))
    flagged = run.stage("anomalies", lambda: hourly_anomalies(expected.select(*KEYS, "energy_type", "actual_mw", "capacity_mw", "expected_mw")))

    def explained() -> DataFrame:
        fits, report = hourly_deviation_fits(performed, min_rows)
        run.stage("cause_report", lambda: report)
        return evidence(performed, flagged, fits)

    causes = run.stage("evidence", explained)
    report = run.stage("cause_report", lambda: hourly_deviation_fits(performed, min_rows)[1])
    joined = performed.join(flagged.select(*KEYS, "anomaly_score", "anomaly_flag"), KEYS, "left").join(causes, KEYS, "left")
    joined = joined.join(report.select("energy_type", F.col("skipped").isNull().alias("_modelled")), "energy_type", "left")
    cause, reason = root_cause(F.coalesce("_modelled", F.lit(False)))
    return joined.select(
        *KEYS, "energy_type", "actual_mw", "expected_mw", "absolute_deviation_mw", "percentage_deviation", "performance_ratio", "capacity_mw",
        F.col("generation_capacity_ratio").alias("capacity_ratio"), "anomaly_flag", "anomaly_score", F.lit("unknown").alias("curtailment_status"), cause.alias("root_cause"),
        F.lit(None).cast("double").alias("confidence"), F.coalesce("evidence", F.array().cast("array<struct<feature:string,value:double,contribution:double>>")).alias("evidence"),
        F.coalesce(reason, F.lit("contributions show what a model leans on, not a physical cause")).alias("uncertainty"), F.lit(False).alias("weather_available"),
    )


# --- status of one asset at one time ---------------------------------------------


def _bucket(asset: Column) -> Column:
    return F.pmod(F.xxhash64(asset), F.lit(STATUS_BUCKETS)).cast("int")


def write_status(status: DataFrame, path: str) -> str:
    """Status rows below `path` by day and hash of the asset, one file each, sorted by asset and time."""
    rows = status.withColumns({"day": F.to_date("timestamp").cast("string"), "bucket": _bucket(F.col("asset_id"))})
    dealt = rows.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "asset_id", "timestamp")
    dealt.write.mode("overwrite").partitionBy("day", "bucket").parquet(path)
    return path


def status_at(spark: SparkSession, path: str, asset_id: str, timestamp: str) -> DataFrame:
    """The status of an asset at a UTC stamp, read from the one file that can hold it, or one row with an error code: INVALID_ASSET_ID, INVALID_TIMESTAMP, TIMESTAMP_OUT_OF_RANGE."""
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c not in ("day", "bucket")]
    stamp = spark.sql("SELECT try_to_timestamp(:t) AS t", args={"t": timestamp}).first()["t"]
    empty = not isinstance(asset_id, str) or not asset_id.strip()
    if empty or stamp is None:
        found = table.where("false")
    else:
        bucket = spark.range(1).select(_bucket(F.lit(asset_id)).alias("b")).first()["b"]
        found = table.where((F.col("day") == stamp.strftime("%Y-%m-%d")) & (F.col("bucket") == bucket) & (F.col("asset_id") == asset_id) & (F.col("timestamp") == F.lit(timestamp).cast("timestamp")))
    code = "INVALID_ASSET_ID" if empty else "INVALID_TIMESTAMP" if stamp is None else "TIMESTAMP_OUT_OF_RANGE"
    row = found.limit(1).select(*columns, F.lit(1).alias("_one"))
    joined = spark.range(1).select(F.lit(1).alias("_one")).join(row, "_one", "left")
    return joined.select(*columns, F.when(F.col("asset_id").isNull(), F.lit(code)).alias("error_code"))
