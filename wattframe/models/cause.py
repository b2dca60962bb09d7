"""What deviations go along with: one pooled model per asset type on weather, clock, sun, history, anomaly flag and diagnosis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.calendar import clock_columns
from wattframe.functions.physics import solar_position, wind_columns
from wattframe.functions.scalar import finite
from wattframe.models import boosted
from wattframe.operators.features import gen_lags
from wattframe.operators.reshape import one_hot
from wattframe.operators.splits import chronological_split
from wattframe.session import cut_lineage

KEYS = ["asset_id", "timestamp"]
CATEGORY = "diagnostic_category"


@dataclass
class CauseModel:
    """A regression and the diagnoses it has learnt; others count as none of them."""

    regression: boosted.Regression
    categories: list[str]

    def aligned(self, rows: DataFrame) -> DataFrame:
        """Rows with the inputs of the model, whatever diagnoses they hold. The flag becomes a number; inputs that the rows lack are null."""
        rows = one_hot(rows.drop(*_coded(self.categories)), CATEGORY, self.categories)
        if "anomaly" in rows.columns:
            rows = rows.withColumn("anomaly", F.col("anomaly").cast("double"))
        return rows.withColumns({n: F.lit(None).cast("double") for n in self.regression.names if n not in rows.columns})

    def predict(self, rows: DataFrame, output: str) -> DataFrame:
        return self.regression.predict(self.aligned(rows), output)

    def contributions(self, rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
        return boosted.contributions(self.regression, self.aligned(rows), keys)


def _coded(categories: Sequence[str]) -> list[str]:
    return [f"{CATEGORY}_{c}" for c in categories]


def cause_frame(diagnosed: DataFrame, weather: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Diagnosed rows (unique per asset and stamp) with every input of C.CAUSE_INPUTS but the flag, which anomaly detection adds.

    History is that of `actual_mw` and of the wind, before the row.
    """
    measures = [c for c in weather.columns if c not in KEYS]
    rows = diagnosed.drop(*measures).join(weather, KEYS, "left")
    rows = rows.select("*", *clock_columns("timestamp", season=True), *solar_position("timestamp", latitude, longitude))
    return gen_lags(rows.select("*", *wind_columns()), "actual_mw", "wind_speed_10m")


def cause_rows(frame: DataFrame) -> DataFrame:
    """Rows with a finite deviation from a real expectation, placed in time."""
    rows = frame.withColumn("percentage_deviation", finite("percentage_deviation"))
    return chronological_split(rows.where(F.col("percentage_deviation").isNotNull() & (F.col("expected_mw") > C.CAUSE_MIN_EXPECTED_MW)))


def cause_report(frame: DataFrame, placed: DataFrame, min_rows: int = C.CAUSE_MIN_ROWS) -> DataFrame:
    """One row per asset type of `frame`: rows of each part, the diagnoses of its train part, the number of inputs, and the reason where it gets no model.

    Diagnoses are few by their definition, so their list is one small value.
    """
    train = F.col("split") == "train"
    counted = frame.select("asset_type").distinct().join(placed.groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")],
        F.sort_array(F.collect_set(F.when(train, F.col(CATEGORY)))).alias("categories"),
    ), "asset_type", "left").na.fill(0)
    known = F.create_map(*[x for kind, names in C.CAUSE_INPUTS.items() for x in (F.lit(kind), F.lit(len(names)))])
    own = F.try_element_at(known, F.col("asset_type"))
    reason = F.when(own.isNull(), "unsupported asset type").when(F.col("rows") < min_rows, "insufficient finite deviation rows").when(F.col("train_rows") == 0, "no train rows")
    return counted.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).withColumn("skipped", reason).withColumn(
        "inputs", F.when(reason.isNull(), own + F.size("categories"))
    )


def cause_fits(frame: DataFrame, min_rows: int = C.CAUSE_MIN_ROWS, iterations: int = C.CAUSE_ROUNDS) -> tuple[dict[str, CauseModel], DataFrame, DataFrame]:
    """Models by asset type, the placed rows, and the report. Which types have enough rows is decided by one aggregate over all of them."""
    placed = cut_lineage(cause_rows(frame))
    report = cause_report(frame, placed, min_rows)
    vocabulary = {r["asset_type"]: list(r["categories"]) for r in report.where("skipped IS NULL").collect()}

    def fit(kind: str):
        empty = CauseModel(boosted.Regression(None, None, []), vocabulary[kind])
        train = empty.aligned(placed.where((F.col("asset_type") == kind) & (F.col("split") == "train")))
        names = [*C.CAUSE_INPUTS[kind], *_coded(vocabulary[kind])]
        return lambda: CauseModel(boosted.pooled_fit(train, names, "percentage_deviation", iterations, depth=C.CAUSE_DEPTH), vocabulary[kind])

    return boosted.fit_together({kind: fit(kind) for kind in vocabulary}) if vocabulary else {}, placed, report
