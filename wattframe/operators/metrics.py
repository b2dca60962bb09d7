"""Forecast and classification scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.functions.scalar import finite


def score_columns(actual: str = "actual", predicted: str = "predicted", min_actual: float = C.MAPE_MIN_DEMAND_MW, strict: bool = True, stabiliser: float = 0.0, signed_base: bool = False) -> list[Column]:
    """MAE, RMSE, MAPE over pairs, with the rows MAPE may use."""
    y, p = finite(actual), finite(predicted)
    pair = y.isNotNull() & p.isNotNull()
    error = F.when(pair, y - p)
    size = y if signed_base else F.abs(y)
    counted = pair & (size > min_actual if strict else size >= min_actual)
    return [
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(counted, F.abs(error) / (F.abs(y) + stabiliser))) * 100).alias("mape"),
        F.count(error).alias("n"), F.count_if(counted).alias("n_mape"),
    ]


def forecast_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*keys).agg(*score_columns(actual, predicted)[:4])


def gen_metrics(df: DataFrame, keys: Sequence[str], rule: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Generation scores: the `solar`, `wind` or `hourly` rule decides which rows enter MAPE.

    Hourly predictions are floored at zero before scoring.
    """
    minimum, stabiliser = C.MAPE_RULES[rule]
    if rule == "hourly":
        df = df.withColumn(predicted, F.when(F.col(predicted).isNotNull(), F.greatest(F.lit(0.0), F.col(predicted))))
        return df.groupBy(*keys).agg(*score_columns(actual, predicted, minimum))
    return df.groupBy(*keys).agg(*score_columns(actual, predicted, minimum, strict=False, stabiliser=stabiliser, signed_base=True))


def class_counts(df: DataFrame, keys: Sequence[str], actual: str = "actual_class", predicted: str = "predicted_class") -> DataFrame:
    return df.groupBy(*keys, actual, predicted).agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(df: DataFrame, keys: Sequence[str], classes: Sequence[int] = (0, 1, 2), actual: str = "actual_class", predicted: str = "predicted_class") -> DataFrame:
    """One row per group and true class; the class list is fixed, so no data-dependent pivot."""
    return df.groupBy(*keys, actual).agg(*[
        F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in classes
    ])


def class_report(df: DataFrame, keys: Sequence[str], classes: Sequence[int] = (0, 1, 2), actual: str = "actual_class", predicted: str = "predicted_class") -> DataFrame:
    """Precision, recall, F1, support per class, macro and weighted means, accuracy. 0/0 is 0."""
    keys = list(keys)
    y, p = F.col(actual), F.col(predicted)
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_right"),
        *[F.count_if((y == c) & (p == c)).alias(f"_tp{c}") for c in classes],
        *[F.count_if(p == c).alias(f"_p{c}") for c in classes], *[F.count_if(y == c).alias(f"_y{c}") for c in classes],
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rows = []
    for c in classes:
        precision, recall = ratio(F.col(f"_tp{c}"), F.col(f"_p{c}")), ratio(F.col(f"_tp{c}"), F.col(f"_y{c}"))
        rows.append(F.struct(
            F.lit(str(c)).alias("class"), precision.alias("precision"), recall.alias("recall"),
            ratio(precision * recall * 2, precision + recall).alias("f1"), F.col(f"_y{c}").alias("support"),
        ))
    tall = counted.select(*keys, "_n", (F.col("_right") / F.col("_n")).alias("accuracy"), F.explode(F.array(*rows)).alias("_c"))
    tall = tall.select(*keys, "_n", "accuracy", "_c.*")
    # Three rows per group from here on.
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    names = ("precision", "recall", "f1")
    macro = tall.groupBy(*keys, "accuracy").agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    mean = tall.groupBy(*keys, "accuracy").agg(F.lit("weighted").alias("class"), *[weighted(c) for c in names], F.sum("support").alias("support"))
    order = [*keys, "class", *names, "support", "accuracy"]
    return tall.select(*order).unionByName(macro.select(*order)).unionByName(mean.select(*order))


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weight n / (k * n_c) per class, a table to join; counts are pre-aggregated."""
    keys = list(keys)
    per_class = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("class_rows"))
    whole = Window.partitionBy(*keys)
    weight = F.sum("class_rows").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("class_rows"))
    return per_class.withColumn("weight", weight)


def stack_models(model: DataFrame, baseline: DataFrame) -> DataFrame:
    return model.unionByName(baseline)


def ranked_models(df: DataFrame, keys: Sequence[str] = ("horizon_minutes",)) -> DataFrame:
    """Models ordered by MAE within each horizon, the winner marked."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("mae", "model"))
    return df.withColumn("rank", order).withColumn("is_winner", F.col("rank") == 1)


def winner(df: DataFrame, keys: Sequence[str] = ("horizon_minutes",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae"))


def anomaly_manifest(df: DataFrame, keys: Sequence[str], flag: str = "anomaly_flag", min_rows: int = 30) -> DataFrame:
    """Rows evaluated and flagged per group, or why it was skipped."""
    counted = df.groupBy(*keys).agg(
        F.count(flag).alias("evaluated"), F.count_if(F.col(flag)).alias("anomalous"), F.count(F.lit(1)).alias("row_count")
    )
    enough = F.col("evaluated") >= min_rows
    return counted.select(
        *keys, "row_count", F.when(enough, F.col("evaluated")).otherwise(F.lit(0)).alias("evaluated"),
        F.when(enough, F.col("anomalous")).otherwise(F.lit(0)).alias("anomalous"),
        F.when(enough, F.col("anomalous") / F.col("evaluated") * 100).alias("anomaly_pct"),
        F.when(~enough, "insufficient valid performance rows").alias("skip_reason"),
    )
