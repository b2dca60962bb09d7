"""Median imputation with medians kept for scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.scalar import finite
from wattframe.operators.quantiles import medians
from wattframe.operators.series import attach, attach_row


def impute_medians(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group with `median_<name>` columns, from the rows eligible for fitting."""
    clean = rows.select(*keys, *[finite(n).alias(n) for n in names])
    tall = medians(clean, names, keys)
    return tall.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == n, F.col("median"))).alias(f"median_{n}") for n in names])


def impute(rows: DataFrame, fitted: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fill with the median of the group, then with 0."""
    joined = attach(rows, fitted, keys) if keys else attach_row(rows, fitted)
    kept = [c for c in rows.columns if c not in names]
    return joined.select(*kept, *[F.coalesce(finite(n), F.col(f"median_{n}"), F.lit(0.0)).alias(n) for n in names])
