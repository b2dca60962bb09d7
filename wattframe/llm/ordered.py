"""Running aggregates along the rows of each key, for keys that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

SUM, XOR = "sum", "xor"
_AGGREGATES = {SUM: F.sum, XOR: F.bit_xor}


def running(rows: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """`rows` with, for every name in `values`, the running aggregate (column, SUM or XOR) of a key's rows up to and including each, in `order` (nulls first), or from its end.

    Rows are dealt by ranges of (key, order); each task runs along its own rows, and what the earlier tasks hold of the same key is added from one row per task and key. So a key
    that holds most rows is worked on by many tasks. `order` must tell the rows of a key apart wherever their order matters.
    """
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    ranged = cut_lineage(rows.repartitionByRange(F.col(key).asc_nulls_first(), *[way(c) for c in order]).withColumn("_task", F.spark_partition_id()))
    along = Window.partitionBy("_task", key).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[_AGGREGATES[how](column).over(along).alias(f"_{name}") for name, (column, how) in values.items()])
    totals = ranged.groupBy("_task", key).agg(*[_AGGREGATES[how](column).alias(f"_t_{name}") for name, (column, how) in values.items()])
    earlier = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_task").alias("_c_task"), F.col(key).alias("_c_key"), F.lag("_task").over(Window.partitionBy(key).orderBy("_task")).alias("_before"),
        *[_AGGREGATES[how](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (_, how) in values.items()],
    ).where("_before IS NOT NULL").drop("_before")
    joined = local.join(carry, (F.col("_task") == F.col("_c_task")) & F.col(key).eqNullSafe(F.col("_c_key")), "left")
    zero = F.lit(0).cast("long")
    added = {
        name: F.coalesce(f"_{name}", zero) + F.coalesce(f"_c_{name}", zero) if how == SUM else F.coalesce(f"_{name}", zero).bitwiseXOR(F.coalesce(f"_c_{name}", zero))
        for name, (_, how) in values.items()
    }
    return joined.select(*rows.columns, *[c.alias(name) for name, c in added.items()])
