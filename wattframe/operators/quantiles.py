"""Exact interpolated percentiles in bounded memory.

The built-in exact `percentile` gathers every distinct value of a group in one
aggregation buffer. Here a sketch first brackets each wanted rank, then one
counting pass settles it: values outside the brackets collapse into a handful
of counters per group before the shuffle, and only the few values inside a
bracket are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.operators.series import attach, attach_row

SKETCH_ACCURACY = 100_000


def exact_percentiles(
    df: DataFrame,
    value: Column,
    wanted: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
    count_as: str | None = None,
) -> DataFrame:
    """One row per group with the interpolated percentiles named in `wanted`."""
    keys = list(keys)
    base = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 2.0 / accuracy
    names = list(wanted)
    ranks = [p for n in names for p in (max(wanted[n] - slack, 0.0), min(wanted[n] + slack, 1.0))]
    bracket = base.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", ranks, accuracy).alias("_q"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    # The slack must span several ranks to cover the sketch error and both
    # neighbours of the rank; groups too small for that are ordered whole.
    small = F.col("_n") <= 4 * accuracy
    lows, highs = [], []
    for i, name in enumerate(names):
        lows.append(F.when(small | F.lit(wanted[name] <= slack), F.col("_min")).otherwise(F.col("_q")[2 * i]))
        highs.append(F.when(small | F.lit(wanted[name] >= 1 - slack), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]))
    bracket = bracket.select(*keys, "_n", F.array(*lows).alias("_low"), F.array(*highs).alias("_high"))

    joined = attach(base, bracket, keys, "inner") if keys else attach_row(base, bracket)
    # Plain comparisons: every value of the table passes here.
    brackets = [(F.col("_low")[i], F.col("_high")[i]) for i in range(len(names))]
    inside = reduce(or_, [(F.col("_v") >= low) & (F.col("_v") <= high) for low, high in brackets])
    passed = [F.when(high < F.col("_v"), high) for _, high in brackets]
    below = passed[0] if len(passed) == 1 else F.greatest(*passed)
    marked = joined.withColumn("_in", inside)
    counted = (
        marked.groupBy(*keys, "_n", F.when(F.col("_in"), F.col("_v")).otherwise(below).alias("_at"), "_in")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    ordered = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), F.col("_in").desc())
    counted = counted.withColumn("_upto", F.sum("_k").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_k") <= rank)
        return F.max(F.when(hit & F.col("_in"), F.col("_at")))

    parts = []
    for i, name in enumerate(names):
        rank = (F.col("_n") - 1) * F.lit(float(wanted[name]))
        parts += [
            at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}"),
            F.first(rank - F.floor(rank)).alias(f"_f{i}"),
        ]
    found = counted.groupBy(*keys, "_n").agg(*parts)
    values = []
    for i, name in enumerate(names):
        lo, hi, frac = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        missed = F.raise_error(F.lit(f"percentile {name}: rank outside its bracket")).cast("double")
        values.append(F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * frac).alias(name))
    count = [F.col("_n").alias(count_as)] if count_as else []
    return found.select(*keys, *count, *values)


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per-group median of several columns, as rows (group, feature, median)."""
    keys = list(keys)
    if not keys:
        return _whole_medians(df, columns)
    tall = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_p")).select(*keys, "_p.feature", "_p.value")
    return exact_percentiles(tall, F.col("value"), {"median": 0.5}, [*keys, "feature"])


def _whole_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Medians over all rows, by the same three steps. The columns stay side by side, and only values inside a bracket become rows."""
    values = {c: F.col(f"`{c}`").cast("double") for c in columns}
    slack = 2.0 / SKETCH_ACCURACY
    ends = df.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, [0.5 - slack, 0.5 + slack], SKETCH_ACCURACY).alias("q")).alias(f"_{i}")
        for i, v in enumerate(values.values())
    ]).first()
    known = {c: e for c, e in zip(values, ends) if e["n"]}
    brackets = {c: (e["min"], e["max"]) if e["n"] <= 4 * SKETCH_ACCURACY else tuple(e["q"]) for c, e in known.items()}
    if not known:
        return df.sparkSession.createDataFrame([], "feature string, median double")
    passed = df.agg(*[F.count_if(values[c] < F.lit(low)).alias(f"_{i}") for i, (c, (low, _)) in enumerate(brackets.items())]).first()
    inside = [F.when((values[c] >= F.lit(low)) & (values[c] <= F.lit(high)), F.struct(F.lit(c).alias("feature"), values[c].alias("_at"))) for c, (low, high) in brackets.items()]
    counted = df.select(F.explode(F.array_compact(F.array(*inside))).alias("_p")).groupBy("_p.feature", "_p._at").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("feature").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda numbers, kind: F.element_at(F.create_map(*[x for c, n in zip(known, numbers) for x in (F.lit(c), F.lit(n).cast(kind))]), F.col("feature"))
    placed = counted.withColumn("_upto", F.sum("_k").over(before) + of(passed, "long")).withColumn("_rank", (of([e["n"] for e in known.values()], "long") - 1) * F.lit(0.5))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_k") <= rank), F.col("_at")))
    found = placed.groupBy("feature").agg(at(F.floor("_rank")).alias("_lo"), at(F.ceil("_rank")).alias("_hi"), F.first(F.col("_rank") - F.floor("_rank")).alias("_f"))
    missed = F.raise_error(F.lit("median: rank outside its bracket")).cast("double")
    lo, hi = F.col("_lo"), F.col("_hi")
    return found.select("feature", F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * F.col("_f")).alias("median"))
