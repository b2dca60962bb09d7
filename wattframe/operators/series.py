"""Ordered computations over series, without one task per series.

`Window.partitionBy(asset).orderBy(timestamp)` sorts the whole history of an
asset in one task. Where one asset holds a large share of all rows that task
decides the run time, so nothing in this package does it. Two forms replace it:

`running`
    Prefix computations (row position, running sum, last known value, ...).
    Rows are windowed per (series, time bucket); a summary with one row per
    bucket carries the state across buckets. Its size is the number of
    calendar days of a series, whatever the sampling rate.

`row_windows` / `time_windows`
    Frames of bounded reach (lags, rolling statistics). A series is cut into
    chunks and each chunk receives a copy of the few rows its frames reach
    into, so every frame is complete and the copies are dropped afterwards.

Both need the order column to be unique inside a series (see `dedup`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
CHUNK_ROWS = 8_192
POSITION = "_pos"
TOTAL = "_n"
_BUCKET = "_bucket"

ASSET = ("asset_id",)
TS = "timestamp"


class Running(NamedTuple):
    """One prefix computation: output name, kind, input column."""

    name: str
    kind: str
    value: Column | None = None


def epoch(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("timestamp").cast("long")


def from_epoch(column: Column) -> Column:
    return F.timestamp_seconds(column)


def floor_time(column: str | Column, seconds: int) -> Column:
    return from_epoch(F.floor(epoch(column) / seconds) * seconds)


def _summary(m: Running, order: str) -> Column:
    known = F.when(m.value.isNotNull(), F.col(order)) if m.value is not None else None
    return {
        "position": lambda: F.count(F.lit(1)),
        "total": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(m.value),
        "max": lambda: F.max(m.value),
        "last": lambda: F.max_by(m.value, known),
        "next": lambda: F.min_by(m.value, known),
        "prev": lambda: F.max_by(F.struct(m.value.alias("v")), F.col(order)),
        "lead": lambda: F.min_by(F.struct(m.value.alias("v")), F.col(order)),
    }[m.kind]()


def _backwards(part: Sequence[str], order: str) -> WindowSpec:
    """Looking ahead is looking back in reverse order: a frame that grows row by
    row is linear, one that shrinks towards the end is recomputed for each row."""
    return Window.partitionBy(*part).orderBy(F.col(order).desc())


def _carry(m: Running, column: Column, keys: Sequence[str]) -> Column:
    spec = Window.partitionBy(*keys).orderBy(_BUCKET)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "position": lambda: F.sum(column).over(before),
        "total": lambda: F.sum(column).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "sum": lambda: F.sum(column).over(before),
        "max": lambda: F.max(column).over(before),
        "last": lambda: F.last(column, ignorenulls=True).over(before),
        "next": lambda: F.last(column, ignorenulls=True).over(_backwards(keys, _BUCKET).rowsBetween(Window.unboundedPreceding, -1)),
        "prev": lambda: F.lag(column).over(spec),
        "lead": lambda: F.lead(column).over(spec),
    }[m.kind]()


def _combine(m: Running, carry: Column, part: Sequence[str], order: str) -> Column:
    spec = Window.partitionBy(*part).orderBy(order)
    upto = spec.rowsBetween(Window.unboundedPreceding, 0)
    if m.kind == "position":
        return F.coalesce(carry, F.lit(0)) + F.row_number().over(spec)
    if m.kind == "total":
        return carry
    if m.kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(m.value).over(upto), F.lit(0))
    if m.kind == "max":
        return F.greatest(carry, F.max(m.value).over(upto))
    if m.kind == "last":
        return F.coalesce(F.last(m.value, ignorenulls=True).over(upto), carry)
    if m.kind == "next":
        onward = _backwards(part, order).rowsBetween(Window.unboundedPreceding, 0)
        return F.coalesce(F.last(m.value, ignorenulls=True).over(onward), carry)
    first = F.row_number().over(spec) == 1
    if m.kind == "prev":
        return F.when(first, carry["v"]).otherwise(F.lag(m.value).over(spec))
    last = F.lead(F.lit(1)).over(spec).isNull()
    return F.when(last, carry["v"]).otherwise(F.lead(m.value).over(spec))


def running(
    df: DataFrame,
    measures: Sequence[Running],
    keys: Sequence[str] = ASSET,
    order: str = TS,
    bucket: Column | None = None,
) -> DataFrame:
    """Add prefix computations over each series.

    Kinds: position, total, sum, max, last (known value at or before), next
    (known value at or after), prev and lead (neighbouring row, null or not).
    `bucket` must grow with `order`; the default is the calendar day.
    """
    keys = list(keys)
    bucket = F.floor(epoch(order) / DAY_SECONDS) if bucket is None else bucket
    rows = df.withColumn(_BUCKET, bucket)
    part = [*keys, _BUCKET]
    summary = rows.groupBy(*part).agg(*[_summary(m, order).alias(f"_s{i}") for i, m in enumerate(measures)])
    carried = summary.select(
        *part, *[_carry(m, F.col(f"_s{i}"), keys).alias(f"_c{i}") for i, m in enumerate(measures)]
    )
    # Every row has its summary. As a left join only the summary can be broadcast, never the rows.
    joined = rows.join(carried, part, "left")
    return joined.select(
        *df.columns, *[_combine(m, F.col(f"_c{i}"), part, order).alias(m.name) for i, m in enumerate(measures)]
    )


def positions(df: DataFrame, keys: Sequence[str] = ASSET, order: str = TS, bucket: Column | None = None) -> DataFrame:
    """Add the 1-based row position and the row count of the series."""
    return running(df, [Running(POSITION, "position"), Running(TOTAL, "total")], keys, order, bucket)


def _spread(rows: DataFrame, place: Column, size: int, before: int, after: int) -> DataFrame:
    own = F.floor(place / size)
    homes = [F.struct(own.alias("chunk"), F.lit(False).alias("copy"))]
    if before:
        homes.append(F.when(place >= (own + 1) * size - before, F.struct((own + 1).alias("chunk"), F.lit(True).alias("copy"))))
    if after:
        homes.append(F.when(place < own * size + after, F.struct((own - 1).alias("chunk"), F.lit(True).alias("copy"))))
    spread = rows.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    return spread.withColumn("_chunk", F.col("_home.chunk")).withColumn("_copy", F.col("_home.copy")).drop("_home")


def row_windows(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    before: int,
    after: int = 0,
    keys: Sequence[str] = ASSET,
    order: str = TS,
    chunk_rows: int = CHUNK_ROWS,
    keep_position: bool = False,
) -> DataFrame:
    """Frames that reach at most `before` rows back and `after` rows ahead."""
    rows = df if POSITION in df.columns else running(df, [Running(POSITION, "position")], keys, order)
    size = max(chunk_rows, before, after)
    spread = _spread(rows, F.col(POSITION) - 1, size, before, after)
    spec = Window.partitionBy(*keys, "_chunk").orderBy(POSITION)
    done = spread.select("*", *build(spec)).where(~F.col("_copy")).drop("_chunk", "_copy")
    return done if keep_position or POSITION in df.columns else done.drop(POSITION)


def time_windows(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    before_seconds: int,
    after_seconds: int = 0,
    keys: Sequence[str] = ASSET,
    order: str = TS,
    chunk_seconds: int = 30 * DAY_SECONDS,
) -> DataFrame:
    """Like `row_windows`, with frames measured in seconds (use `rangeBetween`)."""
    rows = df.withColumn("_seconds", epoch(order))
    size = max(chunk_seconds, before_seconds, after_seconds)
    spread = _spread(rows, F.col("_seconds"), size, before_seconds, after_seconds)
    spec = Window.partitionBy(*keys, "_chunk").orderBy("_seconds")
    return spread.select("*", *build(spec)).where(~F.col("_copy")).drop("_chunk", "_copy", "_seconds")


def grid(df: DataFrame, step: int, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Every stamp between the first and last of each series, `step` seconds apart.

    Days are expanded first and redistributed, so a long series is not
    unrolled by a single task.
    """
    ends = df.groupBy(*keys).agg(F.min(epoch(ts)).alias("_a"), F.max(epoch(ts)).alias("_z"))
    block = step * max(1, DAY_SECONDS // step)
    blocks = ends.withColumn("_start", F.explode(F.sequence("_a", "_z", F.lit(block).cast("long"))))
    blocks = blocks.repartition(*keys, "_start")
    stamps = F.sequence("_start", F.least(F.col("_start") + F.lit(block - step), F.col("_z")), F.lit(step).cast("long"))
    return blocks.select(*keys, F.explode(stamps).alias("_at")).select(*keys, from_epoch(F.col("_at")).alias(ts))


def attach(rows: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "left", salts: int = 8) -> DataFrame:
    """Join a per-series table onto rows when its size is not known to be small.

    The table is repeated once per salt and rows pick a salt by hash, so a
    series that holds a third of the rows is joined by `salts` tasks. Spark
    still turns this into a broadcast join when the table is small enough.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row."""
    keyed = one_row.withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(keyed), "_one", "left").drop("_one")


def dedup(df: DataFrame, tie: str, keys: Sequence[str] = ASSET, ts: str = TS, keep: str = "first") -> DataFrame:
    """Keep the first (or last) row by `tie` per series and stamp.

    An aggregate rather than a ranking: copies collapse before the shuffle, so
    one stamp repeated many times costs nothing.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in {*keys, ts}]
    kept = df.groupBy(*keys, ts).agg(pick(F.struct(*rest), F.col(tie)).alias("_row"))
    return kept.select(*keys, ts, "_row.*")
