"""Joins in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.operators.series import ASSET, DAY_SECONDS, POSITION, TS, Running, dedup, epoch, positions, running
from wattframe.session import cut_lineage

MERGED_ROWS = 250_000  # of a task that carries known values along merged stamps


def one_per_stamp(weather: DataFrame, keys: Sequence[str], ts: str = TS, tie: str | None = None, keep: str = "first") -> DataFrame:
    """One whole row per series and stamp: the first or last by `tie`, or the smallest (first) or largest (last) row without one."""
    if tie is not None:
        return dedup(weather, tie, keys, ts, keep).drop(tie)
    rest = [c for c in weather.columns if c not in {*keys, ts}]
    pick = F.min if keep == "first" else F.max
    return weather.groupBy(*keys, ts).agg(pick(F.struct(*rest)).alias("_row")).select(*keys, ts, "_row.*") if rest else weather.select(*keys, ts).distinct()


def weather_left(df: DataFrame, weather: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS, tie: str | None = None) -> DataFrame:
    """Equi-join on asset and stamp, only with columns the rows do not have yet. Repeated weather rows never multiply rows; the first counts."""
    on = [k for k in keys if k in weather.columns]
    weather = one_per_stamp(weather, on, ts, tie)
    fresh = [c for c in weather.columns if c in {*on, ts} or c not in df.columns]
    return df.join(weather.select(*fresh), [*on, ts], "left")


def interp_join(rows: DataFrame, weather: DataFrame, columns: Sequence[str], keys: Sequence[str] = ASSET, ts: str = TS, tie: str | None = None) -> DataFrame:
    """Attach weather interpolated linearly in time to the stamps of `rows`.

    Both grids are merged per asset and each stamp sees the known value at or
    before and at or after it. After the last known value it is held; before
    the first it is null. Of repeated weather stamps the first row counts.

    Both grids are written once, then dealt by series and day to as many tasks
    as their rows need, so what a task holds does not grow with the input.
    """
    keys = list(keys)
    weather = one_per_stamp(weather.select(*keys, ts, *columns, *([tie] if tie else [])), keys, ts, tie)
    stamps = rows.select(*keys, ts).withColumn("_row", F.lit(1))
    both = cut_lineage(stamps.unionByName(weather.select(*keys, ts, *columns), allowMissingColumns=True))
    dealt = both.withColumn("_day", F.floor(epoch(ts) / DAY_SECONDS)).repartition(1 + both.count() // MERGED_ROWS, *keys, "_day")
    merged = dealt.groupBy(*keys, "_day", ts).agg(F.max("_row").alias("_row"), *[F.max(c).alias(c) for c in columns])
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), epoch(ts).alias("t")))
    around = running(merged, [m for c in columns for m in (Running(f"_a_{c}", "last", known(c)), Running(f"_z_{c}", "next", known(c)))], keys, ts, F.col("_day"))
    now = epoch(ts)

    def between(c: str):
        a, z = F.col(f"_a_{c}"), F.col(f"_z_{c}")
        share = (now - a["t"]) / (z["t"] - a["t"])
        return (
            F.when(a.isNull(), None).when(z.isNull() | (a["t"] == z["t"]), a["v"]).otherwise(a["v"] + (z["v"] - a["v"]) * share)
        ).alias(c)

    filled = around.where(F.col("_row") == 1).select(*keys, ts, *[between(c) for c in columns])
    return rows.drop(*[c for c in columns if c in rows.columns]).join(filled, [*keys, ts], "left")


def asof_join(
    decisions: DataFrame, facts: DataFrame, decided_at: str, available_at: str, columns: Sequence[str], keys: Sequence[str] = ASSET
) -> DataFrame:
    """For each decision the newest fact available by then.

    Both sides are merged on one timeline and the last known fact is carried
    forward, which is linear in the rows; an inequality join compares all
    pairs of a series. Of facts available at the same time the one with the
    largest values (compared column by column) is used.
    """
    keys = list(keys)
    fact = F.struct(*columns)
    seen = facts.groupBy(*keys, F.col(available_at).alias("_at")).agg(F.max(F.struct(F.col(available_at).alias(available_at), fact.alias("f"))).alias("_fact"))
    asked = decisions.select(*keys, F.col(decided_at).alias("_at")).distinct()
    line = seen.join(asked.withColumn("_asked", F.lit(True)), [*keys, "_at"], "full_outer")
    carried = running(line, [Running("_known", "last", F.col("_fact"))], keys, "_at").where(F.col("_asked"))
    found = carried.select(
        *keys, F.col("_at").alias(decided_at), F.col(f"_known.{available_at}").alias(f"known_{available_at}"),
        *[F.col(f"_known.f.{c}").alias(c) for c in columns],
    )
    return decisions.join(found, [*keys, decided_at], "left")


def versioned_asof(
    decisions: DataFrame, revisions: DataFrame, columns: Sequence[str], valid_at: str = "valid_at", decided_at: str = "decided_at", available_at: str = "available_at",
    step: int = 3600, keys: Sequence[str] = ASSET,
) -> DataFrame:
    """For each decision the newest revision, available by then, of the values that hold at its valid time.

    Two time axes: the valid time picks the slot of `step` seconds that both sides share, the availability picks the revision within it. Slots are series of
    their own in one merge, in which the last known revision is carried along the availability; a revision issued after the decision is never seen, even if it holds for an
    earlier time. A decision without a valid or decision time, or without a revision in time, has null columns.
    """
    slot = "_slot"
    slotted = lambda df: df.withColumn(slot, F.floor(epoch(valid_at) / step))
    facts = slotted(revisions.select(*keys, valid_at, available_at, *columns)).where(F.col(slot).isNotNull() & F.col(available_at).isNotNull()).drop(valid_at)
    asked = slotted(decisions.drop(*[c for c in columns if c in decisions.columns]))
    return asof_join(asked, facts, decided_at, available_at, columns, [*keys, slot]).drop(slot)


def asof_history(df: DataFrame, origins: DataFrame, origin: str = "origin", rows: int = C.DAY_STEPS, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """The trailing `rows` rows up to each origin, as (origin, offset, ...) with offset 0 the newest.

    The origin is placed on the row positions, so the history is an equi-join.
    """
    keys = list(keys)
    numbered = positions(df, keys, ts)
    placed = asof_join(origins.select(*keys, origin), numbered.select(*keys, ts, POSITION), origin, ts, [POSITION], keys)
    wanted = placed.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(POSITION, F.col(POSITION) - F.col("offset"))
    return wanted.select(*keys, origin, "offset", POSITION).join(numbered, [*keys, POSITION])


def history_depth(history: DataFrame, origins: DataFrame, needed: int = C.DAY_STEPS, origin: str = "origin", keys: Sequence[str] = ASSET) -> DataFrame:
    """How many rows each origin has, and the error when there are too few."""
    depth = history.groupBy(*keys, origin).agg(F.count(F.lit(1)).alias("available_rows"), F.max(TS).alias("newest_ts"))
    joined = origins.select(*keys, origin).join(depth, [*keys, origin], "left").withColumn("available_rows", F.coalesce("available_rows", F.lit(0)))
    return joined.withColumn("error_code", F.when(F.col("available_rows") < needed, "INSUFFICIENT_HISTORY"))


def expected_actual(predicted: DataFrame, actual: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    return predicted.join(actual, [*keys, ts])


def aligned_check(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows only on one side, and the verdict."""
    left = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_a"))
    right = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_b"))
    both = left.join(right, list(on), "full_outer")
    only_a = F.sum(F.greatest(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)), F.lit(0)))
    only_b = F.sum(F.greatest(F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0)), F.lit(0)))
    counted = both.agg(F.coalesce(only_a, F.lit(0)).alias("only_left"), F.coalesce(only_b, F.lit(0)).alias("only_right"))
    return counted.withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def feature_attach(rows: DataFrame, features: DataFrame, names: Sequence[str], on: Sequence[str] = (*ASSET, TS)) -> DataFrame:
    fresh = [n for n in names if n in features.columns and n not in rows.columns]
    return rows.join(features.select(*on, *fresh), list(on), "left")
