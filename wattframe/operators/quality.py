"""Cleaning and audit of telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe import constants as C
from wattframe.functions.scalar import finite, load_kw, load_mw
from wattframe.operators.series import ASSET, TS, Running, dedup, epoch, grid, row_windows, running


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing measures arrive as NaN; every rule here expects null."""
    fields = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.nanvl(F.col(n).cast("double"), F.lit(None)).alias(n) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(n)
        for n, t in fields.items()
    ])


def schema_check(
    df: DataFrame, required: Sequence[str] = (TS, "load"), numeric: Sequence[str] = ("load",), optional: Sequence[str] = ("available_at",)
) -> DataFrame:
    """Findings (check_name, column_name, severity, passed, bad_rows).

    A text column counts as numeric when every value coerces; nulls in a text
    column count as not numeric.
    """
    types = dict(df.dtypes)
    text = [c for c in numeric if types.get(c) == "string"]
    counts = [F.sum(F.expr(f"try_cast(`{c}` as double)").isNull().cast("long")).alias(c) for c in text]
    measured = df.agg(*counts, F.count(F.lit(1)).alias("_rows"))
    findings = []

    def finding(check: str, column: str, severity: str, passed: Column, bad: Column) -> None:
        findings.append(F.struct(
            F.lit(check).alias("check_name"), F.lit(column).alias("column_name"), F.lit(severity).alias("severity"),
            passed.alias("passed"), bad.cast("long").alias("bad_rows"),
        ))

    for c in required:
        finding("required", c, "error", F.lit(c in types), F.lit(0))
    for c in numeric:
        if c in text:
            bad = F.coalesce(F.col(c), F.lit(0))
            finding("numeric", c, "error", bad == 0, bad)
        elif c in types:
            plain = types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal")
            finding("numeric", c, "error", F.lit(plain), F.lit(0) if plain else F.col("_rows"))
    for c in optional:
        finding("optional", c, "warning", F.lit(c in types), F.lit(0))
    return measured.select(F.explode(F.array(*findings)).alias("_f")).select("_f.*")


def ts_normalize(df: DataFrame, ts: str = TS) -> DataFrame:
    """Parse stamps and drop the rows without one. Order is left to the consumer."""
    return df.withColumn(ts, F.expr(f"try_to_timestamp(`{ts}`)")).where(F.col(ts).isNotNull())


def ts_report(df: DataFrame, ts: str = TS, keys: Sequence[str] = ASSET, sequence: str | None = None) -> DataFrame:
    """Rows in and out, span, and whether stamps never fall along `sequence`."""
    parsed = df.withColumn("_ts", F.expr(f"try_to_timestamp(`{ts}`)"))
    counted = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count("_ts").alias("rows_out"),
        F.count_if(F.col("_ts").isNull()).alias("dropped"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
    )
    if sequence is None:
        return counted
    bucket = F.floor(F.col(sequence) / 8192)
    kept = parsed.where(F.col("_ts").isNotNull()).select(*keys, sequence, "_ts")
    falls = running(kept, [Running("_before", "prev", F.col("_ts"))], keys, sequence, bucket)
    order = falls.groupBy(*keys).agg((F.count_if(F.col("_ts") < F.col("_before")) == 0).alias("monotonic"))
    return counted.join(order, list(keys), "left").withColumn("monotonic", F.coalesce("monotonic", F.lit(True)))


def duplicate_report(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS, sample: int = 10) -> DataFrame:
    """Extra rows per series, and the first repeated stamps."""
    per_stamp = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_k"))
    totals = per_stamp.groupBy(*keys).agg(
        F.sum("_k").alias("rows_in"), F.count(F.lit(1)).alias("rows_out"), (F.sum("_k") - F.count(F.lit(1))).alias("duplicates")
    )
    return totals.join(first_stamps(per_stamp.where(F.col("_k") > 1), keys, ts, sample), list(keys), "left")


def first_stamps(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS, sample: int = 10, name: str = "sample_stamps") -> DataFrame:
    """The first few stamps per series as one text; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    few = df.select(*keys, ts).withColumn("_r", rank).where(F.col("_r") <= sample)
    text = F.date_format(ts, "yyyy-MM-dd HH:mm")
    return few.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias(name))


def missing_stamps(df: DataFrame, step: int = C.STEP_SECONDS, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Grid stamps that no row has."""
    return grid(df, step, keys, ts).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def gap_detect(df: DataFrame, step: int = C.STEP_SECONDS, keys: Sequence[str] = ASSET, ts: str = TS, sample: int = 10) -> DataFrame:
    """Expected against present stamps, irregular deltas, first missing stamps.

    Stamps must be unique per series. A single row expects itself.
    """
    delta = running(df.select(*keys, ts), [Running("_before", "prev", F.col(ts))], keys, ts)
    gap = epoch(ts) - epoch("_before")
    stats = delta.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actual"), F.min(epoch(ts)).alias("_a"), F.max(epoch(ts)).alias("_z"),
        F.count_if(gap != step).alias("irregular_deltas"),
    )
    absent = missing_stamps(df, step, keys, ts)
    missing = absent.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    joined = stats.join(missing, list(keys), "left").join(first_stamps(absent, keys, ts, sample, "missing_sample"), list(keys), "left")
    expected = (F.floor((F.col("_z") - F.col("_a")) / step) + 1).cast("long")
    count = F.coalesce("missing", F.lit(0))
    return joined.select(
        *keys, expected.alias("expected"), "actual", count.alias("missing"), (count / expected * 100).alias("missing_pct"),
        "irregular_deltas", "missing_sample",
    )


def fill_bounded(
    df: DataFrame, value: str = "load", limit: int = C.MAX_FILL_STEPS, keys: Sequence[str] = ASSET, ts: str = TS
) -> DataFrame:
    """Forward fill over at most `limit` rows, marking what was filled."""
    rows = df.withColumn(value, finite(value))
    filled = row_windows(
        rows, lambda w: [F.last(value, ignorenulls=True).over(w.rowsBetween(-limit, 0)).alias("_filled")], before=limit, keys=keys, order=ts
    )
    missing = F.col(value).isNull()
    return filled.withColumn("is_imputed", missing & F.col("_filled").isNotNull()).withColumn(
        "is_unresolved", F.col("_filled").isNull()
    ).withColumn(value, F.col("_filled")).drop("_filled")


def null_policy(df: DataFrame, policy: str = "forward_fill_max_gap", value: str = "load", limit: int = C.MAX_FILL_STEPS) -> DataFrame:
    """leave_as_null, drop, or forward_fill_max_gap."""
    if policy == "forward_fill_max_gap":
        return fill_bounded(df, value, limit)
    rows = df.withColumn(value, finite(value)).withColumn("is_imputed", F.lit(False))
    if policy == "leave_as_null":
        return rows.withColumn("is_unresolved", F.col(value).isNull())
    if policy == "drop":
        return rows.where(F.col(value).isNotNull()).withColumn("is_unresolved", F.lit(False))
    raise ValueError(f"unknown missing value policy {policy!r}")


def null_policy_report(df: DataFrame, value: str = "load", keys: Sequence[str] = ASSET) -> DataFrame:
    missing = finite(value).isNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(missing).alias("left_null"), F.count_if(~missing).alias("rows_after_drop"),
        F.count_if(missing).alias("dropped"),
    )


def range_limits(df: DataFrame) -> DataFrame:
    """Plausible limits by asset group, one row per group."""
    rows = [(g, *(C.LOAD_LIMITS_RATIO if g in C.RATIO_GROUPS else C.LOAD_LIMITS_WATTS)) for g in C.ASSET_GROUPS]
    return df.sparkSession.createDataFrame(rows, "group_name string, plausible_min double, plausible_max double")


def range_flags(df: DataFrame, value: str = "load", limits: DataFrame | None = None) -> DataFrame:
    """Out-of-range and reverse-flow flags; the limits depend on the asset group."""
    # The built-in limits are five rows; the size of a supplied table is unknown, so Spark decides there.
    joined = df.join(F.broadcast(range_limits(df)) if limits is None else limits, "group_name", "left")
    v = F.col(value)
    out = F.coalesce(~v.between(F.col("plausible_min"), F.col("plausible_max")), F.lit(False))
    return joined.withColumn("is_out_of_range", out).withColumn(
        "is_reverse_flow", F.coalesce(v < 0, F.lit(False))
    ).select(*df.columns, "is_out_of_range", "is_reverse_flow")


def range_report(df: DataFrame, value: str = "load", keys: Sequence[str] = ASSET) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if("is_out_of_range").alias("out_of_range"), F.count_if("is_reverse_flow").alias("reverse_flow"),
        F.min(value).alias("observed_min"), F.max(value).alias("observed_max"),
    )


CANONICAL = (
    TS, "asset_id", "group_name", "load", "demand_mw", "demand_kw", "available_at", "is_imputed", "is_out_of_range", "is_reverse_flow",
)


def canonicalize(df: DataFrame, tie: str, policy: str = "forward_fill_max_gap") -> DataFrame:
    """Raw telemetry to the canonical table: one row per asset and stamp, filled, flagged, in MW and kW."""
    require_columns(df, ["asset_id", "group_name", TS, "load", tie])
    rows = dedup(ts_normalize(nan_to_null(df)), tie)
    rows = range_flags(null_policy(rows, policy))
    rows = rows.withColumn("demand_mw", load_mw("load", "group_name")).withColumn("demand_kw", load_kw("load", "group_name"))
    first = [c for c in CANONICAL if c in rows.columns]
    rest = [c for c in rows.columns if c not in {*first, tie, "is_unresolved"}]
    return rows.select(*first, *rest)


def quality_report(raw: DataFrame, tie: str, keys: Sequence[str] = ASSET) -> DataFrame:
    """One nested audit record per series: rows, retention and six check blocks."""
    parsed = raw.withColumn(TS, F.expr(f"try_to_timestamp(`{TS}`)"))
    rows_in = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col(TS).isNull()).alias("invalid_stamps"),
        F.count(TS).alias("_stamped"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
    )
    unique = dedup(parsed.where(F.col(TS).isNotNull()), tie, keys)
    flagged = range_flags(fill_bounded(unique, keys=keys))
    checks = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_out"), F.count_if("is_imputed").alias("imputed"), F.count_if("is_unresolved").alias("unresolved"),
        F.count_if("is_out_of_range").alias("out_of_range"), F.count_if("is_reverse_flow").alias("reverse_flow"),
        F.min("load").alias("observed_min"), F.max("load").alias("observed_max"),
    )
    gaps = gap_detect(unique, keys=keys)
    joined = rows_in.join(checks, list(keys), "left").join(gaps, list(keys), "left")
    return joined.select(
        *keys, "rows_in", "rows_out", (F.col("rows_out") / F.col("rows_in") * 100).alias("retention_pct"),
        F.struct("first_ts", "last_ts", "invalid_stamps").alias("stamps"),
        F.struct((F.col("_stamped") - F.col("rows_out")).alias("extra_rows")).alias("duplicates"),
        F.struct("expected", "missing", "missing_pct", "irregular_deltas", "missing_sample").alias("gaps"),
        F.struct("imputed", "unresolved").alias("missing_values"),
        F.struct("out_of_range", "reverse_flow").alias("flags"),
        F.struct("observed_min", "observed_max").alias("observed"),
    )


# --- wide source ----------------------------------------------------------


def series_quality(df: DataFrame, generation: Sequence[str], capacity: dict[str, str | None], step: int, ts: str = "utc_timestamp") -> DataFrame:
    """Audit of a wide frame: stamps, steps, missing values, capacity coverage (one row)."""
    matched = [c for c in dict.fromkeys(capacity.values()) if c]
    parsed = df.withColumn("_ts", F.expr(f"try_to_timestamp(`{ts}`)"))
    stamps = parsed.where(F.col("_ts").isNotNull()).groupBy("_ts").agg(F.count(F.lit(1)).alias("_k"))
    steps = running(stamps.withColumn("_one", F.lit(1)), [Running("_before", "prev", F.col("_ts"))], ["_one"], "_ts")
    delta = epoch("_ts") - epoch("_before")
    timing = steps.agg(
        F.sum(F.col("_k") - 1).alias("duplicate_stamps"), F.count_if(delta != step).alias("irregular_steps"),
        F.coalesce(F.sum(F.when(delta > step, F.greatest(F.floor(delta / step) - 1, F.lit(0)))), F.lit(0)).alias("missing_steps"),
        F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
    )
    nulls = lambda names: sum((F.count_if(finite(c).isNull()) for c in names), F.lit(0)).cast("long")
    content = parsed.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_ts").isNull()).alias("invalid_stamps"),
        nulls(generation).alias("missing_generation"), nulls(matched).alias("missing_capacity"),
    )
    both = content.withColumn("_one", F.lit(1)).join(F.broadcast(timing.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.select(
        "*", (F.col("row_count") * len(generation)).alias("normalized_rows"),
        F.lit(sum("_solar_" in c for c in generation)).alias("solar_series"), F.lit(sum("_wind" in c for c in generation)).alias("wind_series"),
        F.lit(sum(v is not None for v in capacity.values())).alias("series_with_capacity"),
        F.lit(sum(v is None for v in capacity.values())).alias("series_without_capacity"),
    )


def strict_order_gate(df: DataFrame, ts: str = "utc_timestamp", sequence: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Violation counts: unparseable, repeated, and (along `sequence`) not increasing stamps."""
    keys = list(keys)
    parsed = df.withColumn("_ts", F.expr(f"try_to_timestamp(`{ts}`)"))
    invalid = parsed.groupBy(*keys).agg(F.count_if(F.col("_ts").isNull()).alias("invalid_stamps"), F.count(F.lit(1)).alias("row_count"))
    repeated = parsed.where(F.col("_ts").isNotNull()).groupBy(*keys, "_ts").agg(F.count(F.lit(1)).alias("_k"))
    repeated = repeated.groupBy(*keys).agg(F.sum(F.col("_k") - 1).alias("duplicate_stamps"))
    joined = invalid.join(repeated, keys, "left") if keys else _side_by_side(invalid, repeated)
    if sequence is None:
        return joined.withColumn("not_increasing", F.lit(0).cast("long"))
    series = keys or ["_one"]
    rows = parsed.where(F.col("_ts").isNotNull()).withColumn("_one", F.lit(1)).select(*dict.fromkeys([*series, sequence, "_ts"]))
    follow = running(rows, [Running("_before", "prev", F.col("_ts"))], series, sequence, F.floor(F.col(sequence) / 8192))
    falls = follow.groupBy(*series).agg(F.count_if(F.col("_ts") <= F.col("_before")).alias("not_increasing"))
    return joined.join(falls, keys, "left") if keys else _side_by_side(joined, falls.drop("_one"))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")


def enforce_order(gate: DataFrame) -> DataFrame:
    """Fail the job when `strict_order_gate` found violations."""
    broken = (F.col("invalid_stamps") > 0) | (F.col("duplicate_stamps") > 0) | (F.col("not_increasing") > 0)
    text = F.concat(F.lit("stamps rejected: "), F.to_json(F.struct("invalid_stamps", "duplicate_stamps", "not_increasing")))
    return gate.withColumn("accepted", F.when(broken, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


# --- profiles -------------------------------------------------------------


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, non-null, missing and distinct counts per column.

    Distinct values are counted by grouping (column, value) rather than with
    one distinct set per column.
    """
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    tall = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_p")).select("_p.*")
    values = tall.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_k"))
    out = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_k"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_k"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return out.select(
        "column_name", kind[F.col("column_name")].alias("data_type"), "non_null", "missing",
        (F.col("missing") / (F.col("missing") + F.col("non_null")) * 100).alias("missing_pct"), "distinct_values",
    )


def matching_words(names: Sequence[str], words: Sequence[str]) -> dict[str, list[str]]:
    hits = {n: [w for w in words if w in n.lower()] for n in names}
    return {n: found for n, found in hits.items() if found}


def column_candidates(df: DataFrame) -> DataFrame:
    """Columns whose names suggest a role, with the words that matched."""
    rows = [
        (role, column, ",".join(found))
        for role, words in C.COLUMN_KEYWORDS.items() for column, found in matching_words(df.columns, words).items()
    ]
    return df.sparkSession.createDataFrame(rows, "role string, column_name string, matched string")


def leakage_columns(df: DataFrame) -> DataFrame:
    """Profile of the columns whose names hint at future or target content."""
    hits = matching_words(df.columns, C.LEAK_KEYWORDS)
    if not hits:
        return column_profile(df, df.columns[:1]).where(F.lit(False)).withColumn("matched", F.lit(""))
    words = F.create_map(*[F.lit(x) for c, found in hits.items() for x in (c, ",".join(found))])
    return column_profile(df, list(hits)).withColumn("matched", words[F.col("column_name")])


def step_minutes(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Minutes to the previous row of the series."""
    rows = running(df.select(*keys, ts), [Running("_before", "prev", F.col(ts))], keys, ts)
    return rows.select(*keys, ts, ((epoch(ts) - epoch("_before")) / 60).alias("delta_minutes"))


def sampling_freq(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS, top: int = 15, horizons: Sequence[int] = C.HORIZONS_MINUTES) -> DataFrame:
    """Most common step sizes per series, whether each is the modal one, and how it divides the horizons."""
    counts = step_minutes(df, keys, ts).where(F.col("delta_minutes").isNotNull()).groupBy(*keys, "delta_minutes").agg(
        F.count(F.lit(1)).alias("steps")
    )
    order = Window.partitionBy(*keys).orderBy(F.col("steps").desc(), "delta_minutes")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole = [
        ((F.lit(h) / F.col("delta_minutes")) == F.floor(F.lit(h) / F.col("delta_minutes"))).alias(f"divides_{h}") for h in horizons
    ]
    return ranked.select("*", (F.col("rank") == 1).alias("is_modal"), *whole)


def coverage_summary(df: DataFrame, keys: Sequence[str] = ASSET, ts: str = TS) -> DataFrame:
    """Rows, span, median and largest gap per series; one with a single stamp has no gaps."""
    per_stamp = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_k"))
    totals = per_stamp.groupBy(*keys).agg(F.sum("_k").alias("row_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    # Gaps take few distinct values, so the median comes from their histogram.
    gaps = step_minutes(per_stamp, keys, ts).where(F.col("delta_minutes").isNotNull()).groupBy(*keys, "delta_minutes").agg(
        F.count(F.lit(1)).alias("_g")
    )
    ordered = Window.partitionBy(*keys).orderBy("delta_minutes")
    gaps = gaps.withColumn("_upto", F.sum("_g").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_all", F.sum("_g").over(Window.partitionBy(*keys))
    )
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    at = lambda r: F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_g") <= r), F.col("delta_minutes")))
    stats = gaps.groupBy(*keys).agg(
        ((at(low) + at(high)) / 2).alias("median_gap"), F.max("delta_minutes").alias("largest_gap"), F.sum("_g").alias("intervals")
    )
    return totals.join(stats, list(keys), "left").withColumn("intervals", F.coalesce("intervals", F.lit(0).cast("long")))


def dup_keys(df: DataFrame, key_sets: dict[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first per key set. Each set is one grouped count, not one big distinct."""
    parts = []
    for name, keys in key_sets.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
        parts.append(per_key.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicates")).select(F.lit(name).alias("key_set"), "duplicates"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_profile(df: DataFrame, value: str, keys: Sequence[str], few: int = 5) -> DataFrame:
    """Sign counts, spread, and the smallest and largest values per group (median: see `quantiles`)."""
    v = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"),
        F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    out = stats
    for name, order in (("smallest", v.asc()), ("largest", v.desc())):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        ends = df.where(v.isNotNull()).select(*keys, value).withColumn("_r", rank).where(F.col("_r") <= few)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: F.format_string("%.4f", x[value]))
        out = out.join(ends.groupBy(*keys).agg(F.array_join(listed, ",").alias(name)), list(keys), "left")
    return out


def leakage_audit(df: DataFrame, value: str, lag_column: str, keys: Sequence[str] = ASSET, ts: str = TS, tolerance: float = 1e-10) -> DataFrame:
    """Rows whose lag column differs from the previous value, over all rows."""
    rows = running(df, [Running("_before", "prev", F.col(value))], keys, ts)
    off = F.abs(F.col(lag_column) - F.col("_before")) > tolerance
    return rows.groupBy(*keys).agg(
        F.count_if(F.col(lag_column).isNotNull() & F.col("_before").isNotNull()).alias("checked"), F.count_if(off).alias("violations")
    )
