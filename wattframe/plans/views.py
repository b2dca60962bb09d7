"""Bindings: the given tables seen as telemetry, weather, generation and dispatch tables.

An asset is an event type within a block of one hundred users, so the number of
assets grows with the data. Event values become loads in W, the numeric payload
becomes weather and expectations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.operators.diagnose import classify_deviation, performance
from wattframe.operators.series import Running, epoch, floor_time, from_epoch, grid, positions, row_windows, running
from wattframe.operators.splits import chronological_split
from wattframe.plans.registry import Tables

# Load per unit of event value; not a round number, so that rounded results do not sit on ties.
WATTS_PER_UNIT = 98765.4321
MW_PER_UNIT = 0.0987654321
ZONE_SCALE = 0.987654321
PAYLOAD_SCALE = 1.00123456789


def raw(t: Tables, rows: Column | None = None) -> DataFrame:
    """All telemetry, or the part a condition on the stored columns selects."""
    events = t.read("events") if rows is None else t.read("events").where(rows)
    stamp = F.col("ts").cast("timestamp")
    zone = F.expr("user_id div 100")
    kind = F.col("event_type")
    group = (
        F.when(kind == "view", "mv_feeder").when(kind == "click", "transformer").when(kind == "error", "solar_park")
        .when(kind == "purchase", "wind_park").otherwise("station_installation")
    )
    return events.select(
        F.col("event_id").alias("tie"),
        F.concat_ws("-", kind, zone.cast("string")).alias("asset_id"),
        group.alias("group_name"),
        zone.alias("zone_id"),
        kind.alias("kind"),
        stamp.alias("event_time"),
        floor_time("ts", 900).alias("timestamp"),
        ((F.col("value") - 20) * WATTS_PER_UNIT).alias("load"),
        "value",
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * PAYLOAD_SCALE).alias("k"),
        F.timestamp_micros(F.unix_micros(stamp) + (F.col("event_id") % 7) * 1_200_000_000).alias("available_at"),
    )


def load(t: Tables) -> DataFrame:
    return raw(t).groupBy("asset_id", "timestamp").agg(F.avg("load").alias("load"), F.min("group_name").alias("group_name"))


def dense(t: Tables) -> DataFrame:
    rows = load(t)
    return grid(rows, 900).join(rows.select("asset_id", "timestamp", "load"), ["asset_id", "timestamp"], "left")


def demand(t: Tables) -> DataFrame:
    return load(t).select("asset_id", "timestamp", (F.col("load") / 1e6).alias("demand_mw"))


def weather(t: Tables) -> DataFrame:
    k = F.avg("k")
    return raw(t).groupBy("asset_id", floor_time("event_time", 3600).alias("timestamp")).agg(
        k.alias("cloud_cover"), (k / 4).alias("wind_speed_10m"), (k / 3 - 5).alias("temperature_2m"),
        (40 + k / 2).alias("relative_humidity_2m"), (980 + k / 2).alias("surface_pressure"),
        (k * 3.6).alias("wind_direction_10m"), (k * 8).alias("shortwave_radiation"),
    )


def weather_revisions(t: Tables) -> DataFrame:
    """Forecasts for the hour of each event, issued up to four hours ahead or somewhat late, and issued anew."""
    hour = floor_time("event_time", 3600)
    ahead = F.col("tie") % 5 * 3600 - F.when(F.col("tie") % 11 == 0, 1800).otherwise(0)
    return raw(t).select(
        "asset_id", hour.alias("valid_at"), from_epoch(epoch(hour) - ahead).alias("available_at"), F.col("k").alias("cloud_cover"), (F.col("k") / 3 - 5).alias("temperature_2m")
    )


def pair(t: Tables) -> DataFrame:
    kind = F.min("kind")
    asset_type = F.when(kind.isin("error", "view"), "solar").when(kind == "signup", "hydro").otherwise("wind")
    return raw(t).groupBy("asset_id", "timestamp").agg(
        asset_type.alias("asset_type"),
        (F.greatest(F.lit(0.0), F.avg("k") - 10) * MW_PER_UNIT).alias("expected_mw"),
        (F.avg(F.col("value") - 1) * MW_PER_UNIT).alias("actual_mw"),
    ).select("asset_id", "asset_type", "timestamp", "expected_mw", "actual_mw")


def perf(t: Tables) -> DataFrame:
    return performance(pair(t))


def diagnosis(t: Tables) -> DataFrame:
    return classify_deviation(perf(t), weather(t), keep_evidence=True)


def hourly(t: Tables) -> DataFrame:
    kind = F.min("kind")
    return raw(t).groupBy("asset_id", floor_time("event_time", 3600).alias("timestamp")).agg(
        F.when(kind.isin("view", "error"), "solar").otherwise("wind").alias("energy_type"),
        (F.avg("value") * 0.987654321).alias("actual_mw"),
        F.when(kind.isin("view", "click"), 400 + F.avg("k")).alias("capacity_mw"),
    )


def hourly_perf(t: Tables) -> DataFrame:
    return row_windows(
        hourly(t), lambda w: [F.avg("actual_mw").over(w.rowsBetween(-24, -1)).alias("expected_mw")], before=24
    )


WIDE_GENERATION = {
    "DE_solar_generation_actual": "view", "DE_wind_onshore_generation_actual": "click",
    "AT_wind_offshore_generation_actual": "error", "NL_wind_generation_actual": "purchase",
}


def wide(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return t.read("events").groupBy(floor_time("ts", 3600).alias("utc_timestamp")).agg(
        *[F.avg(F.when(kind == event, value)).alias(name) for name, event in WIDE_GENERATION.items()],
        F.max(F.when(kind == "signup", value)).alias("DE_solar_capacity"),
        F.max(F.when((kind == "signup") & (value > 60), value)).alias("NL_wind_capacity"),
    )


def numbered(t: Tables) -> DataFrame:
    return positions(demand(t))


def split(t: Tables) -> DataFrame:
    return chronological_split(demand(t))


def growth(t: Tables) -> DataFrame:
    return running(demand(t), [Running("next_mw", "lead", F.col("demand_mw"))])


def zones(t: Tables) -> DataFrame:
    kind, value = F.col("kind"), F.col("value")
    return raw(t).groupBy(
        "zone_id", floor_time("event_time", 3600).alias("hour"), F.expr("minute(event_time) div 15").alias("period")
    ).agg(
        (F.avg(value) * ZONE_SCALE).alias("v"), F.avg("k").alias("k"), (F.avg(F.when(kind == "view", value)) * ZONE_SCALE).alias("solar_v"),
        (F.avg(F.when(kind == "click", value)) * ZONE_SCALE).alias("wind_v"), F.max(value).alias("peak_v"), F.count(F.lit(1)).alias("n"),
    )


def _scenario_id() -> Column:
    return F.concat(F.col("zone_id").cast("string"), F.lit("@"), F.date_format("hour", "yyyy-MM-dd'T'HH"))


def scenario_periods(t: Tables) -> DataFrame:
    return zones(t).select(
        _scenario_id().alias("scenario_id"), "period", F.col("hour").alias("start_time"),
        (90 + F.col("v")).alias("demand_mw"), F.coalesce("solar_v", F.lit(5.0)).alias("solar_mw"),
        F.coalesce("wind_v", F.lit(4.0)).alias("wind_mw"), (40 + F.col("k") / 3).alias("other_generation_mw"),
        (4 + F.col("k") / 10).alias("ev_demand_mw"), (10 + F.col("k") / 5).alias("industrial_demand_mw"),
    )


def resources(t: Tables) -> DataFrame:
    low, high, peak = F.min("k"), F.max("k"), F.max("peak_v")
    return zones(t).groupBy("zone_id", "hour").agg(
        (150 + F.avg("v")).alias("grid_capacity_mw"), (5 + F.avg("k") / 2).alias("current_soc_mwh"),
        F.when(peak > 300, 20.0).otherwise(50.0).alias("max_soc_mwh"),
        F.when(low < 5, 0.0).otherwise(20.0).alias("max_discharge_mw"),
        F.when(peak > 200, 0.6).otherwise(0.9).alias("efficiency"),
        F.when(high > 98, 0.0).otherwise(0.4).alias("ev_fraction"),
        F.when(low < 20, 6.0).otherwise(12.0).alias("ind_cap_mw"),
    ).select(
        _scenario_id().alias("scenario_id"), "grid_capacity_mw", "current_soc_mwh", F.lit(5.0).alias("min_soc_mwh"), "max_soc_mwh",
        F.lit(20.0).alias("max_charge_mw"), "max_discharge_mw", "efficiency", F.lit(12.0).alias("ev_current_mw"), "ev_fraction",
        F.lit(60).alias("ev_window"), F.lit(28.0).alias("ind_current_mw"), F.lit(0.3).alias("ind_fraction"), "ind_cap_mw",
        F.lit(120).alias("ind_window"),
    )


def candidate_plans(t: Tables) -> DataFrame:
    """Four candidate schedules for every scenario."""
    p, name = F.col("period"), F.col("plan_id")
    rows = scenario_periods(t).join(resources(t).select("scenario_id", "ev_fraction", "ind_fraction"), "scenario_id")
    rows = rows.withColumn("plan_id", F.explode(F.array(*[F.lit(x) for x in ("idle", "store", "release", "mixed")])))
    return rows.select(
        "scenario_id", "plan_id", "period",
        F.when(name == "store", 6.0 + p).when((name == "mixed") & (p < 2), 3.0).otherwise(0.0).alias("charge_mw"),
        F.when(name == "release", 5.0 + F.col("ind_fraction") * p).when((name == "mixed") & (p >= 1), 4.0).otherwise(0.0).alias("discharge_mw"),
        F.when(name == "release", F.col("ev_fraction") * F.col("ev_demand_mw")).otherwise(0.0).alias("ev_shift_mw"),
        F.when(name == "release", 2.5).when(name == "mixed", 1.0).otherwise(0.0).alias("ind_shift_mw"),
        F.when(name == "idle", F.col("solar_mw") / 4).when(name == "mixed", F.col("wind_mw") / 8).otherwise(0.0).alias("curtail_mw"),
    )


def impossible_plans(t: Tables) -> DataFrame:
    """The candidates and three that cannot be carried out: one leaves a period out, one charges less than nothing, one acts in a period that no scenario has."""
    plans = candidate_plans(t)
    other = lambda name, base: plans.where(F.col("plan_id") == base).withColumn("plan_id", F.lit(name))
    beyond = other("beyond", "idle").withColumn("curtail_mw", F.col("curtail_mw") + 0.0625)  # small differences, so no two plans of a scenario cost the same
    far = beyond.where("period = 0").withColumns({"period": F.lit(7).cast("long"), "discharge_mw": F.lit(900.0), "curtail_mw": F.lit(0.0)})
    gaps = other("gaps", "mixed").where("period <> 2").withColumn("ev_shift_mw", F.lit(0.125))
    drain = other("drain", "store").withColumns({"charge_mw": F.when(F.col("period") == 1, -3.0).otherwise(F.col("charge_mw")), "ind_shift_mw": F.lit(0.0625)})
    return plans.unionByName(gaps).unionByName(drain).unionByName(beyond).unionByName(far)


def partial_resources(t: Tables) -> DataFrame:
    """Resources of which a fifth has no grid capacity, a fifth no battery, and a fifth of the scenarios none at all."""
    rows, kind = resources(t), F.floor("current_soc_mwh") % 5
    battery = ("current_soc_mwh", "min_soc_mwh", "max_soc_mwh", "max_charge_mw", "max_discharge_mw", "efficiency")
    return rows.where(kind != 1).withColumns({
        "grid_capacity_mw": F.when(kind != 0, F.col("grid_capacity_mw")), **{c: F.when(kind != 2, F.col(c)) for c in battery},
    })


def statuses(t: Tables) -> DataFrame:
    return perf(t).select(
        "asset_id", F.substring_index("asset_id", "-", -1).alias("zone_id"), "asset_type", "timestamp", "expected_mw", "actual_mw",
        "performance_ratio", "percentage_deviation", F.coalesce(F.col("performance_ratio") < 0.5, F.lit(True)).alias("anomaly"),
    )
