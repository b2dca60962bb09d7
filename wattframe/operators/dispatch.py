"""Evaluation of dispatch schedules against a period table and a resource table.

Periods: scenario_id, period, demand, solar, wind, other, EV and industrial MW.
Schedules: scenario_id, plan_id, period, and the five chosen MW columns.
A scenario has a handful of periods, so windows per scenario stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe import constants as C

TOLERANCE = 1e-6
PLAN = ("scenario_id", "plan_id")
ACTIONS = ("charge_mw", "discharge_mw", "ev_shift_mw", "ind_shift_mw", "curtail_mw")
RESOURCE_LIMITS = ("max_charge_mw", "max_discharge_mw", "min_soc_mwh", "max_soc_mwh", "current_soc_mwh", "ev_fraction", "ind_fraction")
HOURS = 0.25


def renewable() -> Column:
    return F.col("solar_mw") + F.col("wind_mw")


def dispatch_before(periods: DataFrame, resources: DataFrame) -> DataFrame:
    """Averages over periods without any action, surplus, and stress."""
    averages = periods.groupBy("scenario_id").agg(
        F.avg("demand_mw").alias("demand_mw"), F.avg(renewable()).alias("renewable_mw"), F.avg("other_generation_mw").alias("_other")
    ).join(resources.select("scenario_id", "grid_capacity_mw"), "scenario_id")
    zero = F.lit(0.0)
    usable = F.least(F.col("renewable_mw"), F.greatest(zero, F.col("demand_mw") - F.col("_other")))
    net = F.greatest(zero, F.col("demand_mw") - F.col("renewable_mw") - F.col("_other"))
    simple = F.greatest(zero, F.col("demand_mw") - F.col("renewable_mw"))
    share = lambda x: F.when(F.col("grid_capacity_mw") <= 0, 1.0).otherwise(F.least(F.lit(1.0), x / F.col("grid_capacity_mw")))
    return averages.select(
        "scenario_id", "demand_mw", "renewable_mw", usable.alias("usable_renewable_mw"),
        F.greatest(zero, F.col("renewable_mw") - usable).alias("curtailment_mw"), share(net).alias("grid_stress"),
        share(simple).alias("snapshot_stress"),
    )


def flexibility() -> Column:
    ev = F.col("ev_current_mw") * F.col("ev_fraction")
    industrial = F.least(F.col("ind_current_mw") * F.col("ind_fraction"), F.col("ind_cap_mw"))
    return sum((F.coalesce(c, F.lit(0.0)) for c in (F.col("max_discharge_mw"), ev, industrial)), F.lit(0.0))


def infeasibility_report(periods: DataFrame, resources: DataFrame) -> DataFrame:
    """Required balancing, flexibility, deficit, and the limits that bind, in period order."""
    supply = F.col("other_generation_mw") + renewable()
    rows = periods.join(resources, "scenario_id")
    short = F.when(supply < F.col("demand_mw"), F.concat(
        F.lit("Period "), F.col("period"), F.lit(": supply ("), F.format_string("%.1f", supply), F.lit(" MW) < demand ("),
        F.format_string("%.1f", F.col("demand_mw")), F.lit(" MW)")))
    over = F.when((F.col("grid_capacity_mw") > 0) & (supply > F.col("grid_capacity_mw")), F.concat(
        F.lit("Period "), F.col("period"), F.lit(": generation ("), F.format_string("%.1f", supply), F.lit(" MW) exceeds grid capacity ("),
        F.format_string("%.1f", F.col("grid_capacity_mw")), F.lit(" MW)")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("period", c.alias("text"))))), lambda x: x["text"])
    grouped = rows.groupBy("scenario_id").agg(
        F.avg("demand_mw").alias("_demand"), F.avg(supply).alias("_supply"), listed(short).alias("_short"), listed(over).alias("_over"),
        F.first(flexibility()).alias("available_flexibility_mw"), F.first("current_soc_mwh").alias("_soc"), F.first("min_soc_mwh").alias("_min"),
        F.first("max_discharge_mw").alias("_rate"), F.first("ev_fraction").alias("_ev"), F.first("ind_fraction").alias("_ind"),
    )
    room = F.greatest(F.lit(0.0), F.col("_soc") - F.col("_min"))
    fixed = F.array_compact(F.array(
        F.when(room < 1.0, F.concat(F.lit("Battery SOC near minimum: only "), F.format_string("%.2f", room), F.lit(" MWh available"))),
        F.when(F.col("_rate") == 0, "Battery discharge disabled"), F.when(F.col("_ev") == 0, "EV flexibility is zero"),
        F.when(F.col("_ind") == 0, "Industrial flexibility is zero"),
    ))
    required = F.greatest(F.lit(0.0), F.col("_demand") - F.col("_supply"))
    return grouped.select(
        "scenario_id", required.alias("required_balancing_mw"), "available_flexibility_mw",
        F.greatest(F.lit(0.0), required - F.col("available_flexibility_mw")).alias("estimated_deficit_mw"),
        F.array_join(F.concat("_short", fixed, "_over"), "; ").alias("binding_limits"),
    )


def soc_path(rows: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    """State of charge after each period; each way loses the square root of the round trip."""
    one_way = F.sqrt("efficiency")
    step = (one_way * F.col("charge_mw") - F.col("discharge_mw") / one_way) * HOURS
    path = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("soc_mwh", F.col("current_soc_mwh") + F.sum(step).over(path))


def dispatch_rows(plans: DataFrame, periods: DataFrame, resources: DataFrame) -> DataFrame:
    """Every plan over every period of its scenario and every period it lists, with resources: use, residual and state of charge.

    A period that a plan does not list has no actions and `listed` false; one that the scenario does not have has no demand or supply and `known` false. An absent resource
    has no room: its limits and state count as 0, and so does the grid of a scenario without a resource row.
    """
    ids = plans.select(*PLAN).distinct().join(periods.withColumn("known", F.lit(True)), "scenario_id")
    rows = ids.join(plans.withColumn("listed", F.lit(True)), [*PLAN, "period"], "full").join(resources, "scenario_id", "left")
    flows = ("demand_mw", "solar_mw", "wind_mw", "other_generation_mw", "ev_demand_mw", "industrial_demand_mw")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*ACTIONS, *flows, *RESOURCE_LIMITS, "grid_capacity_mw")})
    rows = rows.withColumns({"listed": F.coalesce("listed", F.lit(False)), "known": F.coalesce("known", F.lit(False)), "efficiency": F.coalesce("efficiency", F.lit(1.0))})
    used = renewable() - F.col("curtail_mw")
    residual = (F.col("demand_mw") - F.col("ev_shift_mw") - F.col("ind_shift_mw")) - (
        F.col("other_generation_mw") + used + F.col("discharge_mw") - F.col("charge_mw")
    )
    return soc_path(rows.withColumn("used_mw", used).withColumn("residual", residual))


def violation_tests() -> dict[str, Column]:
    """One test per physical limit of a schedule."""
    c = F.col
    return {
        "missing": ~c("listed"),
        "unknown": ~c("known"),
        "negative": F.least(*[c(a) for a in ACTIONS]) < -TOLERANCE,
        "soc": (c("soc_mwh") < c("min_soc_mwh") - TOLERANCE) | (c("soc_mwh") > c("max_soc_mwh") + TOLERANCE),
        "charge": c("charge_mw") > c("max_charge_mw") + TOLERANCE,
        "discharge": c("discharge_mw") > c("max_discharge_mw") + TOLERANCE,
        "both": (c("charge_mw") > TOLERANCE) & (c("discharge_mw") > TOLERANCE),
        "ev": c("ev_shift_mw") > c("ev_fraction") * c("ev_demand_mw") + TOLERANCE,
        "ind": c("ind_shift_mw") > F.least(c("ind_fraction") * c("industrial_demand_mw"), c("ind_cap_mw")) + TOLERANCE,
        "curtail": (c("curtail_mw") < -TOLERANCE) | (c("curtail_mw") > renewable() + TOLERANCE),
        "capacity": c("other_generation_mw") + c("used_mw") + c("discharge_mw") > c("grid_capacity_mw") + TOLERANCE,
    }


def dispatch_eval(rows: DataFrame) -> DataFrame:
    """Cost, deficit, limit violations and after-metrics per schedule; the metrics are means over the scenario's own periods.

    Shifted load is not returned in a later period. Unbalanced energy shows as
    deficit or oversupply with its cost; it does not make a plan infeasible.
    """
    zero, weights = F.lit(0.0), C.WEIGHTS
    deficit, over = F.greatest(F.col("residual"), zero), F.greatest(-F.col("residual"), zero)
    cost = (
        F.col("curtail_mw") * weights["curtailment"] + deficit * weights["deficit"] + over * weights["oversupply"]
        + (F.col("charge_mw") + F.col("discharge_mw")) * weights["cycling"] + F.col("ev_shift_mw") * weights["ev"]
        + F.col("ind_shift_mw") * weights["industrial"]
    )
    demand = F.col("demand_mw") - F.col("ev_shift_mw") - F.col("ind_shift_mw")
    tests = violation_tests()
    mean = lambda x: F.avg(F.when(F.col("known"), x))
    grouped = rows.groupBy(*PLAN).agg(
        F.sum(cost).alias("cost"), F.sum(deficit).alias("deficit_mw"), F.sum(over).alias("oversupply_mw"),
        *[F.count_if(test).alias(f"{name}_violations") for name, test in tests.items()],
        mean(demand).alias("after_demand_mw"), mean(F.col("used_mw")).alias("after_renewable_mw"), mean(F.col("curtail_mw")).alias("after_curtailment_mw"),
        mean(F.col("other_generation_mw")).alias("_other"), mean(F.col("discharge_mw") - F.col("charge_mw")).alias("_net"),
        F.first("grid_capacity_mw").alias("_capacity"),
    )
    net = F.greatest(zero, F.col("after_demand_mw") - F.col("after_renewable_mw") - F.col("_other") - F.col("_net"))
    stress = F.when(F.col("_capacity") <= 0, 1.0).otherwise(F.least(F.lit(1.0), net / F.col("_capacity")))
    feasible = F.lit(True)
    for name in tests:
        feasible = feasible & (F.col(f"{name}_violations") == 0)
    return grouped.withColumn("after_stress", stress).withColumn("feasible", feasible).drop("_other", "_net", "_capacity")


def violation_texts(rows: DataFrame) -> DataFrame:
    """One row per broken limit with its period."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in violation_tests().items()]))
    return rows.select(*PLAN, "period", F.explode(names).alias("violated"))


def rank_plans(evaluated: DataFrame) -> DataFrame:
    """Cheapest feasible plan per scenario; scenarios without one are reported infeasible."""
    best = F.min_by("plan_id", F.when(F.col("feasible"), F.struct("cost", "plan_id")))
    return evaluated.groupBy("scenario_id").agg(
        best.alias("plan_id"), F.min(F.when(F.col("feasible"), F.col("cost"))).alias("cost"), F.count_if("feasible").alias("feasible_plans")
    ).withColumn("status", F.when(F.col("plan_id").isNull(), "infeasible").otherwise("feasible"))


def action_window(rows: DataFrame, start: str = "start_time", minutes: int = 15) -> DataFrame:
    """First to last active period and mean active power of each action of a plan.

    An action that is never active spans the whole horizon with power 0.
    """
    actions = {
        "battery_discharge": "discharge_mw", "battery_charge": "charge_mw", "shift_ev_load": "ev_shift_mw",
        "shift_industrial_load": "ind_shift_mw", "curtail": "curtail_mw",
    }
    tall = rows.select(*PLAN, "period", start, F.explode(F.array(*[
        F.struct(F.lit(a).alias("action_type"), F.col(c).alias("mw")) for a, c in actions.items()
    ])).alias("_a")).select(*PLAN, "period", start, "_a.*")
    active = F.col("mw") > C.ACTIVE_MW
    grouped = tall.groupBy(*PLAN, "action_type").agg(
        F.coalesce(F.min(F.when(active, F.col("period"))), F.min("period")).alias("_first"),
        F.coalesce(F.max(F.when(active, F.col("period"))), F.max("period")).alias("_last"),
        F.coalesce(F.avg(F.when(active, F.col("mw"))), F.lit(0.0)).alias("power_mw"), F.min(start).alias("_t0"),
    )
    at = lambda p: F.timestamp_seconds(F.col("_t0").cast("timestamp").cast("long") + p * minutes * 60)
    return grouped.select(*PLAN, "action_type", "power_mw", at(F.col("_first")).alias("start_time"), at(F.col("_last") + 1).alias("end_time"))


def curtail_attribution(rows: DataFrame) -> DataFrame:
    """Curtailment split by the solar and wind share of energy, mean over periods."""
    grouped = rows.groupBy(*PLAN).agg(
        F.avg("curtail_mw").alias("_c"), F.sum("solar_mw").alias("_s"), F.sum("wind_mw").alias("_w")
    )
    share = lambda c: F.when(F.col("_s") + F.col("_w") > 0, F.col("_c") * F.col(c) / (F.col("_s") + F.col("_w"))).otherwise(0.0)
    return grouped.select(*PLAN, share("_s").alias("curtail_solar_mw"), share("_w").alias("curtail_wind_mw"))


def scenario_compare(evaluated: DataFrame, base: str, modified: str) -> DataFrame:
    """Two plans of each scenario side by side with their differences."""
    metrics = ("cost", "deficit_mw", "after_demand_mw", "after_curtailment_mw", "after_stress")
    side = lambda plan, tag: evaluated.where(F.col("plan_id") == plan).select("scenario_id", *[F.col(m).alias(f"{tag}_{m}") for m in metrics])
    both = side(base, "base").join(side(modified, "modified"), "scenario_id")
    return both.select(
        "*", (F.col("modified_cost") - F.col("base_cost")).alias("cost_change"), (F.col("modified_after_stress") - F.col("base_after_stress")).alias("stress_change"),
        F.greatest(F.lit(0.0), F.col("base_after_curtailment_mw") - F.col("modified_after_curtailment_mw")).alias("curtailment_saved_mw"),
    )


def scenario_table(spark) -> DataFrame:
    """The eight named scenarios, one row per period."""
    rows = []
    for name, (demand, solar, wind, other, ev, industrial, capacity, battery, has_ev, has_ind) in C.SCENARIOS.items():
        soc, rate = battery or (None, None)
        for i in range(len(demand)):
            rows.append((
                name, i, float(demand[i]), float(solar[i]), float(wind[i]), float(other), float(ev[i]), float(industrial), float(capacity),
                None if soc is None else float(soc), None if rate is None else float(rate), has_ev, has_ind,
            ))
    return spark.createDataFrame(
        rows, "scenario string, period int, demand_mw double, solar_mw double, wind_mw double, other_generation_mw double, ev_demand_mw double, "
        "industrial_demand_mw double, grid_capacity_mw double, current_soc_mwh double, max_discharge_mw double, has_ev boolean, has_industrial boolean",
    )


def scenario_resources(spark) -> DataFrame:
    """Resource row of each named scenario; an absent resource is null."""
    rows = []
    for name, s in C.SCENARIOS.items():
        battery, has_ev, has_ind = s[7], s[8], s[9]
        rows.append((
            name, float(s[6]), *((float(battery[0]), C.BATTERY_MIN_MWH, C.BATTERY_MAX_MWH, C.BATTERY_CHARGE_MW, float(battery[1]), C.BATTERY_EFFICIENCY) if battery else (None,) * 6),
            *((C.EV_DEMAND_MW, C.EV_FRACTION) if has_ev else (None, None)),
            *((C.INDUSTRIAL_DEMAND_MW, C.INDUSTRIAL_FRACTION, C.INDUSTRIAL_CAP_MW) if has_ind else (None, None, None)),
        ))
    names = (
        "grid_capacity_mw", "current_soc_mwh", "min_soc_mwh", "max_soc_mwh", "max_charge_mw", "max_discharge_mw", "efficiency",
        "ev_current_mw", "ev_fraction", "ind_current_mw", "ind_fraction", "ind_cap_mw",
    )
    return spark.createDataFrame(rows, "scenario_id string, " + ", ".join(f"{n} double" for n in names))


def scenario_set(profile: DataFrame) -> DataFrame:
    """The named scenarios driven by observed load shapes.

    `profile` holds (profile_id, period, factor); demand follows the factor.
    The scenario table has 32 rows.
    """
    table = scenario_table(profile.sparkSession)
    joined = profile.join(F.broadcast(table), "period")
    return joined.withColumn("demand_mw", F.col("demand_mw") * F.col("factor"))
