"""Record rules as tables of (broken test, message), every broken rule listed.

Records are struct-typed rows with snake_case columns; stamps are text or
timestamps. Nested arrays are checked element by element with their index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.scalar import finite, messages

Rule = tuple[Column, Column | str]


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def name_of(value: str | Column, label: str | None) -> str:
    return label or str(value)


def not_blank(value: str | Column, label: str | None = None) -> Rule:
    return F.coalesce(F.length(F.trim(_c(value))) == 0, F.lit(True)), f"{name_of(value, label)} must be a non-empty string"


def is_stamp(value: str | Column, label: str | None = None) -> Rule:
    return F.try_to_timestamp(_c(value).cast("string")).isNull(), f"{name_of(value, label)} must be a valid ISO timestamp"


def is_number(value: str | Column, label: str | None = None) -> Rule:
    return finite(_c(value)).isNull(), f"{name_of(value, label)} must be a number"


def not_negative(value: str | Column, label: str | None = None) -> Rule:
    return F.coalesce(finite(_c(value)) < 0, F.lit(True)), f"{name_of(value, label)} must be a non-negative number"


def positive(value: str | Column, label: str | None = None) -> Rule:
    return F.coalesce(finite(_c(value)) <= 0, F.lit(True)), f"{name_of(value, label)} must be a positive number"


def between(value: str | Column, low: float, high: float, label: str | None = None) -> Rule:
    v = finite(_c(value))
    return F.coalesce(~v.between(low, high), F.lit(True)), f"{name_of(value, label)} must be a number between {low:g} and {high:g}"


def one_of(value: str | Column, allowed: Sequence[str], label: str | None = None) -> Rule:
    return F.coalesce(~_c(value).isin(*allowed), F.lit(True)), f"{name_of(value, label)} must be one of: {', '.join(allowed)}"


def is_present(value: str | Column, what: str, label: str | None = None) -> Rule:
    return _c(value).isNull(), f"{name_of(value, label)} must be {what}"


def if_given(value: str | Column, rule: Rule) -> Rule:
    """A rule that only holds for values that are there."""
    return _c(value).isNotNull() & rule[0], rule[1]


def inside(parent: str, rules: Sequence[Rule]) -> list[Rule]:
    """Rules on the fields of a struct: report the missing struct, not each field."""
    return [is_present(parent, "an object"), *[(F.col(parent).isNotNull() & broken, text) for broken, text in rules]]


def each(array: str, rules: Callable[[Column], Sequence[tuple[Column, str]]]) -> Column:
    """Messages of array elements, `array[i].message`."""
    def of(item: Column, i: Column) -> Column:
        found = messages(rules(item))
        return F.transform(found, lambda m: F.concat(F.lit(f"{array}["), i.cast("string"), F.lit("]."), m))

    return F.coalesce(F.flatten(F.transform(F.col(array), of)), F.array().cast("array<string>"))


def check(df: DataFrame, rules: Sequence[Rule], nested: Sequence[Column] = ()) -> DataFrame:
    """Add `errors` (text array) and `accepted`."""
    errors = messages(rules)
    for more in nested:
        errors = F.concat(errors, more)
    return df.withColumn("errors", errors).withColumn("accepted", F.size("errors") == 0)


# --- rule tables ------------------------------------------------------------

ASSET_TYPES = ("solar", "wind", "hydro", "battery", "flexible_load")
URGENCIES = ("low", "medium", "high", "critical")
CATEGORIES = ("dispatch", "curtailment_prevention", "load_shifting", "maintenance_alert")
SOLVER_STATES = ("optimal", "feasible", "infeasible")
SPIKE_LEVELS = ("normal", "moderate", "severe")
SECTIONS = (
    "current_demand", "forecast_demand", "renewable_generation", "renewable_anomalies", "available_flexible_resources", "curtailment", "grid_stress",
)


def forecast_rules() -> tuple[list[Rule], list[Column]]:
    def point(p: Column) -> list[tuple[Column, str]]:
        low, high = p["lower_bound_mw"], p["upper_bound_mw"]
        return [
            is_stamp(p["timestamp"], "timestamp"), not_negative(p["demand_mw"], "demand_mw"),
            if_given(low, not_negative(low, "lower_bound_mw")), if_given(high, not_negative(high, "upper_bound_mw")),
            (F.coalesce(low > high, F.lit(False)), "lower_bound_mw cannot exceed upper_bound_mw"),
        ]

    rules = [
        not_blank("zone_id"), is_stamp("generated_at"), positive("horizon_minutes"),
        (F.coalesce(F.size("points") <= 0, F.lit(True)), "points must be a non-empty array"),
        *inside("spike_risk", [
            one_of("spike_risk.level", SPIKE_LEVELS), between("spike_risk.probability", 0, 1), not_negative("spike_risk.predicted_peak_mw"),
        ]),
        not_blank("model_version"),
    ]
    return rules, [each("points", point)]


def status_rules() -> list[Rule]:
    cause = "likely_root_cause"
    return [
        not_blank("asset_id"), one_of("asset_type", ASSET_TYPES), is_stamp("timestamp"), not_negative("expected_mw"), not_negative("actual_mw"),
        not_negative("performance_ratio"), is_present("anomaly", "a boolean"), if_given("anomaly_score", between("anomaly_score", 0, 1)),
        if_given(cause, not_blank(f"{cause}.category")), if_given(cause, between(f"{cause}.confidence", 0, 1)),
    ]


def weather_rules() -> list[Rule]:
    return [
        is_stamp("timestamp"),
        *inside("location", [between("location.latitude", -90, 90), between("location.longitude", -180, 180), not_blank("location.zone_id")]),
        not_negative("ghi_wm2"), is_number("temperature_celsius"), not_negative("wind_speed_ms"), between("cloud_cover_percent", 0, 100),
        if_given("dni_wm2", not_negative("dni_wm2")), if_given("dhi_wm2", not_negative("dhi_wm2")),
        if_given("wind_direction_degrees", between("wind_direction_degrees", 0, 360)),
        if_given("relative_humidity_percent", between("relative_humidity_percent", 0, 100)), is_present("is_forecast", "a boolean"),
    ]


def grid_state_rules(prefix: str = "") -> list[Rule]:
    c = lambda n: f"{prefix}{n}"
    return [
        is_stamp(c("timestamp")), not_blank(c("zone_id")), not_negative(c("demand_mw")), not_negative(c("solar_generation_mw")),
        not_negative(c("wind_generation_mw")), is_number(c("net_load_mw")), between(c("battery_soc_percent"), 0, 100),
        is_number(c("battery_power_mw")), not_negative(c("curtailment_mw")), positive(c("grid_frequency_hz")),
        between(c("grid_stress_index"), 0, 1), not_negative(c("active_alerts_count")),
    ]


def dispatch_input_rules() -> list[Rule]:
    b, f = "battery_constraints", "flexible_load_constraints"
    order = F.coalesce(F.col(f"{b}.min_soc_percent") > F.col(f"{b}.max_soc_percent"), F.lit(False))
    return [
        not_blank("scenario_id"), is_stamp("target_timestamp"), positive("horizon_minutes"), *inside("current_grid_state", grid_state_rules("current_grid_state.")),
        not_negative("renewable_forecast_mw"),
        *inside(b, [
            positive(f"{b}.max_capacity_mwh"), between(f"{b}.current_soc_percent", 0, 100), between(f"{b}.min_soc_percent", 0, 100),
            between(f"{b}.max_soc_percent", 0, 100), (order, f"{b}.min_soc_percent cannot exceed max_soc_percent"),
            not_negative(f"{b}.max_charge_power_mw"), not_negative(f"{b}.max_discharge_power_mw"), between(f"{b}.round_trip_efficiency", 0, 1),
        ]),
        *inside(f, [
            not_negative(f"{f}.total_flexible_mw"), not_negative(f"{f}.max_shift_duration_minutes"), not_negative(f"{f}.shift_cost_per_mw"),
        ]),
        not_negative("curtailment_penalty_per_mw"),
    ]


def dispatch_result_rules() -> tuple[list[Rule], list[Column]]:
    def action(a: Column) -> list[tuple[Column, str]]:
        return [
            not_blank(a["resource_id"], "resource_id"), not_blank(a["action_type"], "action_type"), not_negative(a["power_mw"], "power_mw"),
            is_stamp(a["start_time"], "start_time"), is_stamp(a["end_time"], "end_time"),
        ]

    metrics = lambda p: inside(p, [
        not_negative(f"{p}.demand_mw"), not_negative(f"{p}.renewable_mw"), not_negative(f"{p}.curtailment_mw"), between(f"{p}.grid_stress_index", 0, 1),
    ])
    rules = [
        not_blank("scenario_id"), one_of("status", ("feasible", "infeasible")), if_given("solver_status", one_of("solver_status", SOLVER_STATES)),
        is_present("actions", "an array"), *metrics("before"), *metrics("after"), is_number("objective_value"),
        if_given("solve_duration_ms", not_negative("solve_duration_ms")),
    ]
    return rules, [each("actions", action)]


def scenario_rules() -> tuple[list[Rule], list[Column]]:
    def event(e: Column) -> list[tuple[Column, str]]:
        return [
            is_number(e["timestamp_offset_minutes"], "timestamp_offset_minutes"), not_blank(e["event_type"], "event_type"),
            not_negative(e["severity"], "severity"), not_blank(e["asset_or_zone_id"], "asset_or_zone_id"),
        ]

    outcome = "expected_outcome"
    rules = [
        not_blank("scenario_id"), not_blank("name"), not_blank("description"), is_stamp("historical_source_timestamp"),
        is_present("injected_events", "an array"),
        *inside(outcome, [is_present(f"{outcome}.expected_feasible_optimization", "a boolean")]),
    ]
    return rules, [each("injected_events", event)]


def recommendation_rules() -> list[Rule]:
    a, i = "associated_action", "impact_assessment"
    given = lambda rule: if_given(a, rule)
    return [
        not_blank("id"), not_blank("title"), one_of("urgency", URGENCIES), one_of("category", CATEGORIES), not_blank("description"), not_blank("rationale"),
        given(not_blank(f"{a}.resource_id")), given(not_blank(f"{a}.action_type")), given(not_negative(f"{a}.power_mw")), given(positive(f"{a}.duration_minutes")),
        *inside(i, [is_number(f"{i}.grid_stress_reduction"), not_negative(f"{i}.curtailment_avoided_mw")]), is_present("is_automated_executable", "a boolean"),
    ]


def snapshot_rules() -> list[Rule]:
    out = [is_stamp("timestamp"), not_blank("zone_id")]
    for s in SECTIONS:
        out += inside(s, [one_of(f"{s}.status", ("available", "unavailable"))])
    return out + inside("system_health", [
        is_present("system_health.is_degraded", "a boolean"), is_present("system_health.unavailable_dependencies", "an array"),
    ])


# --- resources ----------------------------------------------------------------


def _finding(field: str, text: str, severity: str, broken: Column) -> Column:
    found = F.struct(F.lit(field).alias("field"), F.lit(text).alias("message"), F.lit(severity).alias("severity"))
    return F.when(F.coalesce(broken, F.lit(False)), found)


def resource_rules() -> list[tuple[str, str, str, Column]]:
    """(field, message, severity, broken) for battery, EV, industrial and grid columns."""
    c = F.col
    one_way = F.sqrt("efficiency")
    hours = F.greatest(F.lit(0.0), c("max_soc_mwh") - c("current_soc_mwh")) / (c("max_charge_mw") * one_way)
    return [
        ("battery", "min_soc_mwh must be >= 0", "error", c("min_soc_mwh") < 0),
        ("battery", "max_soc_mwh must be > 0", "error", c("max_soc_mwh") <= 0),
        ("battery", "min_soc_mwh > max_soc_mwh", "error", c("min_soc_mwh") > c("max_soc_mwh")),
        ("battery", "current_soc_mwh < min_soc_mwh", "error", c("current_soc_mwh") < c("min_soc_mwh")),
        ("battery", "current_soc_mwh > max_soc_mwh", "error", c("current_soc_mwh") > c("max_soc_mwh")),
        ("battery", "max_charge_mw must be >= 0", "error", c("max_charge_mw") < 0),
        ("battery", "max_discharge_mw must be >= 0", "error", c("max_discharge_mw") < 0),
        ("battery", "efficiency must be in (0, 1]", "error", (c("efficiency") <= 0) | (c("efficiency") > 1)),
        ("battery.efficiency", "efficiency is unusually low", "warning", c("efficiency") < 0.7),
        ("battery", "battery nearly full", "warning", (c("max_charge_mw") > 0) & (c("max_soc_mwh") > 0) & (hours < 0.05)),
        ("ev", "current_demand_mw must be >= 0", "error", c("ev_current_mw") < 0),
        ("ev", "flexible_fraction must be in [0, 1]", "error", ~c("ev_fraction").between(0.0, 1.0)),
        ("ev", "shift_window_minutes must be > 0", "error", c("ev_window") <= 0),
        ("ev.flexible_fraction", "EV has demand but zero flexibility", "warning", (c("ev_fraction") == 0) & (c("ev_current_mw") > 0)),
        ("industrial", "current_demand_mw must be >= 0", "error", c("ind_current_mw") < 0),
        ("industrial", "flexible_fraction must be in [0, 1]", "error", ~c("ind_fraction").between(0.0, 1.0)),
        ("industrial", "shift_window_minutes must be > 0", "error", c("ind_window") <= 0),
        ("industrial", "max_shift_mw must be >= 0", "error", c("ind_cap_mw") < 0),
        ("industrial.max_shift_mw", "the shift cap will bind", "warning", c("ind_cap_mw") < c("ind_current_mw") * c("ind_fraction")),
        ("input", "grid_capacity_mw must be > 0", "error", c("grid_capacity_mw") <= 0),
    ]


def resource_check(resources: DataFrame, periods: DataFrame, n_periods: int = 4) -> DataFrame:
    """Findings (scenario_id, field, message, severity) on resources, period arrays, and peak against supply."""
    sums = periods.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("_periods"), F.max("demand_mw").alias("_peak"),
        F.max(F.col("other_generation_mw") + F.col("solar_mw") + F.col("wind_mw")).alias("_supply"),
        *[F.count_if(F.col(m) < 0).alias(f"_neg_{m}") for m in ("demand_mw", "solar_mw", "wind_mw", "other_generation_mw")],
    )
    rows = resources.join(sums, "scenario_id", "left")
    ev = F.col("ev_current_mw") * F.col("ev_fraction")
    industrial = F.least(F.col("ind_current_mw") * F.col("ind_fraction"), F.col("ind_cap_mw"))
    flexible = sum((F.coalesce(x, F.lit(0.0)) for x in (F.col("max_discharge_mw"), ev, industrial)), F.lit(0.0))
    rules = [
        *resource_rules(),
        ("input", "period count differs from n_periods", "error", F.coalesce(F.col("_periods") != n_periods, F.lit(True))),
        *[("input", f"{m} has negative values", "error", F.col(f"_neg_{m}") > 0) for m in ("demand_mw", "solar_mw", "wind_mw", "other_generation_mw")],
        ("supply_demand", "peak demand exceeds maximum supply + flexibility", "warning",
         (F.col("_periods") == n_periods) & (F.col("_peak") > F.col("_supply") + flexible)),
    ]
    found = F.array_compact(F.array(*[_finding(*rule) for rule in rules]))
    return rows.select("scenario_id", F.explode(found).alias("_f")).select("scenario_id", "_f.*")


def source_check(df: DataFrame) -> DataFrame:
    """Renewable source rules: named, solar or wind, nothing negative."""
    return check(df, [not_blank("asset_id"), one_of("asset_type", ("solar", "wind")), not_negative("available_mw")])
