"""Scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe import constants as C


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def at_least(value: str | Column, floor: float) -> Column:
    """max(value, floor) that stays null for a null (`greatest` skips nulls)."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


def at_most(value: str | Column, ceiling: float) -> Column:
    value = col(value)
    return F.when(value.isNotNull(), F.least(value, F.lit(float(ceiling))))


def finite(value: str | Column) -> Column:
    """NaN and infinities as null: both engines order NaN above every number."""
    value = col(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def load_mw(load: str | Column, group: str | Column | None = None) -> Column:
    """W to MW; solar and wind park loads are capacity ratios and stay as they are."""
    load = col(load)
    if group is None:
        return load / C.WATTS_PER_MW
    return F.when(col(group).isin(*C.RATIO_GROUPS), load).otherwise(load / C.WATTS_PER_MW)


def load_kw(load: str | Column, group: str | Column | None = None) -> Column:
    load = col(load)
    if group is None:
        return load / C.WATTS_PER_KW
    return F.when(col(group).isin(*C.RATIO_GROUPS), load).otherwise(load / C.WATTS_PER_KW)


def generation_mw(load: str | Column) -> Column:
    return at_least(load_mw(load), 0.0)


def load_growth(now: str | Column, future: str | Column) -> Column:
    """Growth in percent over a base of at least 0.10 MW."""
    now, future = col(now), col(future)
    return (future - now) / at_least(now, C.GROWTH_FLOOR_MW) * 100


def flag_truth(value: str | Column, kind: str = "string") -> Column:
    """Curtailment flags come as booleans, numbers or words; null is false."""
    value = col(value)
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "numeric":
        return F.coalesce(value != 0, F.lit(False))
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*C.TRUE_WORDS), F.lit(False))


def fit_array(values: str | Column, n: Column | int, default: float = 0.0) -> Column:
    """Cycle-pad or trim an array to n entries; null becomes n defaults."""
    values = col(values)
    n = F.lit(n) if isinstance(n, int) else n
    repeats = F.ceil(n / F.greatest(F.size(values), F.lit(1))).cast("int")
    cycled = F.slice(F.flatten(F.array_repeat(values, repeats)), F.lit(1), n)
    return F.when(values.isNull(), F.array_repeat(F.lit(default), n)).otherwise(cycled)


def fit_scalar(value: str | Column, n: Column | int, default: float = 0.0) -> Column:
    return F.array_repeat(F.coalesce(col(value), F.lit(default)), n)


def stress_severity(index: str | Column) -> Column:
    index = col(index)
    return (
        F.when(index >= C.STRESS_CRITICAL, "critical").when(index >= C.STRESS_WARNING, "warning")
        .when(index.isNotNull(), "normal")
    )


# Series names of the wide source: region, energy type, optional siting.
SERIES_NAME = r"^(.+)_(solar|wind)(?:_(?:onshore|offshore))?_generation_actual$"
UNSAFE_IN_FILE_NAME = r"[^A-Za-z0-9_.-]+"


def series_region(name: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(name), SERIES_NAME, 1), F.lit(""))


def series_energy(name: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(name), SERIES_NAME, 2), F.lit(""))


def capacity_name(name: str | Column) -> Column:
    return F.regexp_replace(col(name), "_generation_actual$", "_capacity")


def safe_file_name(name: str | Column) -> Column:
    return F.regexp_replace(col(name), UNSAFE_IN_FILE_NAME, "_")


def what_if(action: str | Column, power: str | Column, stress: str | Column, soc: str | Column) -> Column:
    """Projected stress of one action, as a struct."""
    action, power, stress, soc = col(action), col(power), col(stress), col(soc)
    relief = action.isin("battery_discharge", "shift_flexible_load")
    charging = action == "battery_charge"
    delta = (
        F.when(relief, -F.least(F.lit(0.40), power / 100 * 0.5)).when(charging, power / 100 * 0.3).otherwise(0.0)
    )
    over = F.when(relief & (power > 20), F.lit("power above the 20 MW inverter rating"))
    full = F.when(charging & (soc >= 90), F.lit("state of charge at the 90% limit"))
    warnings = F.array_compact(F.array(over, full))
    return F.struct(
        F.greatest(F.lit(0.10), F.least(F.lit(1.0), stress + delta)).alias("projected_stress"),
        delta.alias("delta_stress"),
        (F.size(warnings) == 0).alias("feasible"),
        warnings.alias("warnings"),
    )


def first_true(*cases: tuple[Column, Column | str | float], otherwise: Column | str | float | None = None) -> Column:
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def messages(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """The messages of all broken rules, in rule order. A null test counts as broken."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(True)), F.lit(text) if isinstance(text, str) else text) for broken, text in rules
    ]))
