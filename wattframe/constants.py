"""Fixed values. They define the results and are stated plainly in one place."""

# Sampling and history.
STEP_SECONDS = 900
HORIZONS_MINUTES = (15, 30, 60)
DAY_STEPS = 96

# Unit factors.
WATTS_PER_MW = 1e6
WATTS_PER_KW = 1e3

# Plausible load limits in W, and as a capacity ratio for solar and wind parks.
LOAD_LIMITS_WATTS = (-500e6, 500e6)
LOAD_LIMITS_RATIO = (-1.05, 0.05)
ASSET_GROUPS = ("mv_feeder", "station_installation", "transformer", "solar_park", "wind_park")
RATIO_GROUPS = ("solar_park", "wind_park")
MAX_FILL_STEPS = 4

# Demand features: lags in minutes, rolling windows in rows.
LAG_MINUTES = (15, 30, 60, 1440)
ROLLING_WINDOWS = (4, 16, 96)
ROLLING_STATS = ("mean", "std", "min", "max")
WEATHER_INPUTS = (
    "temperature_2m", "relative_humidity_2m", "surface_pressure", "cloud_cover",
    "wind_speed_10m", "wind_direction_10m", "shortwave_radiation", "direct_radiation",
    "diffuse_radiation", "direct_normal_irradiance",
)
CALENDAR_FEATURES = (
    "hour", "day_of_week", "is_weekend", "is_holiday", "season",
    "sin_hour", "cos_hour", "sin_dow", "cos_dow",
)
SPIKE_FEATURES = (
    "current_load", "forecast_load", "load_growth_pct", "historical_peak_24h",
    "temp_c", "humidity", "cloud_cover", "wind_speed", "solar_radiation",
    "hour", "hour_sin", "hour_cos", "day_of_week", "is_weekend",
)

# Weather assumed at scoring time when none is known.
SPIKE_WEATHER_DEFAULTS = {
    "temp_c": 15.0, "humidity": 70.0, "cloud_cover": 50.0, "wind_speed": 10.0, "solar_radiation": 0.0,
}

# Generation features (15 minute) and hourly features.
GENERATION_LAGS = (1, 2, 4, 8, 96, 192, 672)
HOURLY_LAGS = (1, 2, 3, 6, 24, 48, 168)
HOURLY_WINDOWS = (3, 24, 168)
# Inputs of the hourly cause model, in the order of the stored models; none of them holds the current value.
HOURLY_CAUSE_FEATURES = (
    "expected_mw", "capacity_mw", "expected_capacity_ratio",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
    "day_of_year_sin", "day_of_year_cos", "month_sin", "month_cos",
    "lag_1", "lag_2", "lag_3", "lag_6", "lag_24", "lag_48", "lag_168",
    "roll_mean_3", "roll_mean_24", "roll_mean_168",
)
HOURLY_CAUSE_MIN_EXPECTED_MW = 1e-3
# Inputs of the quarter-hour cause models; one column per diagnosis of the learnt rows follows.
_CAUSE_COMMON = (
    "cloud_cover", "temperature_2m", "relative_humidity_2m", "surface_pressure",
    "hour_of_day", "minute_of_day", "day_of_year", "month", "day_of_week", "is_weekend", "season",
    "lag_1", "lag_2", "lag_4", "lag_8", "lag_96", "lag_192", "lag_672",
    "roll_mean_4", "roll_mean_96", "roll_std_96", "anomaly",
)
CAUSE_INPUTS = {
    "solar": (*_CAUSE_COMMON, "solar_elevation_deg", "cos_solar_zenith"),
    "wind": (
        *_CAUSE_COMMON, "wind_speed_10m", "wind_speed_cubed", "wind_direction_10m", "wind_dir_sin", "wind_dir_cos", "air_density_proxy",
        "wind_speed_roll_mean_4", "wind_speed_roll_mean_96",
    ),
}
CAUSE_MIN_ROWS = 10

# Dutch public holidays of 2024.
HOLIDAYS = {
    "2024-01-01": "Nieuwjaarsdag (New Year's Day)",
    "2024-03-29": "Goede Vrijdag (Good Friday)",
    "2024-03-31": "Eerste Paasdag (Easter Sunday)",
    "2024-04-01": "Tweede Paasdag (Easter Monday)",
    "2024-04-27": "Koningsdag (King's Day)",
    "2024-05-05": "Bevrijdingsdag (Liberation Day)",
    "2024-05-09": "Hemelvaartsdag (Ascension Day)",
    "2024-05-19": "Eerste Pinksterdag (Whit Sunday)",
    "2024-05-20": "Tweede Pinksterdag (Whit Monday)",
    "2024-12-25": "Eerste Kerstdag (Christmas Day)",
    "2024-12-26": "Tweede Kerstdag (Boxing Day)",
}

# Performance and diagnosis.
NEAR_ZERO_MW = 1e-4
NEAR_ZERO_HOURLY_MW = 1e-6
CAUSE_MIN_EXPECTED_MW = 1e-3
LOW_RATIO = 0.70
NORMAL_RATIO = (0.90, 1.10)
PERSISTENT_LOW_ROWS = 4
HIGH_CLOUD_PERCENT = 80.0
CALM_WIND_MS = 3.0
NEGLIGIBLE_DEVIATION_PERCENT = 5.0
GENERATION_TYPES = ("solar", "wind", "hydro")
TRUE_WORDS = ("true", "1", "yes", "y", "flagged")

# Turbine curve in m/s.
CUT_IN, RATED, CUT_OUT = 3.0, 12.0, 25.0

# Metrics.
MAPE_MIN_DEMAND_MW = 1e-4
MAPE_RULES = {"solar": (0.001, 1e-9), "wind": (0.05, 1e-9), "hourly": (1e-6, 0.0)}

# Spikes.
GROWTH_FLOOR_MW = 0.10
SPIKE_PERCENTILES = (0.95, 0.99)
FALLBACK_RMSE = {15: 0.0829, 30: 0.0972, 60: 0.1257}
BAND_Z = 1.96

# Boosting: the most rounds of each model and its tree depth. All stop earlier once held-out rows no longer gain.
DEMAND_ROUNDS, HOURLY_ROUNDS, SPIKE_ROUNDS, CAUSE_ROUNDS = 500, 350, 300, 160
HOURLY_FOLDS = 2  # the same for hourly generation
HOURLY_CAUSE_ROUNDS, HOURLY_CAUSE_MIN_ROWS = 140, 500
CROSS_FOLDS = 3  # stretches of the train part that are forecast by models of earlier ones
# Rounds without a smaller validation error that end a fit. Causes are fitted without one elsewhere; theirs is our own.
PATIENCE, HOURLY_PATIENCE, SPIKE_PATIENCE, CAUSE_PATIENCE = 30, 40, 25, 30
TREE_DEPTH, CAUSE_DEPTH = 5, 3

# Isolation forest.
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42

# Grid stress index.
STRESS_WARNING, STRESS_CRITICAL = 0.75, 0.90

# Dispatch objective.
WEIGHTS = {
    "curtailment": 10.0, "deficit": 100.0, "oversupply": 1.0,
    "cycling": 0.5, "ev": 2.0, "industrial": 3.0,
}
ACTIVE_MW = 0.01

# Cause categories by feature.
CAUSE_CATEGORIES = {
    "cloud_cover": "weather_cloud_cover",
    "solar_elevation_deg": "solar_position",
    "cos_solar_zenith": "solar_position",
    "temperature_2m": "weather_temperature",
    "relative_humidity_2m": "weather_humidity",
    "surface_pressure": "weather_pressure",
    "wind_speed_10m": "weather_wind_speed",
    "wind_speed_cubed": "weather_wind_speed",
    "wind_speed_roll_mean_4": "weather_wind_speed",
    "wind_speed_roll_mean_96": "weather_wind_speed",
    "wind_direction_10m": "weather_wind_direction",
    "wind_dir_sin": "weather_wind_direction",
    "wind_dir_cos": "weather_wind_direction",
    "air_density_proxy": "weather_air_density",
    "hour_of_day": "time_pattern",
    "minute_of_day": "time_pattern",
    "day_of_year": "time_pattern",
    "month": "time_pattern",
    "day_of_week": "time_pattern",
    "is_weekend": "time_pattern",
    "season": "time_pattern",
    "lag_1": "persistent_pattern",
    "lag_2": "persistent_pattern",
    "lag_4": "persistent_pattern",
    "lag_8": "persistent_pattern",
    "lag_96": "persistent_pattern",
    "lag_192": "persistent_pattern",
    "lag_672": "persistent_pattern",
    "roll_mean_4": "persistent_pattern",
    "roll_mean_96": "persistent_pattern",
    "roll_std_96": "persistent_pattern",
    "anomaly": "unexplained_anomaly",
    "diagnostic_category_weather_driven_reduction": "weather_cloud_cover",
    "diagnostic_category_possible_physical_fault": "persistent_pattern",
    "diagnostic_category_data_quality_issue": "data_quality_signal",
    "diagnostic_category_intentional_curtailment": "curtailment_signal",
    "diagnostic_category_uncertain": "other_factor",
    "diagnostic_category_normal_production": "normal_operation",
}
DIAGNOSTIC_CATEGORIES = (
    "data_quality_issue", "intentional_curtailment", "normal_production",
    "possible_physical_fault", "uncertain", "weather_driven_reduction",
)

# Words that mark a column name as a candidate for a role, or as a leak.
COLUMN_KEYWORDS = {
    "timestamp": ("timestamp", "datetime", "date", "time", "utc"),
    "demand_load": ("demand", "load", "consumption", "electricity"),
    "zone": ("zone", "region", "area", "location", "grid"),
    "feeder": ("feeder",),
    "weather": ("temperature", "temp", "humidity", "cloud", "wind", "weather", "pressure", "radiation"),
    "solar": ("solar", "pv", "photovoltaic", "irradiance"),
    "wind": ("wind", "windpower", "wind_generation"),
    "forecast": ("forecast", "prediction", "predicted"),
}
LEAK_KEYWORDS = (
    "future", "ahead", "lead", "target", "actual_future", "future_demand",
    "future_load", "forecast", "predicted", "prediction",
)

# Eight named one-hour scenarios of four periods:
# demand, solar, wind, other, ev, industrial, capacity, battery (soc, discharge), has ev, has industrial.
SCENARIOS = {
    "NORMAL_DAY": ([140, 142, 145, 143], [38, 40, 42, 39], [32, 33, 31, 34], 75, [10, 10, 10, 10], 25, 200, (25, 20), True, True),
    "EVENING_DEMAND_SPIKE": ([155, 168, 182, 190], [30, 18, 8, 2], [28, 26, 25, 24], 80, [14, 16, 18, 20], 28, 200, (35, 20), True, True),
    "SOLAR_UNDERPERFORMANCE": ([150, 152, 155, 153], [16, 15, 14, 17], [30, 31, 29, 32], 78, [10, 10, 10, 10], 26, 200, (30, 20), True, True),
    "HIGH_RENEWABLE_CURTAILMENT": ([110, 108, 105, 107], [65, 70, 72, 68], [55, 58, 60, 56], 40, [8, 8, 8, 8], 20, 200, (10, 20), True, True),
    "DEMAND_SPIKE_PLUS_RENEWABLE_DROP": ([165, 178, 188, 195], [20, 12, 6, 3], [18, 14, 10, 8], 85, [14, 16, 18, 20], 30, 200, (40, 20), True, True),
    "BATTERY_UNAVAILABLE": ([155, 160, 165, 162], [35, 36, 34, 33], [28, 29, 30, 28], 80, [12, 12, 12, 12], 28, 200, None, True, True),
    "NO_FLEXIBLE_LOAD": ([160, 165, 170, 168], [32, 30, 28, 26], [25, 24, 23, 22], 80, [10, 10, 10, 10], 25, 200, (35, 20), False, False),
    "INFEASIBLE_DEMAND": ([450, 480, 500, 520], [5, 4, 3, 2], [3, 2, 2, 1], 30, [5, 5, 5, 5], 10, 100, (8, 10), True, True),
}
# Resources behind the scenarios: battery band and rate, EV and industrial flexibility.
BATTERY_MIN_MWH, BATTERY_MAX_MWH, BATTERY_CHARGE_MW, BATTERY_EFFICIENCY = 5.0, 50.0, 20.0, 0.90
EV_DEMAND_MW, EV_FRACTION = 12.0, 0.40
INDUSTRIAL_DEMAND_MW, INDUSTRIAL_FRACTION, INDUSTRIAL_CAP_MW = 28.0, 0.30, 12.0

# Rows that a 48-hour block needs to be analysed.
MIN_BLOCK_ROWS = 4
