"""These must equal the published formats and names for right results."""

# Region codes, the system total first.
REGIONS = ["caiso", "pge", "sce", "sdge", "vea", "mwd"]
TOTAL_REGION = "caiso"
#: Regions that models are trained on unless told otherwise.
MODEL_REGIONS = ["pge", "sce", "sdge"]
AREA_REGIONS = ["pge", "sce", "sdge", "vea", "mwd"]
NO_LOAD_REGION = "mwd"

# Market time zone.
MARKET_TZ = "America/Los_Angeles"

# Hourly weather variables, in file order.
WEATHER_VARS = [
    "temperature_2m",
    "apparent_temperature",
    "relative_humidity_2m",
    "precipitation",
    "cloud_cover",
    "wind_speed_10m",
    "shortwave_radiation",
]

# Panel column order.
PANEL_COLUMNS = ["region", "time_key", "time_utc", *WEATHER_VARS, "cdd_65f", "hdd_65f", "load_mw"]
FEATURE_COLUMNS = ["is_weekend", "US_federal_holidays", "state_holidays", "load_previous_week"]
REVISED_COLUMNS = PANEL_COLUMNS + FEATURE_COLUMNS
NEXT_DAY_COLUMNS = [c if c != "load_mw" else "load_pred_mw" for c in PANEL_COLUMNS] + FEATURE_COLUMNS

# Sheet header names of each load column.
LOAD_HEADER_NAMES = {
    "caiso": ["caiso", "caiso total", "total", "iso", "system", "system total"],
    "pge": ["pge", "pge tac", "pge-tac", "pg&e", "pg&e tac", "pg&e-tac"],
    "sce": ["sce", "sce tac", "sce-tac", "southern california edison"],
    "sdge": ["sdge", "sdg&e", "sdge tac", "sdge-tac", "sdg&e tac", "sdg&e-tac"],
    "vea": ["vea", "vea tac", "vea-tac"],
    "mwd": ["mwd", "mwd tac", "mwd-tac"],
}
# Fixed value: sheet header names of the date column.
DATE_HEADER_NAMES = ["date", "opr_dt", "opr date", "trading date", "trade date", "market date"]
# Fixed value: sheet header names of the hour column.
HOUR_HEADER_NAMES = ["hr", "hour", "opr_hr", "he", "hour ending", "he hour"]
# Fixed value: rows of a sheet in which its header is looked for.
HEADER_SCAN_ROWS = 80

# How area names of the actual-load feed start, and words that mean the total.
AREA_PREFIXES = {
    "pge": ["pge", "pg&e"],
    "sce": ["sce"],
    "sdge": ["sdge", "sdg&e"],
    "vea": ["vea"],
    "mwd": ["mwd"],
    "caiso": ["caiso"],
}
TOTAL_AREA_WORDS = ["system", "total", "iso"]

# Area names of the day-ahead forecast feed.
DAY_AHEAD_AREAS = {
    "CA ISO-TAC": "caiso",
    "PGE-TAC": "pge",
    "SCE-TAC": "sce",
    "SDGE-TAC": "sdge",
    "VEA-TAC": "vea",
    "MWD-TAC": "mwd",
}
DAY_AHEAD_START_COLUMNS = [
    "INTERVALSTARTTIME_GMT",
    "INTERVALSTARTTIME",
    "INTERVAL_START_GMT",
    "INTERVAL_START_TIME_GMT",
]

# Column choices of the long area-load feed, best first.
AREA_COLUMNS = ["tac_area", "area", "zone", "load_zone"]
AREA_VALUE_COLUMNS = ["load_mw", "load", "demand_mw", "demand", "mw", "value"]
AREA_NON_VALUE_COLUMNS = [
    "interval_start_local",
    "interval_start_utc",
    "interval_end_local",
    "interval_end_utc",
    "tac_area_name",
    "tac_area",
    "area",
    "market",
    "source",
    "publish_time",
    "publish_time_utc",
]

# File name formats.
DATASET_PREFIX = "caiso_dataset"
DATASET_PATTERN = r"^caiso_dataset_(\d{8})_to_(\d{8})\.csv$"
RUN_PATTERN = r"^(.+)_(\d{4}-\d{2})_(metrics|predictions)\.csv$"
TIME_KEY_FORMAT = "yyyy-MM-dd:HH"
TIME_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Columns a predictions file must hold, and metric columns.
PREDICTION_COLUMNS = ["time_utc", "actual_load_mw", "predicted_load_mw"]
METRIC_COLUMNS = ["RMSE", "MAE", "MAPE", "BIAS", "MSE"]

# Stations used when no weights file is given (name, latitude, longitude).
FALLBACK_STATIONS = {
    "caiso": [
        ("Los Angeles", 34.0522, -118.2437),
        ("San Francisco", 37.7749, -122.4194),
        ("San Diego", 32.7157, -117.1611),
        ("Sacramento", 38.5816, -121.4944),
        ("Fresno", 36.7378, -119.7871),
    ],
    "pge": [
        ("San Francisco", 37.7749, -122.4194),
        ("San Jose", 37.3382, -121.8863),
        ("Oakland", 37.8044, -122.2711),
        ("Sacramento", 38.5816, -121.4944),
        ("Fresno", 36.7378, -119.7871),
    ],
    "sce": [
        ("Los Angeles", 34.0522, -118.2437),
        ("Riverside", 33.9806, -117.3755),
        ("San Bernardino", 34.1083, -117.2898),
        ("Bakersfield", 35.3733, -119.0187),
        ("Palm Springs", 33.8303, -116.5453),
    ],
    "sdge": [
        ("San Diego", 32.7157, -117.1611),
        ("Chula Vista", 32.6401, -117.0842),
        ("Oceanside", 33.1959, -117.3795),
        ("El Cajon", 32.7948, -116.9625),
        ("Escondido", 33.1192, -117.0864),
    ],
    "vea": [
        ("Lancaster", 34.6868, -118.1542),
        ("Palmdale", 34.5794, -118.1165),
        ("Victorville", 34.5361, -117.2912),
        ("Barstow", 34.8958, -117.0173),
        ("Ridgecrest", 35.6225, -117.6709),
    ],
    "mwd": [
        ("Los Angeles", 34.0522, -118.2437),
        ("Long Beach", 33.7701, -118.1937),
        ("Anaheim", 33.8366, -117.9143),
        ("Santa Ana", 33.7455, -117.8677),
        ("Riverside", 33.9806, -117.3755),
    ],
}

# Additive model terms.
ADDITIVE_SPLINES = ["temperature_2m", "shortwave_radiation", "load_previous_week", "load_lag_24h"]
ADDITIVE_CYCLIC = {"hour": (24, 0.0, 24.0), "day_of_year": (20, 1.0, 367.0)}
ADDITIVE_LINEAR = [
    "load_24h_avg",
    "relative_humidity_2m",
    "cloud_cover",
    "wind_speed_10m",
    "precipitation",
    "is_weekend",
    "US_federal_holidays",
    "state_holidays",
]
ADDITIVE_FACTORS = ["region_code", "day_of_week"]
HOURLY_ADDITIVE_TERMS = [
    "temperature_2m",
    "apparent_temperature",
    "load_previous_week",
    "relative_humidity_2m",
    "shortwave_radiation",
    "is_weekend",
    "US_federal_holidays",
    "state_holidays",
    "doy_sin",
    "doy_cos",
]
SEASONAL_REGRESSORS = [
    *WEATHER_VARS,
    "cdd_65f",
    "hdd_65f",
    "is_weekend",
    "US_federal_holidays",
    "state_holidays",
    "load_previous_week",
]

# Weekday report order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
