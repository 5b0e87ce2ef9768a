"""Column expressions. All of them are built-in Spark functions, so they stay in codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatt import constants as K


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of `key` in a small fixed table, null when absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


# ---- time ---------------------------------------------------------------------------------


def time_key(ts: Column) -> Column:
    return F.date_format(ts, K.TIME_KEY_FORMAT)


def parse_time_key(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit(K.TIME_KEY_FORMAT))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / F.lit(3600.0)


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "hour": F.hour(ts),
        "day_of_year": F.dayofyear(ts),
    }


def cyclic_parts(ts: Column) -> dict[str, Column]:
    day_angle = F.hour(ts) * F.lit(2 * math.pi) / 24.0
    year_angle = F.dayofyear(ts) * F.lit(2 * math.pi) / 365.25
    return {
        "hour_sin": F.sin(day_angle),
        "hour_cos": F.cos(day_angle),
        "doy_sin": F.sin(year_angle),
        "doy_cos": F.cos(year_angle),
    }


def market_to_utc(wall: Column, tz: str = K.MARKET_TZ) -> Column:
    """Hour starts on the market's wall clock as UTC.

    The repeated autumn hour is its first (summer time) instance and the
    skipped spring hour moves forward, as Spark's own conversion does for
    hour starts.
    """
    return F.to_utc_timestamp(wall.cast("timestamp"), tz)


def hour_ending_to_utc(day: Column, hour_ending: Column, tz: str = K.MARKET_TZ) -> Column:
    """Hour-ending 1 is the hour that starts at midnight."""
    start = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + (hour_ending - 1) * 3600)
    return market_to_utc(start, tz)


SERIAL_DAY_ZERO = -2209161600  # Fixed value: 1899-12-30 in epoch seconds.


#: Date texts beside the ISO forms, in the order in which they are tried.
DATE_FORMS = ("M/d/yyyy", "M/d/yy", "yyyy/M/d", "d-MMM-yyyy", "d-MMM-yy", "MMM d, yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")


def coerce_date(text: Column) -> Column:
    """A spreadsheet serial day number or a date text; anything else is null."""
    serial = text.try_cast("double")
    return F.when(
        serial.isNotNull(),
        F.timestamp_seconds(F.round(serial * 86400).cast("bigint") + SERIAL_DAY_ZERO),
    ).otherwise(
        F.coalesce(
            F.try_to_timestamp(text),
            *[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMS],
        )
    )


def coerce_numeric(text: Column) -> Column:
    """Number or null; NaN counts as missing."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


# ---- weather ------------------------------------------------------------------------------


def c_to_f(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32.0


def cooling_degrees(temp_f: Column, base: float = 65.0) -> Column:
    # greatest() skips nulls, so a missing temperature needs the guard.
    return F.when(temp_f.isNotNull(), F.greatest(temp_f - base, F.lit(0.0)))


def heating_degrees(temp_f: Column, base: float = 65.0) -> Column:
    return F.when(temp_f.isNotNull(), F.greatest(F.lit(base) - temp_f, F.lit(0.0)))


# ---- names --------------------------------------------------------------------------------


def norm_header(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.trim(text)), r"[_\-/]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def norm_snake(text: Column) -> Column:
    snake = F.regexp_replace(F.lower(F.trim(text)), r"[\s\-/]+", "_")
    return F.regexp_replace(F.regexp_replace(snake, "_+", "_"), "^_+|_+$", "")


def norm_model_name(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " -", "__")


def canonical_header(text: Column) -> Column:
    """Canonical name of a sheet header cell: a load column, `date`, `hr`, or null.

    The alias lists pass through the same normalisation as the cell, so the
    underscored spellings match as well.
    """
    table = {}
    for name, aliases in [*K.LOAD_HEADER_NAMES.items(), ("date", K.DATE_HEADER_NAMES), ("hr", K.HOUR_HEADER_NAMES)]:
        for alias in aliases:
            table.setdefault(alias.replace("_", " ").replace("-", " "), name)
    return lookup(table, norm_header(text))


def area_to_region(name: Column) -> Column:
    """Region of an area name by its prefix, or the total for one of the total's words; else null.

    Every known full name starts with its region's prefix, so one pattern and
    one lookup settle all of them.
    """
    table = {prefix: region for region, prefixes in K.AREA_PREFIXES.items() for prefix in prefixes}
    table.update({word: K.TOTAL_REGION for word in K.TOTAL_AREA_WORDS})
    words = "|".join(K.TOTAL_AREA_WORDS)
    prefixes = "|".join(p for ps in K.AREA_PREFIXES.values() for p in ps)
    return lookup(table, F.regexp_extract(F.lower(F.trim(name)), f"^({prefixes}|(?:{words})$)", 1))


# ---- forecast errors ----------------------------------------------------------------------


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    error = predicted - actual
    return {
        "error": error,
        "absolute_error": F.abs(error),
        "squared_error": error * error,
        "ape_percent": ape_percent(actual, predicted),
    }


def ape_percent(actual: Column, predicted: Column) -> Column:
    """Absolute percentage error; null for a zero actual."""
    return F.when(actual != 0, F.abs(predicted - actual) / F.abs(actual) * 100.0)


def to_log(load: Column) -> Column:
    return F.log1p(load)


def from_log(value: Column) -> Column:
    """Back from log1p, never below zero; a null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.expm1(value), F.lit(0.0)))


# ---- geometry -----------------------------------------------------------------------------


def circle_ring(lon: Column, lat: Column, radius_km: float, points: int = 48) -> Column:
    """Closed lon/lat ring of `points` vertices around a station."""
    dlat = F.lit(radius_km / 111.0)
    dlon = F.lit(float(radius_km)) / (F.cos(F.radians(lat)) * 111.0 + 1e-9)
    vertices = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.array(
            lon + dlon * F.cos(i / points * (2 * math.pi)),
            lat + dlat * F.sin(i / points * (2 * math.pi)),
        ),
    )
    return F.concat(vertices, F.slice(vertices, 1, 1))


def hour_indicators(key: Column) -> dict[str, Column]:
    """24 indicator columns from the last two characters of a time key."""
    hour = F.substring(key, -2, 2)
    return {f"hour_{h:02d}": (hour == f"{h:02d}").cast("int") for h in range(24)}


def valid_hour_suffix(key: Column) -> Column:
    return F.coalesce(F.substring(key, -2, 2).rlike("^([01][0-9]|2[0-3])$"), F.lit(False))
