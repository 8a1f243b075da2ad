"""Train and weather record expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compass sectors from north, clockwise.
WIND_SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

# Position texts of stations (no sign) and weather points (sign allowed).
STATION_POINT = r"POINT \(([\d.]+) ([\d.]+)\)"
WEATHER_POINT = r"POINT \(([\d.-]+) ([\d.-]+)\)"


def point_text(text: Column, pattern: str = STATION_POINT) -> Column:
    """STRUCT<lon, lat> of a position text, null when it does not match."""
    lon = F.regexp_extract(text, pattern, 1).try_cast("double")
    lat = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def delay_minutes(actual: Column, scheduled: Column) -> Column:
    """Whole minutes late, halves rounded up; 0 when a time is missing."""
    minutes = (_micros(actual) - _micros(scheduled)) / 60000000.0
    return F.coalesce(F.floor(minutes + 0.5), F.lit(0)).cast("int")


def delay_class(delay: Column) -> Column:
    return F.when(delay < 1, "ok").when(delay < 10, "warn").otherwise("bad")


def delay_text(delay: Column) -> Column:
    return F.when(delay <= 0, "On time").otherwise(F.concat(delay.cast("string"), F.lit(" min delay")))


def wind_direction(degrees: Column) -> Column:
    """Compass sector, empty for no direction."""
    sector = (F.floor(degrees / 45.0 + 0.5) % 8).cast("int")
    names = F.array(*[F.lit(name) for name in WIND_SECTORS])
    return F.coalesce(F.get(names, sector), F.lit(""))


def air_class(temperature: Column) -> Column:
    return (
        F.when(temperature < 0, "freezing")
        .when(temperature < 10, "cold")
        .when(temperature < 20, "mild")
        .otherwise("warm")
    )


def or_unknown(text: Column, unknown: str) -> Column:
    """Text, or the default when it is missing or empty."""
    return F.when(F.length(text) > 0, text).otherwise(F.lit(unknown))
