"""Train and weather tables built from feed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feeds

# Announcement horizon around now, and its row cap.
BEFORE, AFTER, MAX_ANNOUNCEMENTS = "15 minutes", "5 minutes", 500


def advertised_stations(stations: DataFrame) -> DataFrame:
    """Advertised stations with a readable position: signature, name, lon, lat."""
    return (
        stations.filter(F.col("Advertised"))
        .withColumn("at", feeds.point_text(F.col("Geometry.WGS84")))
        .filter(F.col("at").isNotNull())
        .select(
            F.col("LocationSignature").alias("signature"),
            F.col("AdvertisedLocationName").alias("name"),
            F.col("at.lon").alias("lon"),
            F.col("at.lat").alias("lat"),
        )
    )


def one_per_signature(stations: DataFrame, order_by: tuple[str, ...] = ("name", "lon", "lat")) -> DataFrame:
    """One row per station code: the last one in the order of ``order_by``, whose nulls come first.

    Feeds repeat codes; joined as they are, each announcement would be there once per repetition.
    """
    others = [c for c in stations.columns if c != "signature"]
    last = F.max_by(F.struct(*others), F.struct(*order_by)).alias("row")
    return stations.groupBy("signature").agg(last).select("signature", "row.*")


def in_horizon(time: Column, now: Column) -> Column:
    return (time > now - F.expr(f"INTERVAL {BEFORE}")) & (time < now + F.expr(f"INTERVAL {AFTER}"))


def recent_announcements(announcements: DataFrame, now: Column) -> DataFrame:
    """Announcements with a time in the horizon, the latest first up to the cap."""
    return (
        announcements.filter(in_horizon(F.col("TimeAtLocation"), now))
        .orderBy(F.desc("TimeAtLocation"), "announcement_id")
        .limit(MAX_ANNOUNCEMENTS)
    )


def train_rows(announcements: DataFrame, stations: DataFrame) -> DataFrame:
    """Announcements at known stations with names for origin and destination.

    A station code counts once, see :func:`one_per_signature`. How the stations are joined is left to
    adaptive execution, which knows their size when it is there.
    """
    known = one_per_signature(stations)
    first = {
        "from_code": F.coalesce(F.get(F.col("FromLocation"), F.lit(0))["LocationName"], F.lit("")),
        "to_code": F.coalesce(F.get(F.col("ToLocation"), F.lit(0))["LocationName"], F.lit("")),
    }
    origin = known.select(F.col("signature").alias("from_code"), F.col("name").alias("from_name"))
    target = known.select(F.col("signature").alias("to_code"), F.col("name").alias("to_name"))
    at = known.withColumnRenamed("signature", "LocationSignature")
    return (
        announcements.withColumns(first)
        .join(at, "LocationSignature", "inner")
        .join(origin, "from_code", "left")
        .join(target, "to_code", "left")
        .select(
            "announcement_id",
            F.col("AdvertisedTrainIdent").alias("train"),
            "lon",
            "lat",
            F.col("name").alias("station_name"),
            F.coalesce("from_name", "from_code").alias("origin"),
            F.coalesce("to_name", "to_code").alias("destination"),
            feeds.delay_minutes(F.col("TimeAtLocation"), F.col("AdvertisedTimeAtLocation")).alias("delay"),
            feeds.or_unknown(F.col("Operator"), "Unknown").alias("operator"),
            F.col("TimeAtLocation").alias("time"),
        )
        .withColumns(
            {
                "delay_class": feeds.delay_class(F.col("delay")),
                "delay_text": feeds.delay_text(F.col("delay")),
            }
        )
    )


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Last row per key; at the same time the lowest ``tie``.

    An aggregate, not a window: each task folds its rows to one per key before
    the shuffle, so a key with a third of all rows is no heavier than another.
    """
    others = [c for c in df.columns if c != key]
    newest = F.struct(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), (-F.col(tie)).alias("first"))
    return df.groupBy(key).agg(F.max_by(F.struct(*others), newest).alias("row")).select(key, "row.*")


def weather_rows(points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat weather observations of points with a readable position, and the columns to keep."""
    obs = "Observation"
    wind = F.get(F.col(f"{obs}.Wind"), F.lit(0))
    flat = (
        points.withColumn("at", feeds.point_text(F.col("Geometry.WGS84"), feeds.WEATHER_POINT))
        .filter(F.col("at").isNotNull())
        .select(
            F.col("Id").alias("id"),
            F.col("Name").alias("name"),
            F.col("at.lon").alias("lon"),
            F.col("at.lat").alias("lat"),
            F.col(f"{obs}.Air.Temperature.Value").alias("air_temp"),
            F.col(f"{obs}.Surface.Temperature.Value").alias("surface_temp"),
            F.col(f"{obs}.Air.RelativeHumidity.Value").alias("humidity"),
            F.col(f"{obs}.Air.VisibleDistance.Value").alias("visibility"),
            wind["Speed"]["Value"].alias("wind_speed"),
            wind["Direction"]["Value"].alias("wind_dir"),
            feeds.or_unknown(F.col(f"{obs}.Weather.Precipitation"), "unknown").alias("precipitation"),
            F.col(f"{obs}.Sample").alias("sample"),
            *keep,
        )
    )
    return flat.withColumns(
        {
            "wind_sector": feeds.wind_direction(F.col("wind_dir")),
            "air_class": feeds.air_class(F.col("air_temp")),
        }
    )
