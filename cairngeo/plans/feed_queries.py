"""Train, weather and point-cloud queries, registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import feeds as expressions
from ..operators import feeds, points
from ..sources import feeds as feed_readers
from . import landing, views
from .layer_queries import STAMP, stamp
from .registry import query
from .view_sql import sql

NOW = "2024-01-15 12:00:00"


def _stations(spark, d):
    return feeds.advertised_stations(views.stations(spark, d))


def _trains(spark, d):
    return feeds.train_rows(views.announcements(spark, d), _stations(spark, d))


@query("J2_repeated_stations", sql("SELECT announcement_id, train, station_name, lon, lat, origin, destination, delay FROM train_rows", "train_rows"))
def j2r(spark, d):
    """Station codes that the feed repeats under other names: the last in order counts, each announcement once."""
    stations = _stations(spark, d)
    older = [stations.withColumn("name", F.concat(F.lit(mark), "name")) for mark in (" former ", "")]
    return feeds.train_rows(views.announcements(spark, d), older[0].unionByName(older[1]).unionByName(older[0])).select(
        "announcement_id", "train", "station_name", "lon", "lat", "origin", "destination", "delay"
    )


@query("P10_advertised_stations", sql("SELECT signature, name, lon, lat FROM known_stations", "known_stations"))
def p10(spark, d):
    return _stations(spark, d)


@query(
    "P10_recent_announcements",
    sql(
        f"""SELECT announcement_id, train, {STAMP.format('seen')} AS time FROM announcements
            WHERE seen > TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AND seen < TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE
            ORDER BY seen DESC, announcement_id LIMIT 500""",
        "announcements",
    ),
)
def p10b(spark, d):
    recent = feeds.recent_announcements(views.announcements(spark, d), F.lit(NOW).cast("timestamp_ntz"))
    return recent.select(
        "announcement_id",
        F.col("AdvertisedTrainIdent").alias("train"),
        F.date_format("TimeAtLocation", "yyyy-MM-dd HH:mm:ss").alias("time"),
    )


@query(
    "P11_drop_without_position",
    sql("SELECT signature, lon, lat FROM known_stations UNION ALL SELECT signature, NULL, NULL FROM stations WHERE false", "known_stations"),
)
def p11(spark, d):
    # hidden stations get a text without a position and fall out
    broken = views.stations(spark, d).withColumn(
        "text", F.when(F.col("Advertised"), F.col("Geometry.WGS84")).otherwise("POINT ()")
    )
    at = broken.select(F.col("LocationSignature").alias("signature"), expressions.point_text(F.col("text")).alias("at"))
    return at.filter(F.col("at").isNotNull()).select("signature", "at.lon", "at.lat")


@query(
    "F19_point_text",
    sql("SELECT id, event_id, lon, lat FROM weather", "weather"),
)
def f19(spark, d):
    at = expressions.point_text(F.col("Geometry.WGS84"), expressions.WEATHER_POINT)
    return views.weather(spark, d).select(F.col("Id").alias("id"), "event_id", at["lon"].alias("lon"), at["lat"].alias("lat"))


@query(
    "J2_announcements_at_stations",
    sql("SELECT announcement_id, train, station_name, lon, lat FROM train_rows", "train_rows"),
)
def j2(spark, d):
    return _trains(spark, d).select("announcement_id", "train", "station_name", "lon", "lat")


@query("J3_origin_destination", sql("SELECT announcement_id, origin, destination FROM train_rows", "train_rows"))
def j3(spark, d):
    return _trains(spark, d).select("announcement_id", "origin", "destination")


CLASSES = """CASE WHEN delay < 1 THEN 'ok' WHEN delay < 10 THEN 'warn' ELSE 'bad' END AS delay_class,
    CASE WHEN delay <= 0 THEN 'On time' ELSE delay || ' min delay' END AS delay_text"""


@query(
    "F20_delay_minutes",
    sql(
        "SELECT announcement_id, coalesce(CAST(floor((epoch_us(seen) - epoch_us(scheduled)) / 60000000.0e0 + 0.5e0) AS INT), 0) AS delay FROM announcements",
        "announcements",
    ),
)
def f20(spark, d):
    delay = expressions.delay_minutes(F.col("TimeAtLocation"), F.col("AdvertisedTimeAtLocation"))
    return views.announcements(spark, d).select("announcement_id", delay.alias("delay"))


@query("F21_delay_class", sql(f"SELECT announcement_id, delay, {CLASSES} FROM train_rows", "train_rows"))
def f21(spark, d):
    return _trains(spark, d).select("announcement_id", "delay", "delay_class", "delay_text")


@query(
    "F25_train_rows",
    sql(f"SELECT announcement_id, train, lon, lat, station_name, origin, destination, delay, operator, {STAMP.format('time')} AS time, {CLASSES} FROM train_rows", "train_rows"),
)
def f25(spark, d):
    return _trains(spark, d).withColumn("time", stamp("time"))


@query(
    "W1_latest_per_train",
    sql(
        f"""SELECT train, announcement_id, lon, lat, station_name, origin, destination, delay, operator, {STAMP.format('time')} AS time, {CLASSES}
            FROM train_rows QUALIFY row_number() OVER (PARTITION BY train ORDER BY time DESC, announcement_id) = 1""",
        "train_rows",
    ),
)
def w1(spark, d):
    return feeds.latest(_trains(spark, d), "train", "time", "announcement_id").withColumn("time", stamp("time"))


@query(
    "F22_wind_direction",
    sql(
        """SELECT event_id, wind_dir, coalesce(['N','NE','E','SE','S','SW','W','NW'][CAST(floor(wind_dir / 45.0e0 + 0.5e0) AS INT) % 8 + 1], '') AS wind_sector
           FROM weather""",
        "weather",
    ),
)
def f22(spark, d):
    direction = F.get(F.col("Observation.Wind"), F.lit(0))["Direction"]["Value"]
    return views.weather(spark, d).select(
        "event_id", direction.alias("wind_dir"), expressions.wind_direction(direction).alias("wind_sector")
    )


AIR = "CASE WHEN air_temp < 0 THEN 'freezing' WHEN air_temp < 10 THEN 'cold' WHEN air_temp < 20 THEN 'mild' ELSE 'warm' END AS air_class"


@query("F23_air_class", sql(f"SELECT event_id, {AIR} FROM weather", "weather"))
def f23(spark, d):
    air = F.col("Observation.Air.Temperature.Value")
    return views.weather(spark, d).select("event_id", expressions.air_class(air).alias("air_class"))


@query(
    "F24_weather_rows",
    sql(
        f"""SELECT id, name, lon, lat, round(air_temp, 4) AS air_temp, round(surface_temp, 4) AS surface_temp, humidity, visibility, wind_speed, wind_dir,
                   precipitation, {STAMP.format('sample')} AS sample,
                   coalesce(['N','NE','E','SE','S','SW','W','NW'][CAST(floor(wind_dir / 45.0e0 + 0.5e0) AS INT) % 8 + 1], '') AS wind_sector, {AIR}
            FROM weather""",
        "weather",
    ),
)
def f24(spark, d):
    rows = feeds.weather_rows(views.weather(spark, d))
    return rows.withColumns(
        {"sample": stamp("sample"), "air_temp": F.round("air_temp", 4), "surface_temp": F.round("surface_temp", 4)}
    )


# --- points --------------------------------------------------------------------------


@query("S11_point_scan", sql("SELECT CAST(tile AS VARCHAR) AS tile, node_key, x, y, z, red, green, blue, intensity FROM points", "points"))
def s11(spark, d):
    folder = landing.new_folder(spark, "points")
    views.points(spark, d).withColumn("tile", F.col("tile").cast("string")).write.parquet(folder)
    return feed_readers.read_points(spark, folder)


@query("A18_points_per_node", sql("SELECT tile, node_key, count(*) AS points FROM points GROUP BY ALL", "points"))
def a18(spark, d):
    return points.node_counts(views.points(spark, d))


CORNER = "SELECT tile, count(*) AS points, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z FROM points GROUP BY tile"


@query("A18_tile_summary", sql(CORNER, "points"))
def a18b(spark, d):
    return points.tile_summary(views.points(spark, d))


@query(
    "F27_scene_position",
    sql(f"SELECT point_id, x - min_x AS px, z - min_z AS py, -(y - min_y) AS pz FROM points JOIN ({CORNER}) USING (tile)", "points"),
)
def f27(spark, d):
    return points.scene(views.points(spark, d)).select("point_id", "px", "py", "pz")


@query(
    "F28_point_colour",
    sql(
        f"""SELECT point_id, round(CASE WHEN red IS NOT NULL THEN red / 65535.0e0 WHEN intensity IS NOT NULL THEN intensity / 65535.0e0 ELSE h END, 6) AS r,
                   round(CASE WHEN red IS NOT NULL THEN green / 65535.0e0 WHEN intensity IS NOT NULL THEN intensity / 65535.0e0 ELSE 0.5e0 END, 6) AS g,
                   round(CASE WHEN red IS NOT NULL THEN blue / 65535.0e0 WHEN intensity IS NOT NULL THEN intensity / 65535.0e0 ELSE 1 - h END, 6) AS b
            FROM (SELECT *, ((z - min_z) % 50) / 50.0e0 AS h FROM points JOIN ({CORNER}) USING (tile))""",
        "points",
    ),
)
def f28(spark, d):
    return points.scene(views.points(spark, d)).select("point_id", *[F.round(c, 6).alias(c) for c in "rgb"])


def _laid_out(spark, d):
    folder = landing.new_folder(spark, "points")
    points.write_points(views.points(spark, d).drop("point_id").withColumn("tile", F.col("tile").cast("string")), folder)
    return feed_readers.read_laid_out_points(spark, folder)


@query("S11_points_of_tiles", sql("SELECT CAST(tile AS VARCHAR) AS tile, node_key, x, y, z FROM points WHERE tile % 7 = 3", "points"))
def s11b(spark, d):
    """Points of some tiles, out of the folders that hold them."""
    tiles = views.points(spark, d).filter("tile % 7 = 3").select("tile").distinct()
    return points.of_tiles(_laid_out(spark, d), tiles).select("tile", "node_key", "x", "y", "z")


@query(
    "O7_coarse_folders",
    sql("SELECT CAST(tile AS VARCHAR) AS tile, node_key, depth, count(*) AS points FROM points WHERE depth <= 3 GROUP BY ALL", "points"),
)
def o7b(spark, d):
    """Coarse nodes of a point table laid out by depth: only their folders are read."""
    return points.coarse_nodes(_laid_out(spark, d))


@query(
    "O7_coarse_nodes",
    sql("SELECT tile, node_key, depth, count(*) AS points FROM points WHERE depth <= 3 GROUP BY ALL ORDER BY depth, tile, node_key", "points"),
)
def o7(spark, d):
    return points.coarse_nodes(views.points(spark, d))
