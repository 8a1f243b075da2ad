"""Streams run to the end of their input and compared with the batch form, registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds
from ..streaming import live
from . import landing, views
from .feed_queries import CLASSES
from .layer_queries import STAMP, stamp
from .registry import query
from .source_queries import PER_ORDER, _publisher
from .view_sql import sql


def _stream(spark, d, name: str):
    """A generated table as a file stream."""
    schema = views.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _finish(started) -> None:
    started.awaitTermination()


@query(
    "T1_live_trains",
    sql(
        f"""SELECT train, announcement_id, lon, lat, station_name, origin, destination, delay, operator, {STAMP.format('time')} AS time, {CLASSES}
            FROM train_rows WHERE time > (SELECT max(time) FROM train_rows) - INTERVAL 7 DAY
            QUALIFY row_number() OVER (PARTITION BY train ORDER BY time DESC, announcement_id) = 1""",
        "train_rows",
    ),
)
def t1(spark, d):
    arriving = _stream(spark, d, "events").selectExpr(*views.ANNOUNCEMENT_COLUMNS)
    stations = feeds.advertised_stations(views.stations(spark, d))
    started, table = live.live_trains(
        arriving, stations, landing.new_folder(spark, "trains"), landing.new_folder(spark, "trains-state"), available_now=True
    )
    _finish(started)
    return table.read().withColumn("time", stamp("time"))


@query(
    "T1_current_trains",
    sql(
        """SELECT train, announcement_id FROM (SELECT * FROM train_rows QUALIFY row_number() OVER (PARTITION BY train ORDER BY time DESC, announcement_id) = 1)
           WHERE time > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 15 MINUTE AND time < TIMESTAMP '2024-01-30 00:00:00' + INTERVAL 5 MINUTE""",
        "train_rows",
    ),
)
def t1b(spark, d):
    arriving = _stream(spark, d, "events").selectExpr(*views.ANNOUNCEMENT_COLUMNS)
    stations = feeds.advertised_stations(views.stations(spark, d))
    started, table = live.live_trains(
        arriving, stations, landing.new_folder(spark, "trains"), landing.new_folder(spark, "trains-state"), available_now=True
    )
    _finish(started)
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return live.current_trains(table, now).select("train", "announcement_id")


@query(
    "T1_train_horizons",
    sql(
        f"""SELECT {STAMP.format('window_start')} AS window_start, train, announcement_id, station_name, delay
            FROM (
              SELECT *, time_bucket(INTERVAL 5 MINUTE, time) - to_minutes(CAST(5 * k AS INT)) AS window_start
              FROM train_rows, range(4) AS r(k)) x
            WHERE window_start + INTERVAL 20 MINUTE <= (SELECT max(time) - INTERVAL 15 MINUTE FROM train_rows)
            QUALIFY row_number() OVER (PARTITION BY window_start, train ORDER BY time DESC, announcement_id) = 1""",
        "train_rows",
    ),
)
def t1c(spark, d):
    """Sliding horizons that the watermark has passed, each written once."""
    arriving = _stream(spark, d, "events").selectExpr(*views.ANNOUNCEMENT_COLUMNS)
    path = landing.new_folder(spark, "horizons")
    stations = feeds.advertised_stations(views.stations(spark, d))
    _finish(live.train_horizons(arriving, stations, path, landing.new_folder(spark, "horizons-state"), available_now=True))
    rows = spark.read.parquet(path)
    return rows.select(stamp("window_start"), "train", "announcement_id", "station_name", "delay")


@query(
    "T2_live_weather",
    sql(
        f"""SELECT id, event_id, name, lon, lat, round(air_temp, 4) AS air_temp, wind_dir, precipitation, {STAMP.format('sample')} AS sample
            FROM weather WHERE weather.sample > (SELECT max(w.sample) FROM weather w) - INTERVAL 7 DAY
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY weather.sample DESC, event_id) = 1""",
        "weather",
    ),
)
def t2(spark, d):
    arriving = _stream(spark, d, "events").selectExpr(*views.WEATHER_COLUMNS)
    started, table = live.live_weather(
        arriving, landing.new_folder(spark, "weather"), landing.new_folder(spark, "weather-state"), tie="event_id", available_now=True
    )
    _finish(started)
    shown = table.read().select("id", "event_id", "name", "lon", "lat", "air_temp", "wind_dir", "precipitation", "sample")
    return shown.withColumns({"sample": stamp("sample"), "air_temp": F.round("air_temp", 4)})


@query("T3_delivery_watch", f"SELECT order_id, table_name, feature_count FROM ({PER_ORDER})")
def t3(spark, d):
    publisher = _publisher(spark, d)
    _finish(live.watch_deliveries(publisher, landing.new_folder(spark, "watch-state"), available_now=True))
    return publisher.ledger.read().select("order_id", "table_name", "feature_count")


@query("T4_update_watch", sql(f"SELECT DISTINCT order_id, title, {STAMP.format('updated')} AS updated FROM listing", "listing"))
def t4(spark, d):
    arriving = _stream(spark, d, "lineitem").selectExpr(
        "concat('o', l_orderkey % 200) AS order_id",
        "concat('f', l_partkey, element_at(array('.gpkg', '.laz', '.tif', '.jp2', '.txt'), l_linenumber % 5 + 1)) AS title",
        "CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS updated",
        "_metadata.file_modification_time AS seen_at",
    )
    path = landing.new_folder(spark, "updates")
    _finish(live.watch_updates(arriving, path, landing.new_folder(spark, "updates-state"), available_now=True))
    return live.sent_updates(spark, path, arriving.schema).select("order_id", "title", stamp("updated"))
