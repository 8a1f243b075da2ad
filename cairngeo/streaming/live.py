"""Feeds and deliveries kept current with Structured Streaming.

Each stream reduces its rows to the newest per key within windows behind a watermark, so its state is bounded by the keys
seen in that time. A batch enters its own rows into the log of a current table, nothing else is rewritten; which row of a
key is newest follows from its time and not from the batch, so a batch that is run again, or late, changes
nothing, and no lookup and no state per key are needed. Keys not seen for ``EXPIRY`` leave the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import feeds
from ..operators.entrylog import MARKS, LatestLog, SentLog
from ..operators.publish import Publisher
from ..sources import files
from ..sources.deliveries import order_of

WATERMARK, WINDOW = "15 minutes", "5 minutes"
HORIZON, HORIZON_STEP = "20 minutes", "5 minutes"
FILES_PER_TRIGGER = 1000  # paces a stream, the rest follows in the next batch
PARTS = 16
EXPIRY = "7 days"


def newest_in_window(
    rows: DataFrame, key: str, time: str, tie: str, width: str = WINDOW, step: str | None = None, keep_window: bool = False
) -> DataFrame:
    """Last row per key and window; windows follow one another, or begin every ``step``."""
    payload = [c for c in rows.columns if c != key]
    newest = F.struct(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), (-F.col(tie)).alias("first"))
    timed = rows.withColumn("_event", F.col(time).cast("timestamp")).withWatermark("_event", WATERMARK)
    found = timed.groupBy(F.window("_event", width, step), key).agg(F.max_by(F.struct(*payload), newest).alias("row"))
    shown = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")] if keep_window else []
    return found.select(*shown, key, "row.*")


def enter(table: LatestLog) -> Callable[[DataFrame, int], None]:
    """Batch function that enters the newest row per key of the batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = feeds.latest(batch.select(*table.schema.fieldNames()), table.keys[0], table.time_col, table.tie)
        table.spark = batch.sparkSession
        table.upsert(rows)

    return run


def _start(
    df: DataFrame, run, checkpoint: str, available_now: bool, mode: str = "update", every: str = "10 seconds"
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def live_trains(
    announcements: DataFrame,
    stations: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    expiry: str | None = EXPIRY,
) -> tuple[StreamingQuery, LatestLog]:
    """Newest train row per train; ``stations`` is the static, advertised dimension."""
    rows = feeds.train_rows(announcements, stations)
    newest = newest_in_window(rows, "train", "time", "announcement_id")
    table = LatestLog(announcements.sparkSession, path, newest.schema, "train", "time", "announcement_id", expiry)
    return _start(newest, enter(table), checkpoint, available_now), table


def train_horizons(
    announcements: DataFrame, stations: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Newest row per train of each horizon of 20 minutes, one beginning every 5, appended as Parquet.

    A horizon is written once, when the watermark has passed its end; its state is dropped with it.
    """
    rows = feeds.train_rows(announcements, stations)
    newest = newest_in_window(rows, "train", "time", "announcement_id", HORIZON, HORIZON_STEP, keep_window=True)
    writer = newest.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def current_trains(table: LatestLog, now: Column) -> DataFrame:
    """Trains of the current table whose last announcement lies in the horizon."""
    return table.read().filter(feeds.in_horizon(F.col("time"), now))


def live_weather(
    points: DataFrame,
    path: str,
    checkpoint: str,
    tie: str = "sequence",
    available_now: bool = False,
    expiry: str | None = EXPIRY,
) -> tuple[StreamingQuery, LatestLog]:
    """Newest observation per weather point. ``tie`` is a number column that orders equal times."""
    newest = newest_in_window(feeds.weather_rows(points, (tie,)), "id", "sample", tie)
    table = LatestLog(points.sparkSession, path, newest.schema, "id", "sample", tie, expiry)
    return _start(newest, enter(table), checkpoint, available_now), table


def watch_deliveries(publisher: Publisher, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Publish the orders whose archives arrive; unchanged layers are skipped by their hash."""
    spark: SparkSession = publisher.spark
    base = files.qualified(spark, publisher.root)
    arrived = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        .load(publisher.root)
        .select("path")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        orders = batch.select(order_of(F.col("path"), base).alias("order_id")).distinct()
        names = [row["order_id"] for row in orders.collect()]  # at most one per file of the trigger
        if names:
            publisher.publish_orders(names)

    return _start(arrived, run, checkpoint, available_now, mode="append")


UPDATE_KEY = ["order_id", "title", "updated"]


def sent_log(spark: SparkSession, path: str, schema: T.StructType, **options) -> SentLog:
    return SentLog(spark, path, schema, UPDATE_KEY, "order_id", PARTS, **options)


def watch_updates(
    listings: DataFrame, path: str, checkpoint: str, seen_at: str = "seen_at", available_now: bool = False
) -> StreamingQuery:
    """New or changed files of listing snapshots, each once.

    What was sent is a log of batches with a summary each of the orders in it. A batch is anti-joined with the folders that may hold
    its orders, and there with the parts these fall into, so a file is sent once however long it stays unchanged or
    how late a snapshot comes. Folders of batches are folded, so their number stays bounded. A batch that is
    repeated takes the place of its own folder.
    """
    log = sent_log(listings.sparkSession, path, listings.schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in (*UPDATE_KEY, seen_at)]
        first = batch.groupBy(*UPDATE_KEY).agg(F.min(F.struct(seen_at, *others)).alias("row"))
        rows = first.select(*UPDATE_KEY, "row.*").select(*batch.columns).persist()  # used for the summary, the parts and the rows
        log.spark = batch.sparkSession
        try:
            log.add(rows, batch_id)
        finally:
            rows.unpersist()

    return _start(listings, run, checkpoint, available_now, mode="append", every="1 minute")


def sent_updates(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What :func:`watch_updates` has sent; the columns are those of the first folder unless they are given."""
    if schema is None:
        first = spark.read.parquet(f"{path}/{files.children(spark, path)[0]}").schema
        schema = T.StructType([f for f in first.fields if f.name not in (*MARKS, "_part")])
    return sent_log(spark, path, schema).read()
