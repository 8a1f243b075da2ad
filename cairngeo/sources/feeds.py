"""Train, weather and point tables from landed files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas


def _read(spark: SparkSession, path: str, schema, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def read_stations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _read(spark, path, schemas.STATION, stream)


def read_announcements(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _read(spark, path, schemas.ANNOUNCEMENT, stream)


def read_weather(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _read(spark, path, schemas.WEATHER, stream)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point tables kept as Parquet."""
    return spark.read.schema(schemas.POINTS).parquet(path)


def read_laid_out_points(spark: SparkSession, path: str) -> DataFrame:
    """Point tables as ``points.write_points`` lays them out, with ``depth`` and ``tile_part``."""
    folders = [T.StructField("depth", T.IntegerType()), T.StructField("tile_part", T.IntegerType())]
    return spark.read.schema(T.StructType([*schemas.POINTS.fields, *folders])).parquet(path)


def layer(spark: SparkSession, name: str, database: str) -> DataFrame:
    """A published layer."""
    return spark.table(f"`{database}`.`{name}`")
