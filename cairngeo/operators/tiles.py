"""LiDAR tiles: boxes, polygons, totals, download and conversion state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, crs, text
from ..functions import geometry as G


def parsed(tiles: DataFrame) -> DataFrame:
    """Tile titles that are tiles, with their grid numbers."""
    return tiles.filter(F.endswith(F.col("title"), F.lit(text.TILE_ENDING))).withColumns(
        text.grid_numbers(F.col("title"), F.col("index_name"))
    )


def with_boxes(tiles: DataFrame) -> DataFrame:
    """Metric box and size in MB."""
    return tiles.withColumns(
        {**cells.tile_box(F.col("grid_x"), F.col("grid_y")), "size_mb": text.size_mb(F.col("size"))}
    )


def with_polygons(tiles: DataFrame) -> DataFrame:
    """Polygon in degrees through the two transformed corners of the box."""
    west, south = crs.grid_to_lonlat("double(xmin)", "double(ymin)")
    east, north = crs.grid_to_lonlat("double(xmax)", "double(ymax)")
    corners = tiles.withColumns({"west": west, "south": south, "east": east, "north": north})
    return corners.withColumn("geom", G.box(*[F.col(c) for c in ("west", "south", "east", "north")]))


def totals(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum("size").alias("total_size"),
        text.size_mb(F.sum("size")).alias("total_size_mb"),
    )


def fit_box(tiles: DataFrame) -> DataFrame:
    """Box in degrees around all tile polygons."""
    ring = tiles.select(F.explode(G.vertices("geom")).alias("v"))
    return ring.agg(
        F.min("v.x").alias("west"),
        F.min("v.y").alias("south"),
        F.max("v.x").alias("east"),
        F.max("v.y").alias("north"),
    )


def downloaded_flags(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """1 for a tile whose file is there, else 0."""
    there = files.select("order_id", "title").distinct().withColumn("downloaded", F.lit(1))
    return tiles.join(there, ["order_id", "title"], "left").withColumn(
        "downloaded", F.coalesce("downloaded", F.lit(0))
    )


def converted_flags(files: DataFrame, converted: DataFrame) -> DataFrame:
    """Downloaded tiles with whether a converted file exists, and its name."""
    ready = (
        converted.select("order_id", text.source_tile(F.col("copc_name")).alias("title"), "copc_name")
        .distinct()
        .withColumn("copc_ready", F.lit(True))
    )
    return files.join(ready, ["order_id", "title"], "left").select(
        *[files[c] for c in files.columns],
        F.coalesce("copc_ready", F.lit(False)).alias("copc_ready"),
        F.col("copc_name").alias("copc_filename"),
        text.size_mb(F.col("size"), 1).alias("size_mb"),
    )
