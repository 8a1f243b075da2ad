"""Point-cloud tables: summaries, scene coordinates, colours, coarse nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import points as P
from ..session import cut_lineage

MAX_DEPTH = 3


def node_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("tile", "node_key").agg(F.count(F.lit(1)).alias("points"))


def tile_summary(points: DataFrame) -> DataFrame:
    """Points and minimum corner per tile."""
    return points.groupBy("tile").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.min("z").alias("min_z"),
    )


def scene(points: DataFrame) -> DataFrame:
    """Scene position and colour of every point, relative to its tile's corner.

    The corners are one row per tile. They are written out first, so that their size
    is known when the join is planned: few tiles are broadcast, many are not.
    """
    corners = cut_lineage(tile_summary(points).drop("points"))
    at = {axis: F.col(f"min_{axis}") for axis in "xyz"}
    joined = points.join(corners, "tile")
    return joined.withColumns(
        {
            **P.scene_position(F.col("x"), F.col("y"), F.col("z"), at),
            **P.colour(
                F.col("red"), F.col("green"), F.col("blue"), F.col("intensity"), F.col("z") - at["z"]
            ),
        }
    ).drop("min_x", "min_y", "min_z")


TILE_PARTS = 32


def tile_part(tile: Column) -> Column:
    """The part of a point table that holds a tile."""
    return F.pmod(F.xxhash64(tile.cast("string")), F.lit(TILE_PARTS)).cast("int")


def write_points(points: DataFrame, path: str) -> None:
    """Points as Parquet in folders by octree depth and part of the tiles, sorted by tile and node in each file.

    Coarse nodes, which are read first, lie in few folders of their own. Rows are dealt by node within a depth, so neither a
    large tile nor a deep level is written by one task.
    """
    laid_out = points.withColumns({"depth": P.depth(F.col("node_key")), "tile_part": tile_part(F.col("tile"))})
    dealt = laid_out.repartition("depth", "tile_part", "node_key").sortWithinPartitions("depth", "tile_part", "tile", "node_key")
    dealt.write.partitionBy("depth", "tile_part").parquet(path)


def of_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """The points of the chosen tiles. Of a written point table only the folders that can hold them are read: Spark tells
    these from the tiles when it runs."""
    chosen = tiles.select(F.col("tile").cast("string").alias("tile")).distinct().withColumn("tile_part", tile_part(F.col("tile")))
    keys = ["tile_part", "tile"] if "tile_part" in points.columns else ["tile"]
    return points.join(chosen, keys, "left_semi")


def coarse_nodes(points: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Non-empty nodes up to a depth, the coarse ones first. Of a written point table only the folders of these depths are read."""
    depth = F.col("depth") if "depth" in points.columns else P.depth(F.col("node_key"))
    counted = points.filter(depth <= max_depth).groupBy("tile", "node_key").agg(F.count(F.lit(1)).alias("points"))
    return counted.withColumn("depth", P.depth(F.col("node_key"))).orderBy("depth", "tile", "node_key")
