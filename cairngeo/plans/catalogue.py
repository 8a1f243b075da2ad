"""All registered queries, by importing the modules that register them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layers
from ..session import configure
from . import delivery_queries, feed_queries, layer_queries, source_queries, stream_queries, views
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "delivery_queries", "feed_queries", "layer_queries", "source_queries", "stream_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding-box page of the point layer: id, properties and GeoJSON geometry."""
    found = layers.bbox_filter(views.point_layer(configure(spark), sf_dir), layer_queries.BOX)
    geometry = G.as_geojson("geom").alias("geometry")
    return layers.page(found).select("fid", "c_name", "c_acctbal", "c_mktsegment", geometry)
