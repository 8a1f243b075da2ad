"""GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .layers import match_count, page, properties


def feature_text(df: DataFrame, bookkeeping: bool = True) -> Column:
    """GeoJSON Feature of each row; missing attributes are written as null."""
    names = properties(df, bookkeeping).columns
    attributes = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return F.concat(
        F.lit('{"type":"Feature","id":'),
        F.col("fid"),
        F.lit(',"geometry":'),
        F.coalesce(G.as_geojson("geom"), F.lit("null")),
        F.lit(',"properties":'),
        attributes,
        F.lit("}"),
    )


def to_geojson(df: DataFrame, bookkeeping: bool = True) -> DataFrame:
    """One Feature per row in the column ``value``."""
    return df.select(feature_text(df, bookkeeping).alias("value"))


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A Feature per line, a file per task."""
    to_geojson(df).write.mode(mode).text(path)


def feature_collection(found: DataFrame, limit: int, offset: int = 0, bookkeeping: bool = True) -> DataFrame:
    """A page of the matching features as one collection with the count of all matches.

    The page's bounds are those of :func:`layers.page`, which refuses a larger page; so nothing is cut
    unasked, and the one row this makes is bounded.
    """
    shown, total = page(found, limit, offset), match_count(found)
    one = shown.select("fid", feature_text(shown, bookkeeping).alias("value"))
    whole = one.agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("rows"))
    features = F.array_join(F.transform("rows", lambda r: r["value"]), ",")
    count = total.select(F.col("total_count").alias("n"), F.lit(1).alias("k"))
    return (
        whole.withColumn("k", F.lit(1))
        .join(count, "k")
        .select(
            F.concat(
                F.lit('{"type":"FeatureCollection","features":['),
                features,
                F.lit('],"total_count":'),
                F.col("n"),
                F.lit("}"),
            ).alias("value")
        )
    )
