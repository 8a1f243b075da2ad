"""Ledger of loaded layers: what was loaded from which file, and what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["order_id", "layer_name"]

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("layer_name", T.StringType()),
        T.StructField("feature_count", T.LongType()),
        T.StructField("bbox", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)


def upserted(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows not replaced by a new one, and the new ones."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def published_flags(layers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each order's layer with whether the ledger has it."""
    known = ledger.select(*KEY, F.lit(True).alias("is_published"))
    return layers.join(known, KEY, "left").withColumn(
        "is_published", F.coalesce("is_published", F.lit(False))
    )


def stale(ledger: DataFrame, folders: DataFrame) -> DataFrame:
    """Ledger rows of orders whose folder is gone."""
    return ledger.join(folders.select("order_id"), "order_id", "left_anti")


def due(candidates: DataFrame, ledger: DataFrame, by_hash: bool = True) -> DataFrame:
    """Layers not in the ledger; with ``by_hash`` also those loaded from other bytes."""
    keys = [*KEY, "source_hash"] if by_hash else KEY
    return candidates.join(ledger.select(*keys), keys, "left_anti")


def status(ledger: DataFrame) -> DataFrame:
    """Orders, tables, features, latest load; zeros on an empty ledger."""
    return ledger.agg(
        F.countDistinct("order_id").alias("orders_processed"),
        F.countDistinct("table_name").alias("total_tables"),
        F.coalesce(F.sum("feature_count"), F.lit(0)).alias("total_features"),
        F.max("loaded_at").alias("last_processed"),
    )


def order_totals(ledger: DataFrame) -> DataFrame:
    """Layers and features per order, and the grand total under a null order."""
    per_order = ledger.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("layers"), F.sum("feature_count").alias("total_features")
    )
    return per_order.rollup("order_id").agg(
        F.coalesce(F.sum("layers"), F.lit(0)).alias("layers"),
        F.coalesce(F.sum("total_features"), F.lit(0)).alias("total_features"),
    )


def order_layers(ledger: DataFrame) -> DataFrame:
    """The layer list of each order, a row per layer beside the order's totals.

    Kept long: an order may hold a large share of all layers, and an array would
    put it in one row of one task.
    """
    totals = ledger.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("layers"), F.coalesce(F.sum("feature_count"), F.lit(0)).alias("total_features")
    )
    return ledger.select("order_id", "layer_name", "feature_count").join(totals, "order_id")


def listing(ledger: DataFrame, order_id: str | None = None) -> DataFrame:
    """Ledger in (order, layer) order, or one order's rows by layer."""
    columns = ["order_id", "source_file", "source_hash", "table_name", "layer_name", "feature_count", "loaded_at"]
    if order_id is not None:
        return ledger.filter(F.col("order_id") == order_id).select(*columns).orderBy("layer_name")
    return ledger.select(*columns).orderBy("order_id", "layer_name")


def layer_names(*catalogues: DataFrame) -> DataFrame:
    """Distinct (order_id, layer_name) over any number of catalogues."""
    whole = catalogues[0].select(*KEY)
    for catalogue in catalogues[1:]:
        whole = whole.unionByName(catalogue.select(*KEY))
    return whole.distinct()


def missing_orders(ledger: DataFrame, folders: DataFrame) -> DataFrame:
    """Orders in the ledger without a folder."""
    return ledger.select("order_id").distinct().join(folders.select("order_id"), "order_id", "left_anti")


def existing_layers(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested layers that exist."""
    return requested.select("layer_name").distinct().join(
        available.select("layer_name").distinct(), "layer_name", "left_semi"
    )
