"""Delivery tables: file types, totals, statistics, transfer plans, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, text

# Note on an order without a local delivery; box used when a corner is out of range.
NO_LOCAL_NOTE = "All files (no local download)"
FALLBACK_BOX = {"south": 55.3, "west": 10.9, "north": 69.1, "east": 24.2}


# --- types -----------------------------------------------------------------------


def dominant_type(members: DataFrame, hints: DataFrame) -> DataFrame:
    """Most common data type per order.

    ``members`` has order_id, zip_name, entry and extension; ``hints`` has the
    metadata keys, a row per metadata file. Of several files of an order that name
    a product, the data type that sorts first is its hint. Elevation rasters count as orthophotos
    where the hint says so; equal counts go to the type met first; an order with
    no typed file takes its hint. Counting by (order, type) first leaves a
    handful of rows per order for the pick, however many files it has.
    """
    hint = hints.groupBy("order_id").agg(F.min(text.product_hint([F.col(k) for k in text.HINT_KEYS])).alias("hint"))
    relabelled = F.when((F.col("kind") == "raster_dem") & (F.col("hint") == "raster_ortho"), "raster_ortho")
    counts = (
        members.withColumn("kind", text.data_type(F.col("extension")))
        .groupBy("order_id", "kind")
        .agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("zip_name", "entry")).alias("first"))
        .join(hint, "order_id", "full")
        .withColumn("kind", F.coalesce(relabelled, "kind"))
        .groupBy("order_id", "kind")
        .agg(F.sum("files").alias("files"), F.min("first").alias("first"), F.max("hint").alias("hint"))
    )
    # rows without a kind have no rank, so the pick passes over them
    rank = F.when(F.col("kind").isNotNull(), F.struct(-F.col("files"), F.col("first")))
    best = counts.groupBy("order_id").agg(
        F.min_by(F.struct("kind", "files"), rank).alias("best"), F.max("hint").alias("hint")
    )
    kind = F.coalesce(F.col("best.kind"), F.col("hint"), F.lit("unknown"))
    return best.select(
        "order_id",
        kind.alias("data_type"),
        text.type_label(kind).alias("data_type_label"),
        text.is_publishable(kind).alias("is_publishable"),
        F.coalesce(F.col("best.files"), F.lit(0)).alias("files_of_type"),
    )


def publishable(types: DataFrame) -> DataFrame:
    return types.filter(text.is_publishable(F.col("data_type")))


def index_first(types: DataFrame, tiles: DataFrame) -> DataFrame:
    """Orders with a tile index are index orders, whatever archives lie beside it."""
    indexed = tiles.groupBy("order_id").agg(F.count(F.lit(1)).alias("tiles"))
    kind = F.when(F.col("tiles") > 0, "lidar_index").otherwise(F.coalesce("data_type", F.lit("unknown")))
    return types.join(indexed, "order_id", "full").select(
        "order_id",
        kind.alias("data_type"),
        text.type_label(kind).alias("data_type_label"),
        text.is_publishable(kind).alias("is_publishable"),
        F.coalesce("tiles", F.lit(0)).alias("tiles"),
    )


def order_overview(
    types: DataFrame, files: DataFrame, ledger: DataFrame, labels: DataFrame, tiles: DataFrame
) -> DataFrame:
    """Orders by name: type, files, size, published layers, package name.

    An order with a tile index has its tiles for files, whatever else lies beside them. The
    published layers themselves are the ledger's rows; here they are counted.
    """
    whole = files.groupBy("order_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("size"))
    indexed = tiles.groupBy("order_id").agg(F.count(F.lit(1)).alias("tile_files"), F.sum("size").alias("tile_size"))
    sizes = whole.join(indexed, "order_id", "full").select(
        "order_id",
        F.coalesce("tile_files", "files").alias("file_count"),
        F.when(F.col("tile_files").isNotNull(), F.col("tile_size")).otherwise(F.col("size")).alias("bytes"),
    )
    published = ledger.groupBy("order_id").agg(F.count(F.lit(1)).alias("published_layers"))
    joined = types.join(sizes, "order_id", "left").join(published, "order_id", "left").join(labels, "order_id", "left")
    return joined.select(
        "order_id",
        "data_type",
        "data_type_label",
        "is_publishable",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        text.size_mb(F.coalesce("bytes", F.lit(0))).alias("total_size_mb"),
        F.coalesce("published_layers", F.lit(0)).alias("published_layers"),
        F.col("published_layers").isNotNull().alias("is_published"),
        F.coalesce("package_name", F.lit("")).alias("package_name"),
    ).orderBy("order_id")


# --- statistics ------------------------------------------------------------------


def object_count(stats: Column) -> Column:
    """Objects over the nested per-table statistics of one file."""
    return F.coalesce(
        F.aggregate(stats, F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(s["objects"], F.lit(0))),
        F.lit(0).cast("bigint"),
    )


def object_text(stats: Column) -> Column:
    """``table: n`` list of one file, a dash when there is none."""
    items = F.transform(
        stats,
        lambda s: F.concat(
            F.coalesce(s["table"], F.lit("?")), F.lit(": "), text.grouped(F.coalesce(s["objects"], F.lit(0)))
        ),
    )
    return F.when(F.size(stats) > 0, F.array_join(items, ", ")).otherwise(F.lit("-"))


def with_statistics(listing: DataFrame, stats: DataFrame) -> DataFrame:
    """Listed files with their object count and text; files without statistics have 0 and a dash."""
    per_file = stats.select(
        "order_id",
        F.col("filename").alias("title"),
        object_count(F.col("statistics")).alias("objects"),
        object_text(F.col("statistics")).alias("objects_text"),
    )
    joined = listing.join(per_file, ["order_id", "title"], "left")
    return joined.withColumns(
        {
            "objects": F.coalesce("objects", F.lit(0)),
            "objects_text": F.coalesce("objects_text", F.lit("-")),
        }
    )


def delivery_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and objects per order, and overall under a null order."""
    per_order = files.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum("objects").alias("objects")
    )
    # the roll-up doubles the rows of its input, so it reads the order sums
    return per_order.rollup("order_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "bytes", "objects")]
    )


def delivery_bounds(features: DataFrame) -> DataFrame:
    """Corners in degrees of the polygons of each order (metric coordinates in)."""
    ring = features.filter(F.col("geometry.type") == "Polygon").select(
        "order_id", F.explode("geometry.coordinates").alias("ring")
    )
    corner = ring.select("order_id", F.explode("ring").alias("v"))
    box = corner.groupBy("order_id").agg(
        F.min(F.col("v")[0]).alias("min_e"),
        F.min(F.col("v")[1]).alias("min_n"),
        F.max(F.col("v")[0]).alias("max_e"),
        F.max(F.col("v")[1]).alias("max_n"),
    )
    moved = box.select(
        "order_id",
        crs.sweref_to_wgs84("min_e", "min_n").alias("sw"),
        crs.sweref_to_wgs84("max_e", "max_n").alias("ne"),
    )
    good = F.col("sw").isNotNull() & F.col("ne").isNotNull()

    def pick(corner_value: str, fallback: str) -> Column:
        return F.when(good, F.col(corner_value)).otherwise(F.lit(FALLBACK_BOX[fallback])).alias(fallback)

    return moved.select(
        "order_id", pick("sw.lat", "south"), pick("sw.lon", "west"), pick("ne.lat", "north"), pick("ne.lon", "east")
    )


# --- local files and transfers -----------------------------------------------------


def local_status(listing: DataFrame, local: DataFrame) -> DataFrame:
    """Listed files with OK or Missing."""
    return _with_local(listing, local).withColumn(
        "status", F.when(F.col("exists"), "OK").otherwise("Missing")
    )


def _with_local(listing: DataFrame, local: DataFrame) -> DataFrame:
    there = local.select("order_id", "title").distinct().withColumn("exists", F.lit(True))
    return listing.join(there, ["order_id", "title"], "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def transfer_plan(listing: DataFrame, local: DataFrame, folders: DataFrame) -> DataFrame:
    """Fetch or skip for each listed file.

    A missing file is fetched. A present one is skipped when it carries no
    update time or one not after the last delivery, else fetched.
    """
    last = folders.select("order_id", "download_date")
    skip = F.col("exists") & (
        F.col("updated").isNull() | F.coalesce(F.col("updated") <= F.col("download_date"), F.lit(False))
    )
    return (
        _with_local(listing, local)
        .join(last, "order_id", "left")
        .withColumn("action", F.when(skip, "skip").otherwise("fetch"))
    )


def transfer_summary(plan: DataFrame) -> DataFrame:
    fetch = F.col("action") == "fetch"
    return plan.agg(
        F.count_if(fetch).alias("to_fetch"),
        F.count_if(~fetch).alias("skipped"),
        F.coalesce(F.sum(F.when(fetch, F.col("length"))), F.lit(0)).alias("fetch_bytes"),
    )


def newer_files(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Listed files updated after their order's last delivery, a row per file."""
    last = folders.select("order_id", "download_date")
    return listing.join(last, "order_id").filter(F.col("updated") > F.col("download_date"))


def update_check(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Per order: local and remote date, whether there is an update, how many files are newer.

    The titles themselves are :func:`newer_files`, a row each, since one order
    may hold a large share of all files.
    """
    remote = listing.groupBy("order_id").agg(F.max("updated").alias("remote_date"))
    newer = newer_files(listing, folders).groupBy("order_id").agg(F.count(F.lit(1)).alias("newer_files"))
    local = folders.select("order_id", F.col("download_date").alias("local_date"), F.lit(True).alias("known"))
    joined = remote.join(local, "order_id", "full").join(newer, "order_id", "left")
    unknown = F.col("known").isNull()
    return joined.select(
        "order_id",
        "local_date",
        F.when(~unknown, F.col("remote_date")).alias("remote_date"),
        F.coalesce(unknown | (F.col("remote_date") > F.col("local_date")), F.lit(False)).alias("has_update"),
        F.coalesce("newer_files", F.lit(0)).alias("newer_files"),
        F.when(unknown, NO_LOCAL_NOTE).alias("note"),
    )


# --- run outcomes ------------------------------------------------------------------


def run_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Succeeded, failed, skipped and features per run; skipped layers count neither way."""
    done = F.col("status") != "skipped"
    return (
        report.groupBy(*keys)
        .agg(
            F.count_if(F.col("status") == "ok").alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if(done).alias("total"),
            F.count_if(~done).alias("skipped"),
            F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("feature_count"))), F.lit(0)).alias(
                "total_features"
            ),
        )
        .withColumn("all_success", F.col("failed") == 0)
        .withColumn(
            "error",
            F.when(F.col("failed") > 0, F.concat(F.lit("Failed layers ("), F.col("failed"), F.lit(")"))),
        )
    )


def run_errors(report: DataFrame) -> DataFrame:
    """One line of error text per failed layer; an order that was refused as a whole stands under its own name."""
    return report.filter(F.col("status") == "failed").select(
        "order_id",
        "layer_name",
        F.concat(F.coalesce("layer_name", "order_id"), F.lit(": "), F.coalesce("error", F.lit("Unknown error"))).alias("error_text"),
    )
