"""Readers for delivery folders and the JSON files in them.

A delivery root holds one folder per order. Spark hides names that start with an
underscore as well as those that start with a dot; orders named so are listed by
their own path.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text
from . import files

INDEX_NAME = r"^\d+_\d+$"


def _roots(spark: SparkSession, root: str, order_ids: Iterable[str] | None = None) -> list[str]:
    """Folders to read: the root and its underscore orders, or only the named orders that exist."""
    base = root.rstrip("/")
    there = files.order_folders(spark, root)
    if order_ids:
        wanted = set(order_ids)
        return [f"{base}/{name}" for name in there if name in wanted]
    return [base, *(f"{base}/{name}" for name in there if name.startswith("_"))]


def order_of(path: Column, root: str) -> Column:
    """First folder below a qualified root in a full file path (which Spark gives URL-encoded)."""
    below = F.substring_index(F.replace(path, F.lit(root + "/"), F.lit("")), "/", 1)
    return F.url_decode(below)


def scan_orders(spark: SparkSession, root: str, order_ids: Iterable[str] | None = None) -> DataFrame:
    """Every file of every order, or of the named ones: order_id, path, file_name, size, modified.

    No content is read.
    """
    base = files.qualified(spark, root)
    roots = _roots(spark, root, order_ids)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load(roots) if roots else reader.load(root).limit(0)
    path = F.col("path")
    return found.filter(~F.replace(path, F.lit(base + "/"), F.lit("")).startswith(".")).select(
        order_of(path, base).alias("order_id"),
        "path",
        text.base_name(path).alias("file_name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def _json(spark: SparkSession, root: str, name: str, schema, order_ids: Iterable[str] | None = None) -> DataFrame:
    base, roots = files.qualified(spark, root), _roots(spark, root, order_ids)
    read = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(roots or root)
    )
    read = read if roots else read.limit(0)
    return read.withColumn("_order", order_of(F.col("_metadata.file_path"), base))


_UNREADABLE = r'"[^"\\\ufffd]*+(?:\\.[^"\\\ufffd]*+)*+\ufffd[^"\\]*+(?:\\.[^"\\]*+)*+"(?!\s*:)'  # a value with bytes that are no UTF-8


def _decoded(value: str) -> Column:
    """Text of a JSON document in the encodings that Spark's own reader tells from its first bytes; values it cannot read are null."""
    raw = F.col(value).cast("binary")
    start = F.hex(F.substring(raw, 1, 4))
    return (
        F.when(start.isin("0000FEFF", "FFFE0000"), F.decode(raw, "UTF-32"))
        .when(start.startswith("FEFF") | start.startswith("FFFE"), F.decode(raw, "UTF-16"))
        .when(start.startswith("00"), F.decode(raw, "UTF-16BE"))
        .when(start.like("__00%"), F.decode(raw, "UTF-16LE"))
        .when(F.is_valid_utf8(value), F.col(value))
        .otherwise(F.regexp_replace(value, _UNREADABLE, "null"))
    )


def _documents(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """As ``_json``, from whole texts: a value kept as text (here coordinates) is cut from memory.

    Spark's reader of multi-line files goes back to the file for each such value.
    """
    base, roots = files.qualified(spark, root), _roots(spark, root)
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(roots)
    value = F.regexp_replace(_decoded("value"), r"^\ufeff", "")
    many = F.regexp_like(value, F.lit(r"^\s*\["))
    order = order_of(F.col("_metadata.file_path"), base).alias("_order")
    texts = read.select(order, value.alias("value"), many.alias("many"))
    one = F.from_json("value", schema)
    return texts.select("_order", F.explode(F.when(F.col("many"), F.from_json("value", T.ArrayType(schema))).otherwise(F.array(one))).alias("document")).select(
        "_order", "document.*"
    )


def read_delivery_stats(spark: SparkSession, root: str) -> DataFrame:
    """order_id, filename, statistics (table, objects), geometry; a file named twice keeps the last."""
    feature = (
        _documents(spark, root, "uttag.json", schemas.DELIVERY_STATS)
        .select(F.col("_order").alias("order_id"), F.posexplode("features").alias("pos", "feature"))
        .filter(F.length("feature.properties.filnamn") > 0)
    )
    stats = F.transform(
        F.coalesce("feature.properties.statistik", F.array()),
        lambda s: F.struct(s["tabellnamn"].alias("table"), s["antalObjekt"].alias("objects")),
    )
    kind = F.col("feature.geometry.type")
    rings = F.when(kind == "Polygon", F.from_json("feature.geometry.coordinates", schemas.RINGS))
    shape = F.struct(kind.alias("type"), rings.alias("coordinates"))
    return (
        feature.select(
            "order_id",
            F.col("feature.properties.filnamn").alias("filename"),
            "pos",
            F.struct(stats.alias("statistics"), shape.alias("geometry")).alias("body"),
        )
        .groupBy("order_id", "filename")
        .agg(F.max_by("body", "pos").alias("body"))
        .select("order_id", "filename", "body.statistics", "body.geometry")
    )


def read_hints(spark: SparkSession, root: str, order_ids: Iterable[str] | None = None) -> DataFrame:
    """Product words of the delivery metadata, a row per file; of the named orders only, if any are named."""
    read = _json(spark, root, "uttag.json", schemas.DELIVERY_STATS, order_ids)
    return read.select(F.col("_order").alias("order_id"), *text.HINT_KEYS)


def read_tile_index(spark: SparkSession, root: str, order_ids: Iterable[str] | None = None) -> DataFrame:
    """Tiles of the index files (``NN_N``, a JSON array each): title, href, size, index name.

    Files that are no JSON array give no rows. Only the named orders are read, if any are named.
    """
    base, roots = files.qualified(spark, root), _roots(spark, root, order_ids)
    read = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_*")
        .text(roots or root)
    )
    whole = (
        (read if roots else read.limit(0))
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("index_name", text.base_name(F.col("path")))
        .filter(F.col("index_name").rlike(INDEX_NAME) & F.ltrim("value").startswith("["))
    )
    entry = whole.select(
        order_of(F.col("path"), base).alias("order_id"),
        "index_name",
        F.explode(F.from_json("value", schemas.TILE_INDEX)).alias("entry"),
    )
    return entry.filter(F.endswith(F.col("entry.title"), F.lit(text.TILE_ENDING))).select(
        "order_id",
        "index_name",
        "entry.title",
        F.coalesce("entry.href", F.lit("")).alias("href"),
        F.coalesce("entry.length", F.lit(0)).alias("size"),
    )


def read_file_listing(spark: SparkSession, root: str, name: str = "*.json") -> DataFrame:
    """Landed listings (``<order>/<name>``, an array or a line per file) with order_id and instants."""
    return shape_listing(_json(spark, root, name, schemas.FILE_ENTRY).withColumnRenamed("_order", "order_id"))


def shape_listing(entries: DataFrame) -> DataFrame:
    return entries.select(
        "order_id",
        "title",
        "href",
        "displaySize",
        text.file_length(F.col("length"), F.col("size")).alias("length"),
        text.iso_instant(F.col("updated")).alias("updated"),
    )


def read_order_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata per order: ``order_metadata.json``, else ``metadata.json``; unreadable files count as absent."""
    fields = ("download_date", "files", "total_size", "package_name")

    def read(name: str, prefix: str) -> DataFrame:
        got = _json(spark, root, name, schemas.ORDER_METADATA)
        whole = F.struct(*fields)
        readable = F.coalesce(*[F.col(f).cast("string") for f in ("order_id", "download_date", "total_size", "package_name")])
        return got.filter(readable.isNotNull() | F.col("files").isNotNull()).select(
            F.col("_order").alias("order_id"), whole.alias(prefix)
        )

    first, second = read("order_metadata.json", "a"), read("metadata.json", "b")
    return (
        first.join(second, "order_id", "full")
        .withColumn("m", F.coalesce("a", "b"))
        .select(
            "order_id",
            text.iso_instant(F.col("m.download_date")).alias("download_date"),
            "m.files",
            "m.total_size",
            F.coalesce("b.package_name", "a.package_name", F.lit("")).alias("package_name"),
        )
    )


def read_landed_metadata(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(orders, files) written by ``operators.publish.write_order_metadata``."""
    orders = spark.read.schema("order_id string, download_date timestamp, file_count bigint, total_size bigint").json(
        f"{folder}/orders"
    )
    rows = spark.read.schema(
        "order_id string, title string, href string, displaySize string, length bigint, updated timestamp"
    ).json(f"{folder}/files")
    return orders, rows
