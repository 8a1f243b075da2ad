"""Delivery folders written from the derived views, for the source and sink queries.

The folders are made by Spark tasks in the session's shared folder, on any file system that Arrow can write to.
Every file takes a bounded slice of its order, so no order is written by one task; a task that is run
again writes the same file again.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import shared_dir, spread
from . import views

ROWS_PER_ARCHIVE = 20_000
ROWS_PER_FILE = 10_000
ORDERS_LISTED = 200
ORDERS = 4


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def _part(spark: SparkSession, sf_dir: str, table: str, key: str):
    """A number that deals the rows of a table into files of about ``ROWS_PER_FILE`` rows, whatever the scale."""
    rows = views.table(spark, sf_dir, table).count()
    return F.pmod(F.xxhash64(key, "length"), F.lit(max(1, rows // (ROWS_PER_FILE * ORDERS_LISTED))))


def put(path: str, content: bytes | str) -> None:
    """Write a file, bytes or the copy of a local file, and the folders above it."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(where), recursive=True)
    with system.open_output_stream(where) as out:
        if isinstance(content, bytes):
            out.write(content)
        else:
            with open(content, "rb") as source:
                shutil.copyfileobj(source, out, 8 << 20)


def put_archive(path: str, layer: str, rows: list[tuple], columns: list[tuple[str, str]], member: str, extra: dict[str, str] | None = None) -> None:
    """A ZIP file with one GeoPackage of points in it, made in the task's own scratch space."""
    with tempfile.TemporaryDirectory() as scratch:
        gpkg, packed = os.path.join(scratch, "part.gpkg"), os.path.join(scratch, "part.zip")
        write_gpkg(gpkg, layer, rows, columns, "POINT", (None, None, None, None))
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            out.write(gpkg, member)
            for name, text in (extra or {}).items():
                out.writestr(name, text)
        put(path, packed)


def write_gpkg(path: str, layer: str, rows: list[tuple], columns: list[tuple[str, str]], kind: str, extent) -> None:
    """A GeoPackage with one layer; ``rows`` hold fid, geometry blob and the attributes."""
    with sqlite3.connect(path) as db:
        # a scratch file: its task makes it again if it is lost, so no journal and no wait for the disk
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(
            "CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE)"
        )
        db.execute(
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER)"
        )
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?, ?, ?)", (layer, *extent))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 3006)", (layer, kind))
        spelled = ", ".join(f'"{name}" {sql_type}' for name, sql_type in columns)
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {spelled})')
        marks = ", ".join("?" * (2 + len(columns)))
        db.executemany(f'INSERT INTO "{layer}" VALUES ({marks})', rows)
    db.close()


def land_archives(spark: SparkSession, sf_dir: str, rows_per_archive: int = ROWS_PER_ARCHIVE) -> str:
    """``o0`` to ``o3``, each with archives of its customers' points as ``points_oN_sverige.gpkg``."""
    root = new_folder(spark, "deliveries")
    put_orders(views.point_layer(spark, sf_dir), root, rows_per_archive)
    return root


def put_orders(points: DataFrame, root: str, rows_per_archive: int = ROWS_PER_ARCHIVE) -> None:
    """The archives of the points' orders below a root; what was delivered there under the same names is replaced."""
    header = F.expr("concat(unhex('4750'), unhex('00'), unhex('01'), unhex('BE0B0000'))")
    rows = points.select(
        F.concat(F.lit("o"), F.col("fid") % ORDERS).alias("order_id"),
        F.floor(F.col("fid") / rows_per_archive).cast("bigint").alias("archive"),
        "fid",
        F.concat(header, G.write_wkb("geom")).alias("blob"),
        "c_name",
        "c_acctbal",
        "c_mktsegment",
    )

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        order, archive = pdf["order_id"].iloc[0], int(pdf["archive"].iloc[0])
        data = [
            (int(r.fid), bytes(r.blob), r.c_name, float(r.c_acctbal), r.c_mktsegment)
            for r in pdf.sort_values("fid").itertuples(index=False)
        ]
        columns = [("c_name", "TEXT"), ("c_acctbal", "REAL"), ("C-MktSegment", "TEXT(10)")]
        path = f"{root}/{order}/points_{archive}.zip"
        put_archive(path, f"points_{order}", data, columns, f"data/points_{order}_sverige.gpkg", {"readme.txt": "points"})
        return pd.DataFrame({"done": [1]})

    spread(rows, "order_id", "archive").groupBy("order_id", "archive").applyInPandas(write, "done int").count()


def land_odd_names(spark: SparkSession, sf_dir: str) -> str:
    """Points whose attributes are named like storage columns, or alike once cleaned; an archive per order and 5,000 customers."""
    root = new_folder(spark, "odd-names")
    header = F.expr("concat(unhex('4750'), unhex('00'), unhex('01'), unhex('BE0B0000'))")
    rows = views.point_layer(spark, sf_dir).select(
        F.concat(F.lit("o"), F.col("fid") % ORDERS).alias("order"),
        F.floor(F.col("fid") / 5000).cast("bigint").alias("archive"),
        "fid",
        "xmin",
        F.concat(header, G.write_wkb("geom")).alias("blob"),
        "c_name",
        "c_mktsegment",
    )
    columns = [("srid", "INTEGER"), ("Cell", "INTEGER"), ("xmin", "REAL"), ("order_id", "TEXT"), ("a b", "TEXT"), ("A-B", "TEXT")]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        order, archive = pdf["order"].iloc[0], int(pdf["archive"].iloc[0])
        data = [
            (int(r.fid), bytes(r.blob), int(r.fid) * 7, int(r.fid), -float(r.xmin), r.c_name, r.c_name, r.c_mktsegment)
            for r in pdf.sort_values("fid").itertuples(index=False)
        ]
        put_archive(f"{root}/{order}/odd_{archive}.zip", "odd", data, columns, "odd.gpkg")
        return pd.DataFrame({"done": [1]})

    spread(rows, "order", "archive").groupBy("order", "archive").applyInPandas(write, "done int").count()
    return root


def land_names(spark: SparkSession, sf_dir: str) -> str:
    """A file per order and 10,000 customer numbers with the customers' names, a line each."""
    root = new_folder(spark, "names")
    part = F.floor(F.col("fid") / 10_000).cast("long").alias("part")
    per_file = views.point_layer(spark, sf_dir).groupBy(F.concat(F.lit("o"), F.col("fid") % ORDERS).alias("order_id"), part)
    names = per_file.agg(F.array_sort(F.collect_list(F.struct("fid", "c_name"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["c_name"]), "\n")
    file_name = F.concat(F.lit("names_"), "part", F.lit(".txt")).alias("file_name")
    land_documents(names.select("order_id", "part", file_name, text.alias("item")), root, "", "")
    return root


def land_documents(items: DataFrame, root: str, prefix: str, suffix: str) -> None:
    """One JSON document per (order_id, part, file_name) from its ``item`` texts."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        content = prefix + ",".join(pdf["item"]) + suffix
        put(f"{root}/{first['order_id']}/{first['part']}/{first['file_name']}", content.encode())
        return pd.DataFrame({"done": [1]})

    items.groupBy("order_id", "part", "file_name").applyInPandas(write, "done int").count()


def land_statistics(spark: SparkSession, sf_dir: str) -> str:
    root = new_folder(spark, "statistics")
    number = F.expr("cast(substring(filename, 2, length(filename) - 6) AS bigint)")
    stats = F.transform(
        "statistics", lambda s: F.struct(s["table"].alias("tabellnamn"), s["objects"].alias("antalObjekt"))
    )
    feature = F.struct(
        F.struct(F.col("filename").alias("filnamn"), stats.alias("statistik")).alias("properties"),
        F.struct(
            F.lit("Polygon").alias("type"),
            F.array(F.array(F.array(number * 1.0, number * 2.0))).alias("coordinates"),
        ).alias("geometry"),
    )
    items = views.statistics(spark, sf_dir, every=True).select(
        "order_id", F.floor(number / 10_000).alias("part"), F.lit("uttag.json").alias("file_name"), F.to_json(feature).alias("item")
    )
    land_documents(items, root, '{"type":"FeatureCollection","produkttyp":"Topografi 10","features":[', "]}")
    return root


def land_tile_index(spark: SparkSession, sf_dir: str) -> str:
    root = new_folder(spark, "tile-index")
    item = F.to_json(F.struct("title", F.concat(F.lit("https://tiles/"), "title").alias("href"), F.col("size").alias("length")))
    items = views.tiles(spark, sf_dir).select(
        "order_id", F.floor(F.col("k") / 100_000).alias("part"), F.col("index_name").alias("file_name"), item.alias("item")
    )
    land_documents(items, root, " [", "]")
    return root


def land_listing(spark: SparkSession, sf_dir: str) -> str:
    root = new_folder(spark, "listing")
    entry = F.struct(
        "title",
        F.concat(F.lit("https://files/"), "title").alias("href"),
        F.when(F.col("length") % 2 == 0, F.col("length")).alias("length"),
        F.when(F.col("length") % 2 == 1, F.col("length")).alias("size"),
        F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"),
    )
    items = views.listing(spark, sf_dir).select(
        "order_id", _part(spark, sf_dir, "lineitem", "title").alias("part"), F.lit("listing.json").alias("file_name"), F.to_json(entry).alias("item")
    )
    land_documents(items, root, "[", "]")
    return root


def land_metadata(spark: SparkSession, sf_dir: str) -> str:
    """``order_metadata.json`` for even orders, ``metadata.json`` for those divisible by three."""
    root = new_folder(spark, "metadata")
    number = F.expr("cast(substring(order_id, 2) AS int)")

    def document(files_of: str):
        return F.to_json(
            F.struct(
                "order_id",
                F.date_format("download_date", "yyyy-MM-dd'T'HH:mm:ss").alias("download_date"),
                F.when(F.lit(files_of) == "metadata.json", number * 100).alias("total_size"),
                F.when(F.lit(files_of) == "metadata.json", F.concat(F.lit("package "), "order_id")).alias("package_name"),
            )
        )

    folders = views.folders(spark, sf_dir, every=True)
    for name, rule in (("order_metadata.json", number % 2 == 0), ("metadata.json", number % 3 == 0)):
        items = folders.filter(rule).select(
            "order_id", F.lit(0).alias("part"), F.lit(name).alias("file_name"), document(name).alias("item")
        )
        land_documents(items, root, "", "")
    return root
