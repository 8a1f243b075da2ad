"""ZIP archives and the GeoPackages in them.

Archives are opened by the tasks, never by the driver: one task lists an archive
from its central directory, one takes a member through the task's own scratch space
and gives its layers and features as rows. Those are written as Parquet to the shared
store, on whatever file system that is, and every later step reads them there, so a
layer of any size is read by many tasks.
"""

from __future__ import annotations

import hashlib
import os
import sqlite3
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import geometry as G
from ..functions import text
from ..session import spread

CHUNK = 8 << 20
ROWS_PER_BATCH = 10_000


def _open(path: str):
    """Seekable binary file of a path on any file system Arrow knows."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    names = schema.fieldNames()
    return pd.DataFrame([[row.get(name) for name in names] for row in rows], columns=names, dtype=object)


# --- listing -----------------------------------------------------------------------


def zip_members(files: DataFrame) -> DataFrame:
    """One row per archive member of the ``.zip`` files of a delivery scan.

    Folders are left out. A file that is no archive, or one cut short, gives one
    row with an error and no member. Other failures of a read are not swallowed:
    the task fails and Spark runs it again.
    """

    def list_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for archive in batch.itertuples(index=False):
                try:
                    with _open(archive.path) as raw, zipfile.ZipFile(raw) as opened:
                        members = [i for i in opened.infolist() if not i.is_dir()]
                except zipfile.BadZipFile as error:
                    broken = {"order_id": archive.order_id, "path": archive.path, "zip_name": archive.file_name}
                    rows.append({**broken, "error": f"cannot read: {error}"})
                    continue
                rows += [
                    {
                        "order_id": archive.order_id,
                        "path": archive.path,
                        "zip_name": archive.file_name,
                        "entry": position,
                        "inner_path": member.filename,
                        "extension": PurePosixPath(member.filename).suffix.lower(),
                        "size": member.file_size,
                        "crc": member.CRC,
                    }
                    for position, member in enumerate(members)
                ]
                if len(rows) >= ROWS_PER_BATCH:
                    yield _frame(rows, schemas.MEMBER)
                    rows = []
            yield _frame(rows, schemas.MEMBER)

    archives = files.filter(F.lower("file_name").endswith(".zip")).select("order_id", "path", "file_name")
    return spread(archives, "path").mapInPandas(list_archives, schemas.MEMBER)


def file_hashes(files: DataFrame) -> DataFrame:
    """The files of a delivery scan with ``source_hash``, the SHA-256 of their bytes.

    A file is read in pieces of ``CHUNK`` bytes by one task, from any file system Arrow knows, so its size has no bound
    (a column of contents ends at 2 GB).
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with _open(path) as source:
                    while chunk := source.read(CHUNK):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "source_hash"])

    shape = T.StructType([*files.schema.fields, T.StructField("source_hash", T.StringType())])
    return spread(files, "path").mapInArrow(hashed, shape)


# --- unpacking ---------------------------------------------------------------------


def unpack(members: DataFrame, folder: str) -> DataFrame:
    """Layers and features of the GeoPackage members, written below ``folder`` and read from there.

    Rows of the schema ``EXTRACTED``: one of kind ``layer`` per layer, one of kind ``feature`` per feature
    with its values under their storage classes. Unpacking, hashing and reading a member is one task, which leaves
    nothing behind but its Parquet files; a task that is lost or run twice does no harm. A member that cannot
    be read gives a row with an error; other failures of a read let the task fail and run again.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member in batch.to_pylist():
                base = {k: member[k] for k in ("order_id", "zip_name", "inner_path")}
                with tempfile.TemporaryDirectory() as scratch:
                    path = os.path.join(scratch, "member.gpkg")
                    try:
                        base["source_hash"] = _copy_member(member["path"], member["inner_path"], path)
                        yield from _contents(path, base)
                    except MEMBER_ERRORS as error:
                        yield pa.RecordBatch.from_pylist([{**base, "kind": "layer", "error": _told(error)}], schema=_STORED)

    wanted = members.filter(F.col("extension") == ".gpkg").select("order_id", "zip_name", "path", "inner_path")
    found = spread(wanted, "path", "inner_path").mapInArrow(extract, schemas.EXTRACTED)
    found.write.partitionBy("kind", "order_id").parquet(folder)
    return members.sparkSession.read.schema(schemas.EXTRACTED).parquet(folder)


MEMBER_ERRORS = (zipfile.BadZipFile, zlib.error, EOFError, sqlite3.Error)  # of the member itself, not of a read


def _told(error: Exception) -> str:
    return f"cannot {'read' if isinstance(error, sqlite3.Error) else 'unpack'}: {error}"


def catalogue(members: DataFrame) -> DataFrame:
    """Catalogue of the feature layers in archive members, as :func:`source_layers` gives it, without unpacking features.

    A member is taken through its task's scratch space; only the layers' descriptions leave it. A member that cannot be
    read gives a row with an error. ``path`` is the archive, as the ``gpkg`` data source needs it.
    """
    shape = T.StructType([*schemas.CATALOGUE.fields, T.StructField("path", T.StringType())])
    arrow = to_arrow_schema(shape)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member in batch.to_pylist():
                base = dict(member)
                with tempfile.TemporaryDirectory() as scratch:
                    path = os.path.join(scratch, "member.gpkg")
                    try:
                        base["source_hash"] = _copy_member(member["path"], member["inner_path"], path)
                        with _opened(path) as db:
                            found = list(_layers(db, base))
                    except MEMBER_ERRORS as error:
                        found = [{**base, "error": _told(error)}]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    wanted = members.filter(F.col("extension") == ".gpkg").select("order_id", "zip_name", "path", "inner_path")
    return spread(wanted, "path", "inner_path").mapInArrow(described, shape)


def _copy_member(archive: str, inner: str, target: str) -> str:
    digest = hashlib.sha256()
    with _open(archive) as raw, zipfile.ZipFile(raw) as opened, opened.open(inner) as source, open(target, "wb") as out:
        while chunk := source.read(CHUNK):
            digest.update(chunk)
            out.write(chunk)
    return digest.hexdigest()


# --- GeoPackage layers -----------------------------------------------------------------


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_CLASSES = {int: "i", float: "d", str: "s", bytes: "b"}  # storage classes of SQLite values
_STORED = to_arrow_schema(schemas.EXTRACTED)


def _stored_values(rows: list[tuple], width: int) -> pa.ListArray:
    """The attribute values of features, each under its storage class, as one Arrow column."""
    flat = [v for row in rows for v in row[2 : 2 + width]]
    kind = _STORED.field("values").type.value_type
    fields = [pa.array([v if type(v) is of else None for v in flat], kind.field(name).type) for of, name in _CLASSES.items()]
    there = pa.array([v is None for v in flat], pa.bool_())
    values = pa.StructArray.from_arrays(fields, names=list(_CLASSES.values()), mask=there)
    return pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width) if width else [0] * (len(rows) + 1), pa.int32()), values)


def _feature_batch(rows: list[tuple], width: int, number: int, base: dict, layer: str) -> pa.RecordBatch:
    """Features (rowid, blob, values ...) as rows of the schema ``EXTRACTED``, column by column."""
    same = {**base, "kind": "feature", "layer_name": layer}
    made = {
        "row_no": pa.array(range(number + 1, number + 1 + len(rows)), pa.int64()),
        "source_row": pa.array([row[0] for row in rows], pa.int64()),
        "blob": pa.array([row[1] or None for row in rows], pa.binary()),
        "values": _stored_values(rows, width),
    }
    columns = [
        made[f.name] if f.name in made else pa.repeat(pa.scalar(same[f.name], f.type), len(rows)) if f.name in same else pa.nulls(len(rows), f.type)
        for f in _STORED
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_STORED)


@contextmanager
def _opened(path: str) -> Iterator[sqlite3.Connection]:
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
    try:
        yield db
    finally:
        db.close()


def _layers(db: sqlite3.Connection, base: dict) -> Iterator[dict]:
    """A catalogue row for each feature layer; no feature is read but for their count."""
    layers = db.execute(
        "SELECT c.table_name, g.column_name, g.geometry_type_name, g.srs_id, c.min_x, c.min_y, c.max_x, c.max_y"
        " FROM gpkg_contents c LEFT JOIN gpkg_geometry_columns g ON g.table_name = c.table_name"
        " WHERE c.data_type = 'features' ORDER BY c.table_name"
    ).fetchall()
    for name, geometry, kind, srid, *stored in layers:
        layer = {**base, "layer_name": name}
        if geometry is None:
            yield {**layer, "error": f"no geometry column in {name}"}
            continue
        columns = [
            {"name": c[1], "type": c[2]}
            for c in db.execute(f"PRAGMA table_info({_quoted(name)})")
            if c[1] != geometry and c[1].lower() != "fid"
        ]
        count = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
        bounds = dict(zip(("min_x", "min_y", "max_x", "max_y"), stored, strict=True))
        known = {"geometry_column": geometry, "geometry_type": kind, "srid": srid, "feature_count": count, "columns": columns}
        yield {**layer, **known, **bounds}


def _feature_query(layer: str, geometry: str, columns: list[dict], where: str = "") -> str:
    picked = ", ".join(_quoted(n) for n in [geometry, *(c["name"] for c in columns)])
    return f"SELECT rowid, {picked} FROM {_quoted(layer)} {where} ORDER BY rowid"


def _contents(path: str, base: dict) -> Iterator[pa.RecordBatch]:
    """A row for each feature layer, followed by the rows of its features in row-number order."""
    with _opened(path) as db:
        for layer in _layers(db, base):
            yield pa.RecordBatch.from_pylist([{**layer, "kind": "layer"}], schema=_STORED)
            if layer.get("error"):
                continue
            cursor, number = db.execute(_feature_query(layer["layer_name"], layer["geometry_column"], layer["columns"])), 0
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                yield _feature_batch(rows, len(layer["columns"]), number, base, layer["layer_name"])
                number += len(rows)


def source_layers(extracted: DataFrame) -> DataFrame:
    """Catalogue of the feature layers in unpacked GeoPackages; a bad file gives a row with an error."""
    return extracted.filter(F.col("kind") == "layer").select(*schemas.CATALOGUE.fieldNames())


# Columns that a read or published layer has besides its attributes.
STORAGE = frozenset(
    "order_id layer_name zip_name inner_path source_row fid geom geom_wkb srid cell"
    " xmin ymin xmax ymax _source_order _loaded_at _load _n _part _row _before".split()
)


def attribute_names(names: list[str]) -> list[str]:
    """Column names of source attributes: cleaned, free of storage columns and of one another.

    A cleaned name that is a storage column gets ``_attr`` after it; of equal names the
    second and later ones are numbered ``_2``, ``_3`` in source order.
    """
    out: list[str] = []
    for name in names:
        clean = text.clean_name(name)
        base = clean + "_attr" if clean in STORAGE else clean
        own, number = base, 1
        while own in out or own in STORAGE:
            number += 1
            own = f"{base}_{number}"
        out.append(own)
    return out


def layer_fields(columns: list) -> list[T.StructField]:
    """Spark fields of a source layer's attributes, under the names of :func:`attribute_names`."""
    names = attribute_names([c["name"] for c in columns])
    return [T.StructField(name, text.spark_type(c["type"])) for name, c in zip(names, columns, strict=True)]


def _typed(value: Column, kind: T.DataType) -> Column:
    """A stored value as the declared type of its column; one that does not fit is an error."""
    i, d, s, b = (value[c] for c in "idsb")
    if isinstance(kind, T.BinaryType):
        return F.coalesce(b, F.coalesce(s, i.cast("string"), d.cast("string")).cast("binary"))
    if isinstance(kind, T.StringType):
        return F.coalesce(s, i.cast("string"), d.cast("string"), b.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(i != 0, d != 0, s != "", F.length(b) > 0)
    if isinstance(kind, T.DecimalType):
        return F.coalesce(i.cast(kind), F.coalesce(s, d.cast("string")).cast(kind))
    return F.coalesce(i.cast(kind), d.cast(kind), s.cast(kind))


def read_layer(extracted: DataFrame, columns: list) -> DataFrame:
    """Features of unpacked layers that share one attribute list.

    Gives order_id, layer_name, zip_name, inner_path, source_row, ``fid`` (1, 2, ...
    in archive, member and row order), ``geom_wkb`` and the attributes, named by
    :func:`attribute_names`. The serial number is the number of a feature in its
    file and the counts of the files before, a row per file; no feature is shuffled for it.
    """
    file = ["order_id", "layer_name", "zip_name", "inner_path"]
    layer = Window.partitionBy("order_id", "layer_name").orderBy("zip_name", "inner_path")  # a row per file
    across = layer.rowsBetween(Window.unboundedPreceding, -1)
    files = extracted.filter((F.col("kind") == "layer") & F.col("error").isNull())
    starts = files.select(*file, F.coalesce(F.sum("feature_count").over(across), F.lit(0)).alias("file_start"))
    rows = extracted.filter(F.col("kind") == "feature").join(starts, file)
    values = [_typed(F.col("values")[k], f.dataType).alias(f.name) for k, f in enumerate(layer_fields(columns))]
    fid = (F.col("file_start") + F.col("row_no")).alias("fid")
    return rows.select(*file, "source_row", fid, G.strip_header(F.col("blob")).alias("geom_wkb"), *values)


def read_rows(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Part of a layer in source order (archive, member, row); either bound may be left out."""
    ordered = df.orderBy("zip_name", "inner_path", "source_row")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit) if limit is not None else ordered
