"""Data source ``gpkg``: one layer of the GeoPackages in delivery archives, read in ranges of rows.

    found = archives.catalogue(archives.zip_members(deliveries.scan_orders(spark, root)))
    found.write.parquet(folder)
    register(spark)
    roads = spark.read.format("gpkg").option("layer", "roads").load(folder)

The catalogue is made on the cluster and lies as Parquet; planning reads from it the rows of the layer, no archive. Each file
of the layer is read by as many tasks as it has ranges of ``rowsPerTask`` features; where that makes more than ``mostTasks``,
a task takes several ranges that follow one another. Filters on ``order_id``, ``zip_name`` and
``inner_path`` leave files out before a task is made, filters on ``source_row`` narrow what SQLite reads; Spark
asks a data source for that where ``spark.sql.python.filterPushdown.enabled`` is set, as ``register`` does.

A task takes the whole member through its scratch space, as an archive cannot be entered in the middle; large members gain by
ranges in what is parsed, not in what is unpacked.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from . import archives

ROWS_PER_TASK = 500_000
MOST_TASKS = 1000
FILE = ("order_id", "zip_name", "inner_path")


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("gpkg")`` known to the session."""
    spark.dataSource.register(GeoPackageLayer)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Rows(InputPartition):
    """Ranges of row positions of one layer: (file, first, last) each, in members of any number."""

    ranges: list[tuple[dict, int, int]]
    bounds: list[tuple[str, int]]


def _files(folder: str, layer: str) -> list[dict]:
    """The catalogue's rows of a layer, in the order of archive and member."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(folder)
    table = ds.dataset(where, filesystem=system, format="parquet").to_table(filter=(pc.field("layer_name") == layer) & pc.field("error").is_null())
    return sorted(table.to_pylist(), key=lambda row: tuple(row[c] or "" for c in FILE))


class GeoPackageLayer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def files(self) -> list[dict]:
        layer = self.options.get("layer")
        if not layer:
            raise ValueError("the option layer names the layer to read")
        found = _files(self.options["path"], layer)
        if not found:
            raise ValueError(f"no layer {layer} in the catalogue")
        shapes = {json.dumps([row["columns"], row["srid"]]) for row in found}
        if len(shapes) > 1:
            raise ValueError(f"the files of {layer} differ in columns or coordinate system")
        return found

    def schema(self) -> T.StructType:
        fixed = [T.StructField(c, T.StringType()) for c in FILE]
        fixed += [T.StructField("source_row", T.LongType()), T.StructField("srid", T.IntegerType()), T.StructField("geom_wkb", T.BinaryType())]
        return T.StructType([*fixed, *archives.layer_fields(self.files()[0]["columns"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GeoPackageReader(self.files(), schema, int(self.options.get("rowspertask", ROWS_PER_TASK)), int(self.options.get("mosttasks", MOST_TASKS)))


class GeoPackageReader(DataSourceReader):
    def __init__(self, files: list[dict], schema: T.StructType, rows_per_task: int, most_tasks: int):
        self.files, self.shape, self.rows_per_task, self.most_tasks = files, schema, rows_per_task, most_tasks
        self.bounds: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for one in filters:
            name = one.attribute[0] if isinstance(one, (EqualTo, In, *signs)) and len(one.attribute) == 1 else None
            if name in FILE and isinstance(one, (EqualTo, In)):
                wanted = set(one.value) if isinstance(one, In) else {one.value}
                self.files = [f for f in self.files if f[name] in wanted]
            elif name == "source_row" and type(one) in signs:
                self.bounds.append((signs[type(one)], one.value))
            else:
                yield one  # Spark's to apply

    def partitions(self) -> list[InputPartition]:
        step = self.rows_per_task
        ranges = [(f, first, min(first + step, f["feature_count"])) for f in self.files for first in range(0, f["feature_count"], step)]
        each = math.ceil(len(ranges) / self.most_tasks)
        return [Rows(ranges[k : k + each], self.bounds) for k in range(0, len(ranges), each or 1)]

    def __getstate__(self) -> dict:
        """What every task gets: its files are in its partition, so the list of all of them stays with the planner."""
        return {**self.__dict__, "files": []}

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        joined: list[tuple[dict, int, int]] = []
        for file, first, last in partition.ranges:
            if joined and joined[-1][0] == file and joined[-1][2] == first:
                joined[-1] = (file, joined[-1][1], last)
            else:
                joined.append((file, first, last))
        for file, first, last in joined:
            yield from self._range(file, first, last, partition.bounds)

    def _range(self, file: dict, first: int, last: int, bounds: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.shape)
        table = archives._quoted(file["layer_name"])
        # positions count all rows of the file, so that tasks share them out alike with and without bounds
        mine = f"rowid IN (SELECT rowid FROM {table} ORDER BY rowid LIMIT {last - first} OFFSET {first})"
        conditions = [f"rowid {sign} {int(value)}" for sign, value in bounds]
        if (first, last) != (0, file["feature_count"]):
            conditions.append(mine)
        where = "WHERE " + " AND ".join(conditions) if conditions else ""
        with tempfile.TemporaryDirectory() as scratch:
            path = os.path.join(scratch, "member.gpkg")
            archives._copy_member(file["path"], file["inner_path"], path)
            with archives._opened(path) as db:
                cursor = db.execute(archives._feature_query(file["layer_name"], file["geometry_column"], file["columns"], where))
                while rows := cursor.fetchmany(archives.ROWS_PER_BATCH):
                    yield self._batch(rows, file, shape)

    def _batch(self, rows: list[tuple], file: dict, shape: pa.Schema) -> pa.RecordBatch:
        fixed = [pa.repeat(pa.scalar(file[c], pa.string()), len(rows)) for c in FILE]
        fixed.append(pa.array([row[0] for row in rows], pa.int64()))
        fixed.append(pa.repeat(pa.scalar(file["srid"], pa.int32()), len(rows)))
        fixed.append(pa.array([G.without_header(row[1]) for row in rows], pa.binary()))
        names = shape.names[len(fixed) :]
        return pa.RecordBatch.from_arrays([*fixed, *(_column([row[2 + k] for row in rows], shape.field(n).type) for k, n in enumerate(names))], schema=shape)


def _spelled(value: float) -> str:
    """A number as Spark casts it to text."""
    if not math.isfinite(value) or value == 0 or 1e-3 <= abs(value) < 1e7:
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value) or ("NaN" if value != value else repr(value))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    rest = "".join(map(str, digits[1:])) or "0"
    return f"{'-' if sign else ''}{digits[0]}.{rest}E{len(digits) + exponent - 1}"


def _text(value) -> str | None:
    if isinstance(value, bytes):
        return value.decode()
    return _spelled(value) if isinstance(value, float) else value if value is None else str(value)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Stored values as the declared type of their column, by the rules of ``archives.read_layer``; a misfit is an error."""
    if pa.types.is_binary(kind):
        return pa.array([v if v is None or isinstance(v, bytes) else _text(v).encode() for v in values], kind)
    if pa.types.is_string(kind):
        return pa.array([_text(v) for v in values], kind)
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    if pa.types.is_decimal(kind):
        step = Decimal(1).scaleb(-kind.scale)
        wide = Context(prec=60, rounding=ROUND_HALF_UP)
        return pa.array([None if v is None else Decimal(_text(v)).quantize(step, context=wide) for v in values], kind)
    number = int if pa.types.is_integer(kind) else float
    return pa.array([None if v is None else number(v) for v in values], kind)
