"""Publishing: layers as Parquet tables, the ledger, incremental runs, cleanup."""

from __future__ import annotations

import threading
import time
import uuid
import warnings
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, crs, text
from ..functions import geometry as G
from ..session import cut_lineage, shared_dir
from ..sources import archives, deliveries, files
from . import deliveries as delivery_ops
from . import ledger as ledger_ops
from . import layers
from .entrylog import EntryLog
from .versioned import KEPT_SECONDS, VersionedTable

REPORT_SCHEMA = (
    "order_id string, table_name string, layer_name string, feature_count bigint,"
    " duration_seconds double, status string, error string"
)
SEEN_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("order_id", "fingerprint", "layer_name", "source_hash")]
)
LABEL_SCHEMA = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("package_name", T.StringType())])

MODES = ("replace", "append", "fail")


# --- row numbers ---------------------------------------------------------------------


def assign_fids(df: DataFrame, order_by: Iterable[str]) -> DataFrame:
    """Serial ``fid`` from 1 in the order of the given columns.

    The rows are range-partitioned by the order and numbered within their
    partition; a count per partition gives each its offset. Nothing passes
    through one task. The numbering is checkpointed first, since a range
    partitioning that is computed twice may cut elsewhere. ``order_by`` should
    be unique, which also lets equal leading values be split.
    """
    keys = list(order_by)
    numbered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    numbered = cut_lineage(numbered)
    offsets, before = [], 0
    for row in numbered.groupBy("_part").count().orderBy("_part").collect():  # one row per partition
        offsets.append((row["_part"], before))
        before += row["count"]
    parts = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return (
        numbered.join(F.broadcast(parts), "_part")
        .withColumn("fid", F.col("_before") + F.col("_row") + 1)
        .drop("_part", "_row", "_before")
    )


# --- one layer -------------------------------------------------------------------------


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """The database of the published layers, made once."""
    where = location or f"{shared_dir(spark)}/{database}.db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{where}'")


def ledger_table(spark: SparkSession, location: str) -> EntryLog:
    return EntryLog(spark, f"{location}/_metadata", ledger_ops.LEDGER_SCHEMA, ledger_ops.KEY)


def prepared(df: DataFrame, source_srid: int, target_srid: int) -> DataFrame:
    """Geometry in the target system and its envelope.

    The binary form is decoded once here; queries read the nested column.
    """
    if "geom" not in df.columns:
        df = df.withColumn("geom", G.parse_wkb("geom_wkb"))
    if source_srid != target_srid or "geom_wkb" not in df.columns:
        df = df.withColumn("geom", crs.transform_geometry("geom", source_srid, target_srid))
        df = df.withColumn("geom_wkb", G.write_wkb("geom"))
    return layers.with_envelope(df).withColumn("srid", F.lit(target_srid))


def load_key(order_id: str | None, layer_name: str | None) -> str:
    """What a load replaces when it comes again: the rows of its order and layer; a load without an order is new each time."""
    if order_id is None:
        return f"load {uuid.uuid4().hex}"
    return f"order {order_id}" if layer_name is None else f"order {order_id} layer {layer_name}"


def publish_layer(
    df: DataFrame,
    name: str,
    database: str,
    source_srid: int,
    order_by: Iterable[str] | None = None,
    target_srid: int = crs.WGS84,
    if_exists: str = "replace",
    order_id: str | None = None,
    layer_name: str | None = None,
) -> DataFrame:
    """Write a layer and return the one-row count, extent and bbox text of what was loaded.

    The rows bring their serial ``fid`` or get one in the order of ``order_by``. A table consists of loads, one
    partition each with a folder of its own. An append sets the load of its order and layer, so an order that
    comes again replaces its own rows and no others; its fids count on from the last that was given. A replacement
    leaves this load alone. Folders are written whole before the catalogue points at them, and a table that has
    to be made anew is made under another name first, so a job that is lost leaves the table as it was and can be
    run again. Folders out of use go an hour later.

    The rows are decoded and projected once, into a staged copy that gives the statistics; from that they are laid out
    by ``cell``, so that the row groups of the files cover small areas and a box filter skips most of them.
    """
    if if_exists not in MODES:
        raise ValueError(f"if_exists is one of {', '.join(MODES)}")
    spark = df.sparkSession
    _finish_swap(spark, database, name)
    table = f"`{database}`.`{name}`"
    known = spark.catalog.tableExists(f"{database}.{name}")
    if known and if_exists == "fail":
        raise ValueError(f"table {name} already exists")
    if order_by is not None:
        df = assign_fids(df, order_by)
    home = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{name}"
    staged_at = f"{home}/staged-{uuid.uuid4().hex}"
    rows = prepared(df, source_srid, target_srid).withColumns(
        {"_source_order": F.lit(order_id).cast("string"), "_loaded_at": F.current_timestamp()}
    )
    rows.write.parquet(staged_at)
    staged = cells.with_feature_cell(spark.read.parquet(staged_at), target_srid)
    staged = staged.select(*[layers.cell_column(F.col(c), target_srid) if c == "cell" else f"`{c}`" for c in _column_order(staged.schema)])
    found = _statistics(staged)
    load, folder = load_key(order_id, layer_name), f"{home}/load-{uuid.uuid4().hex}"
    if known and if_exists == "append":
        last = _last_fid(spark, table, name, target_srid)
        wanted = [f for f in spark.table(table).schema.fields if f.name != "_load"]
        typed = [staged[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in wanted]
        _set_facts(spark, table, {layers.FACT_LAST: last + found.last_fid, layers.FACT_UNSURE: "true"})
        _write_laid_out(staged.select(*typed).withColumn("fid", F.col("fid") + last), found.count, folder)
        replaced = _add_load(spark, table, load, folder, found, last, target_srid)
    else:
        _write_laid_out(staged, found.count, folder)
        facts = _facts(found.count, found.kinds, target_srid, found.last_fid)
        _swap_in(spark, database, name, spark.read.parquet(folder).schema, load, folder, facts, known)
        replaced = known
    files.delete_tree(spark, staged_at)
    if replaced:
        _forget_folders(spark, table, home)
    shown = spark.createDataFrame([(found.count, *found.box)], "feature_count bigint, minx double, miny double, maxx double, maxy double")
    return shown.withColumn("bbox", layers.box_text())


def _column_order(schema: T.StructType) -> list[str]:
    """fid, attributes, storage and bookkeeping columns; nested ones last of all.

    The reader that answers from footers takes a column's place among the fields for its place in the file, which
    holds as far as no nested column stands before it.
    """
    shape = ["geom_wkb", "srid", *layers.ENVELOPE, "cell", *layers.BOOKKEEPING, "geom"]
    names = ["fid", *[f.name for f in schema.fields if f.name not in ("fid", *shape)], *shape]
    nested = {f.name for f in schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return [n for n in names if n not in nested] + [n for n in names if n in nested]


def _last_fid(spark: SparkSession, table: str, name: str, srid: int) -> int:
    """The last fid that a table gave, if it is in this system."""
    facts = _certain_facts(spark, table)
    if facts.get(layers.FACT_SRID, str(srid)) != str(srid):
        raise ValueError(f"table {name} is in system {facts[layers.FACT_SRID]}, not {srid}")
    return int(facts[layers.FACT_LAST])


def _add_load(spark: SparkSession, table: str, load: str, folder: str, found: Statistics, last: int, srid: int) -> bool:
    """Point a load of a table at its folder and tell the table's facts; its fids begin after ``last``.

    Says whether the load had a folder before.
    """
    facts = layers.table_facts(spark, table)
    there = not spark.sql(f"SHOW PARTITIONS {table} PARTITION (_load = {_quoted(load)})").isEmpty()
    old = _statistics(spark.table(table).filter(F.col("_load") == load)) if there else Statistics(0, {}, 0, (None,) * 4)
    counted = layers.kind_counts(facts)
    kinds = {k: counted.get(k, 0) - old.kinds.get(k, 0) + found.kinds.get(k, 0) for k in {*counted, *found.kinds}}
    given = max(int(facts[layers.FACT_LAST]), last + found.last_fid)
    _set_facts(spark, table, {layers.FACT_LAST: given, layers.FACT_UNSURE: "true"})
    _point_at(spark, table, load, folder, there)
    _set_facts(spark, table, _facts(int(facts[layers.FACT_COUNT]) - old.count + found.count, kinds, srid, given))
    return there


# Rows from which a layer is cut into files by range; below it is one file.
ROWS_PER_FILE = 250_000


@dataclass(frozen=True)
class Statistics:
    count: int
    kinds: dict[str, int]
    last_fid: int
    box: tuple[float | None, ...]


def _statistics(rows: DataFrame) -> Statistics:
    """Count, features of each geometry type, last fid and extent of a layer's rows."""
    return _statistics_by(rows.withColumn("_n", F.lit(0)), "_n").get(0, Statistics(0, {}, 0, (None,) * 4))


def _statistics_by(rows: DataFrame, key: str) -> dict[object, Statistics]:
    """The same for each value of a column that tells a bounded number of loads apart."""
    kind = F.col("geom")["type"].alias("kind")
    found = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.max("fid").alias("last"), *layers.extent_aggregates())
    ends = [(min, "minx"), (min, "miny"), (max, "maxx"), (max, "maxy")]
    per: dict[object, list] = {}
    for row in found.collect():  # a row per load and type
        per.setdefault(row[key], []).append(row)
    out = {}
    for load, own in per.items():
        box = tuple(pick((r[c] for r in own if r[c] is not None), default=None) for pick, c in ends)
        kinds = {r["kind"]: r["n"] for r in own if r["kind"] is not None}
        out[load] = Statistics(sum(r["n"] for r in own), kinds, max(r["last"] for r in own), box)
    return out


def _write_laid_out(rows: DataFrame, count: int, folder: str) -> None:
    """The rows sorted by cell, in files that each hold a range of cells."""
    parts = -(-max(count, 1) // ROWS_PER_FILE)
    dealt = rows.repartitionByRange(parts, "cell", "fid") if parts > 1 else rows.coalesce(1)
    dealt.sortWithinPartitions("cell", "fid").write.parquet(folder)


def _facts(count: int, kinds: dict[str, int], srid: int, last_fid: int) -> dict[str, object]:
    told = ",".join(f"{k}:{n}" for k, n in sorted(kinds.items()) if n)
    return {layers.FACT_COUNT: count, layers.FACT_KINDS: told, layers.FACT_SRID: srid, layers.FACT_LAST: last_fid, layers.FACT_UNSURE: "false"}


def _set_facts(spark: SparkSession, table: str, facts: dict[str, object]) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f"'{k}' = '{v}'" for k, v in facts.items())})")


def _certain_facts(spark: SparkSession, table: str) -> dict[str, str]:
    """The facts of a table, read from its rows where an earlier run was lost between a load and its facts."""
    facts = layers.table_facts(spark, table)
    if facts.get(layers.FACT_UNSURE) == "false":
        return facts
    found = _statistics(spark.table(table))
    last = max(found.last_fid, int(facts.get(layers.FACT_LAST, 0)))
    sure = _facts(found.count, found.kinds, int(facts[layers.FACT_SRID]), last)
    _set_facts(spark, table, sure)
    return {k: str(v) for k, v in sure.items()}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _comment(field: T.StructField) -> str:
    told = field.metadata.get("comment")
    return f" COMMENT {_quoted(told)}" if told else ""


def _point_at(spark: SparkSession, table: str, load: str, folder: str, there: bool) -> None:
    """Let a load of a table be the rows of a folder: one change of the catalogue."""
    part = f"PARTITION (_load = {_quoted(load)})"
    spark.sql(f"ALTER TABLE {table} {part} SET LOCATION {_quoted(folder)}" if there else f"ALTER TABLE {table} ADD {part} LOCATION {_quoted(folder)}")
    spark.catalog.refreshTable(table)


def _swap_in(spark: SparkSession, database: str, name: str, schema: T.StructType, load: str, folder: str, facts: dict[str, object], known: bool) -> None:
    """Make the table this one load: a new table under another name, which then takes the name."""
    new = f"_new_{name}"
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{new}`")
    # The table's own folder stays empty, each load has its own.
    root = f"{folder.rsplit('/', 1)[0]}/table-{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{_comment(f)}" for f in schema.fields)
    told = ", ".join(f"'{k}' = '{v}'" for k, v in facts.items())
    spark.sql(
        f"CREATE TABLE `{database}`.`{new}` ({columns}, _load STRING) USING parquet PARTITIONED BY (_load)"
        f" LOCATION {_quoted(root)} TBLPROPERTIES ({told})"
    )
    spark.sql(f"ALTER TABLE `{database}`.`{new}` ADD PARTITION (_load = {_quoted(load)}) LOCATION {_quoted(folder)}")
    if known:
        spark.sql(f"ALTER TABLE `{database}`.`{name}` RENAME TO `{database}`.`_old_{name}`")
    _finish_swap(spark, database, name)


def _finish_swap(spark: SparkSession, database: str, name: str) -> None:
    """Let a table that waits under its other name take its place; does what a lost run has left to do."""
    there = {k: spark.catalog.tableExists(f"{database}.{k}{name}") for k in ("", "_new_", "_old_")}
    if not there[""] and (there["_new_"] or there["_old_"]):
        waiting = "_new_" if there["_new_"] else "_old_"
        spark.sql(f"ALTER TABLE `{database}`.`{waiting}{name}` RENAME TO `{database}`.`{name}`")
        there[waiting] = False
        spark.catalog.refreshTable(f"`{database}`.`{name}`")
    if there["_old_"]:
        spark.sql(f"DROP TABLE `{database}`.`_old_{name}`")


def _forget_folders(spark: SparkSession, table: str, home: str) -> None:
    """Mark the folders that no load uses any more; delete those that were marked, and staged ones, an hour ago.

    The loads of the table are its partitions; their folders come from the catalogue, a name per load.
    """
    there = files.children(spark, home)
    idle = [n for n in there if n.startswith(("load-", "table-", "staged-"))]
    if len(idle) < 3:  # one load and the table's own folder
        return
    state = spark._jsparkSession.sessionState()
    own = state.catalog().getTableMetadata(state.sqlParser().parseTableIdentifier(table)).location().toString()
    used = {files.name_of(folder) for folder in [own, *layers.load_folders(spark, table)]}
    for n in idle:
        mark = f"{home}/.idle-{n}"
        if n in used:
            continue
        if f".idle-{n}" not in there and not n.startswith("staged-"):
            files.touch(spark, mark)
        elif files.age_of(spark, mark if f".idle-{n}" in there else f"{home}/{n}") > KEPT_SECONDS:
            files.delete_tree(spark, f"{home}/{n}")
            files.delete_tree(spark, mark)


def drop_load(spark: SparkSession, database: str, name: str, load: str) -> None:
    """Take one load out of a table."""
    table = f"`{database}`.`{name}`"
    facts = _certain_facts(spark, table)
    old = _statistics(spark.table(table).filter(F.col("_load") == load))
    _set_facts(spark, table, {layers.FACT_UNSURE: "true"})
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (_load = {_quoted(load)})")
    spark.catalog.refreshTable(table)
    kinds = {k: n - old.kinds.get(k, 0) for k, n in layers.kind_counts(facts).items()}
    _set_facts(spark, table, _facts(int(facts[layers.FACT_COUNT]) - old.count, kinds, int(facts[layers.FACT_SRID]), int(facts[layers.FACT_LAST])))


# --- many layers of one shape ----------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """Where the rows of an order's layer go."""

    order_id: str
    layer_name: str
    table: str

    @property
    def load(self) -> str:
        return load_key(self.order_id, self.layer_name)


def publish_together(
    features: DataFrame, targets: list[Target], database: str, source_srid: int, target_srid: int = crs.WGS84, if_exists: str = "replace"
) -> list[Statistics | Exception]:
    """Write the layers of many orders, alike in columns and system, in one go: as many jobs as for a single layer.

    ``features`` has the rows of all targets with ``order_id``, ``layer_name`` and a serial ``fid`` in each. Decoding,
    statistics and layout are one job each over all of them; each layer then gets its folder and its place in the
    catalogue as by :func:`publish_layer`. What comes back is for each target what was loaded, or why it was not. A target
    needs rows, and as many targets as there are must fit a driver's list.
    """
    spark = features.sparkSession
    base = spark.catalog.getDatabase(database).locationUri.rstrip("/")
    for name in files.children(spark, base):  # of runs that were lost
        if name.startswith("together-") and files.age_of(spark, f"{base}/{name}") > KEPT_SECONDS:
            files.delete_tree(spark, f"{base}/{name}")
    work = f"{base}/together-{uuid.uuid4().hex}"
    try:
        return _together(features, targets, database, source_srid, target_srid, if_exists, work)
    finally:
        files.delete_tree(spark, work)


def _together(
    features: DataFrame, targets: list[Target], database: str, source_srid: int, target_srid: int, if_exists: str, work: str
) -> list[Statistics | Exception]:
    spark = features.sparkSession
    last: list[int] = []
    given: dict[str, int] = {}
    for t in targets:
        _finish_swap(spark, database, t.table)
        known = spark.catalog.tableExists(f"{database}.{t.table}")
        if known and if_exists == "append" and t.table not in given:
            given[t.table] = _last_fid(spark, f"`{database}`.`{t.table}`", t.table, target_srid)
    numbers = spark.createDataFrame([(n, t.order_id, t.layer_name) for n, t in enumerate(targets)], "_n int, order_id string, layer_name string")
    mine = features.join(F.broadcast(numbers), ledger_ops.KEY)  # a row per target
    rows = prepared(mine, source_srid, target_srid).withColumnsRenamed({"order_id": "_source_order"}).drop("layer_name")
    rows.withColumn("_loaded_at", F.current_timestamp()).write.parquet(f"{work}/staged")
    staged = cells.with_feature_cell(spark.read.parquet(f"{work}/staged"), target_srid)
    names = [c for c in _column_order(staged.schema) if c != "_n"]
    staged = staged.select("_n", *[layers.cell_column(F.col(c), target_srid) if c == "cell" else f"`{c}`" for c in names])
    found = _statistics_by(staged, "_n")
    for n, t in enumerate(targets):  # loads of one table count on from one another
        last.append(given.get(t.table, 0))
        if if_exists == "append":
            given[t.table] = last[-1] + (found[n].last_fid if n in found else 0)
    offsets = spark.createDataFrame(list(enumerate(last)), "_n int, _before bigint")
    placed = staged.join(F.broadcast(offsets), "_n").withColumn("fid", F.col("fid") + F.col("_before")).drop("_before")
    parts = -(-sum(s.count for s in found.values()) // ROWS_PER_FILE)
    dealt = placed.repartitionByRange(parts, "_n", "cell", "fid") if parts > 1 else placed.coalesce(1)
    dealt.sortWithinPartitions("_n", "cell", "fid").write.partitionBy("_n").parquet(f"{work}/laid_out")
    schema = T.StructType([f for f in placed.schema.fields if f.name != "_n"])
    outcomes: list[Statistics | Exception] = []
    replaced = set()
    for n, t in enumerate(targets):
        try:
            if _place(spark, database, t, f"{work}/laid_out/_n={n}", schema, found[n], last[n], target_srid, if_exists):
                replaced.add(t.table)
            outcomes.append(found[n])
        except Exception as error:  # one layer does not stop the rest
            outcomes.append(error)
    base = spark.catalog.getDatabase(database).locationUri.rstrip("/")
    for table in sorted(replaced):
        _forget_folders(spark, f"`{database}`.`{table}`", f"{base}/{table}")
    return outcomes


def _place(
    spark: SparkSession, database: str, target: Target, written: str, schema: T.StructType, found: Statistics, last: int, srid: int, if_exists: str
) -> bool:
    """Give a written layer its folder below its table, and the table the folder; says whether one is out of use now."""
    table = f"`{database}`.`{target.table}`"
    known = spark.catalog.tableExists(f"{database}.{target.table}")
    if known and if_exists == "fail":
        raise ValueError(f"table {target.table} already exists")
    if known and if_exists == "append":
        there = T.StructType([f for f in spark.table(table).schema.fields if f.name != "_load"])
        if [(f.name, f.dataType) for f in there.fields] != [(f.name, f.dataType) for f in schema.fields]:
            raise ValueError(f"table {target.table} has other columns")
    home = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{target.table}"
    folder = f"{home}/load-{uuid.uuid4().hex}"
    files.move(spark, written, folder)
    if known and if_exists == "append":
        return _add_load(spark, table, target.load, folder, found, last, srid)
    _swap_in(spark, database, target.table, schema, target.load, folder, _facts(found.count, found.kinds, srid, last + found.last_fid), known)
    return known


# --- orders ------------------------------------------------------------------------------


@dataclass
class Publisher:
    """Publishes the vector layers of a delivery root into one database.

    ``location`` is the shared folder that holds the database, the ledger, the
    run reports and the unpacked archives; it defaults to the session's
    checkpoint folder.
    """

    spark: SparkSession
    root: str
    database: str = "geodata"
    target_srid: int = crs.WGS84
    location: str = field(default="")
    layers_at_once: int = 4
    layers_per_job: int = 500

    def __post_init__(self) -> None:
        self.location = (self.location or shared_dir(self.spark)).rstrip("/")
        create_database(self.spark, self.database, f"{self.location}/{self.database}.db")
        self.ledger = ledger_table(self.spark, f"{self.location}/{self.database}.meta")
        self.labels = EntryLog(self.spark, f"{self.location}/{self.database}.meta/labels", LABEL_SCHEMA, ["order_id"])
        self.seen = VersionedTable(self.spark, f"{self.location}/{self.database}.meta/seen", SEEN_SCHEMA)
        self._ledger_lock = threading.Lock()
        self.reports = f"{self.location}/{self.database}.meta/run_report"

    # -- what is there

    def orders(self) -> DataFrame:
        names = files.order_folders(self.spark, self.root)
        return self.spark.createDataFrame([(n,) for n in names], "order_id string")

    def members(self, order_ids: list[str] | None = None) -> DataFrame:
        return archives.zip_members(deliveries.scan_orders(self.spark, self.root, order_ids))

    def types(self, members: DataFrame, order_ids: list[str] | None = None) -> DataFrame:
        """Types of the orders; metadata and tile index are read for the named orders only."""
        hints = deliveries.read_hints(self.spark, self.root, order_ids)
        ranked = delivery_ops.dominant_type(members.filter(F.col("error").isNull()), hints)
        return delivery_ops.index_first(ranked, deliveries.read_tile_index(self.spark, self.root, order_ids))

    def extracted(self, members: DataFrame, types: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """Catalogue and contents of the publishable orders' members, unpacked to ``folder``.

        Broken files are rows with an error in the catalogue.
        """
        vector = delivery_ops.publishable(types).select("order_id")
        wanted = members.join(vector, "order_id", "left_semi")
        contents = archives.unpack(wanted.filter(F.col("error").isNull()), folder)
        found = archives.source_layers(contents)
        names = {f.name: F.col(f.name) if f.name in ("order_id", "zip_name", "error") else F.lit(None).cast(f.dataType) for f in found.schema.fields}
        # an archive that cannot be read may hold a layer of any order, whatever type the rest gives it
        broken = members.filter(F.col("error").isNotNull()).select(*[c.alias(n) for n, c in names.items()])
        return cut_lineage(found.unionByName(broken)), contents

    @staticmethod
    def fingerprints(members: DataFrame) -> DataFrame:
        """order_id and a fingerprint of its vector members: names, sizes and checksums from the archives' directories."""
        vector = members.filter((F.col("extension") == ".gpkg") & F.col("error").isNull())
        one = F.xxhash64("zip_name", "inner_path", "size", "crc")
        two = F.xxhash64(F.lit("b"), "crc", "size", "inner_path", "zip_name")
        total = [F.sum(h.cast("decimal(20,0)")) for h in (one, two)]
        return vector.groupBy("order_id").agg(F.concat_ws("-", F.count(F.lit(1)), *total).alias("fingerprint"))

    def unchanged(self, members: DataFrame) -> DataFrame:
        """What earlier runs saw of the orders that are as they were then, every layer of them in the ledger.

        Rows are those of ``seen``. Nothing but the archives' directories is read for this.
        """
        same = self.seen.read().join(self.fingerprints(members), ["order_id", "fingerprint"])
        broken = members.filter(F.col("error").isNotNull()).select("order_id")
        same = same.join(broken, "order_id", "left_anti")
        known = self.ledger.read().select(*ledger_ops.KEY, "source_hash", F.lit(True).alias("there"))
        marked = same.join(known, [*ledger_ops.KEY, "source_hash"], "left")
        present = F.col("layer_name").isNull() | F.col("there").isNotNull()
        whole = marked.groupBy("order_id").agg(F.bool_and(present).alias("whole")).filter("whole").select("order_id")
        return same.join(whole, "order_id", "left_semi").select(*SEEN_SCHEMA.fieldNames())

    @staticmethod
    def layer_groups(catalogue: DataFrame) -> DataFrame:
        """One row per (order, layer): its files taken together, with one hash over them.

        A single file keeps its own hash. Of several, the hashes are added up in
        pieces, which needs no order and no list.
        """
        pieces = [
            F.sum(F.conv(F.substring("source_hash", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")) for k in range(4)
        ]
        count = F.count_distinct(F.struct("zip_name", "inner_path"))
        mixed = F.sha2(F.concat_ws("-", count, *pieces), 256)
        columns = F.to_json("columns")
        features = F.sum("feature_count") if "feature_count" in catalogue.columns else F.lit(None).cast("bigint")
        return (
            catalogue.filter(F.col("error").isNull())
            .groupBy("order_id", "layer_name")
            .agg(
                F.when(count == 1, F.max("source_hash")).otherwise(mixed).alias("source_hash"),
                F.min(F.element_at(F.split("inner_path", "/"), -1)).alias("source_file"),
                F.min("srid").alias("srid"),
                F.max_by("columns", columns).alias("columns"),
                features.alias("feature_count"),
                ((F.min(columns) == F.max(columns)) & (F.min("srid") == F.max("srid"))).alias("uniform"),
            )
        )

    # -- runs

    def publish_orders(
        self,
        order_ids: list[str] | None = None,
        layer_names: list[str] | None = None,
        table_name: str | None = None,
        if_exists: str = "replace",
    ) -> DataFrame:
        """Publish every due layer of the given orders, all orders when none are given.

        Orders whose archives' directories and ledger rows are those of an earlier run are
        skipped before a member is read, layers whose bytes are in the ledger before
        they are published. An order with an unreadable file publishes nothing: what the rest of
        its layers would hold is not known, so its tables stay as they are and each layer is
        reported with the error. A layer that fails is reported and the run goes on.

        ``table_name`` puts the layers in that table, else a table has its layer's name.
        With ``if_exists="append"`` layers add to a table, with ``fail`` an existing table is
        an error. ``layer_names`` are resolved by :func:`layers.resolved_names`. The driver
        walks over the names of the due layers. Layers alike in columns and system are published together, up to
        ``layers_per_job`` in one job; others, and those of a group that fails, one by one, ``layers_at_once`` at a
        time. They enter the ledger as soon as their tables are done.
        """
        if if_exists not in MODES:
            raise ValueError(f"if_exists is one of {', '.join(MODES)}")
        members = cut_lineage(self.members(order_ids))
        types = cut_lineage(self.types(members, order_ids))
        as_before = cut_lineage(self.unchanged(members))
        unpacked = f"{self.location}/unpacked/{uuid.uuid4().hex}"
        changed = members.join(as_before, "order_id", "left_anti")
        catalogue, contents = self.extracted(changed, types, unpacked)
        all_groups = cut_lineage(self.layer_groups(catalogue))
        before = as_before.filter(F.col("layer_name").isNotNull()).select(*ledger_ops.KEY, "source_hash")
        if layer_names:
            there = all_groups.select("layer_name").union(before.select("layer_name"))
            layer_names = layers.resolved_names(layer_names, there)
        groups, before = layers.only_layers(all_groups, layer_names), layers.only_layers(before, layer_names)
        ledger = self.ledger.read()
        outcomes = list(self._refused(order_ids, types)) if order_ids else []
        unreadable = catalogue.filter(F.col("error").isNotNull() & F.col("layer_name").isNull())
        for bad in catalogue.filter(F.col("error").isNotNull()).toLocalIterator():
            name = bad["layer_name"] or text_stem(bad["inner_path"] or bad["zip_name"])
            where = bad["zip_name"] if bad["layer_name"] is None else None
            error = f"{where}: {bad['error']}" if where else bad["error"]
            outcomes.append((bad["order_id"], name, name, 0, 0.0, "failed", error))
        whole = groups.join(unreadable, "order_id", "left_anti")
        for one in groups.join(unreadable, "order_id", "left_semi").select(*ledger_ops.KEY).toLocalIterator():
            table = table_name or text.clean_name(one["layer_name"])
            outcomes.append((one["order_id"], table, one["layer_name"], 0, 0.0, "failed", "a file of the order cannot be read"))
        due = ledger_ops.due(whole, ledger)
        by_table: dict[str, list] = {}
        for one in due.orderBy("order_id", "layer_name").toLocalIterator():
            by_table.setdefault(table_name or text.clean_name(one["layer_name"]), []).append(one)

        outcomes += self._publish_alike(contents, by_table, if_exists)

        def publish_table(table: str) -> list:
            if len(by_table[table]) > 1 and if_exists == "replace":
                warnings.warn(f"{table} is in {len(by_table[table])} layers, the last one stays", stacklevel=2)
            return [self._publish_one(contents, one, table, if_exists) for one in by_table[table]]

        with ThreadPoolExecutor(self.layers_at_once) as pool:
            for results in pool.map(publish_table, by_table):
                outcomes += results
        done = self.spark.createDataFrame(outcomes, REPORT_SCHEMA)
        loaded = whole.join(ledger.select(*ledger_ops.KEY, "source_hash"), [*ledger_ops.KEY, "source_hash"], "left_semi")
        current = loaded.select(*ledger_ops.KEY).unionByName(before.select(*ledger_ops.KEY))
        skipped = current.select(
            "order_id",
            (F.lit(table_name) if table_name else text.table_name(F.col("layer_name"))).alias("table_name"),
            "layer_name",
            F.lit(0).cast("bigint").alias("feature_count"),
            F.lit(0.0).alias("duration_seconds"),
            F.lit("skipped").alias("status"),
            F.lit(None).cast("string").alias("error"),
        )
        report = cut_lineage(done.unionByName(skipped))
        report.withColumn("reported_at", F.current_timestamp()).write.mode("append").parquet(self.reports)
        self._remember(changed, all_groups, catalogue)
        files.delete_tree(self.spark, unpacked)
        return report

    def _remember(self, changed: DataFrame, groups: DataFrame, catalogue: DataFrame) -> None:
        """Note which layers the changed orders have, under the fingerprint of their archives."""
        broken = catalogue.filter(F.col("error").isNotNull()).select("order_id")
        prints = self.fingerprints(changed).join(broken, "order_id", "left_anti")
        rows = prints.join(groups.select(*ledger_ops.KEY, "source_hash"), "order_id", "left")
        kept = self.seen.read().join(changed.select("order_id"), "order_id", "left_anti")
        self.seen.replace(kept.unionByName(rows.select(*SEEN_SCHEMA.fieldNames())))

    def _refused(self, order_ids: list[str], types: DataFrame) -> list[tuple]:
        """Report rows of orders that were asked for by name and cannot be published."""
        asked = self.spark.createDataFrame([(o,) for o in sorted(set(order_ids))], "order_id string")
        there = self.orders().withColumn("there", F.lit(True))
        kinds = types.select("order_id", "data_type", "is_publishable")
        joined = asked.join(there, "order_id", "left").join(kinds, "order_id", "left")
        rows = joined.filter(~F.coalesce("is_publishable", F.lit(False))).collect()  # the asked names at most
        return [
            (
                row["order_id"],
                None,
                None,
                0,
                0.0,
                "failed",
                f"data type {row['data_type'] or 'unknown'} cannot be published" if row["there"] else "no such order",
            )
            for row in rows
        ]

    def publish_incremental(self) -> DataFrame:
        """All orders, only the layers that are new or whose bytes changed."""
        return self.publish_orders()

    def _publish_alike(self, contents: DataFrame, by_table: dict[str, list], if_exists: str) -> list[tuple]:
        """Publish the layers that others are like, take them out of ``by_table``, return their report rows.

        Layers that replace one another in a table are left, as are those without features. What cannot be published
        together is left too, to be tried by itself.
        """
        alike: dict[str, list] = {}
        for table, ones in by_table.items():
            if if_exists != "append" and len(ones) > 1:
                continue
            for one in ones:
                if one["uniform"] and one["feature_count"]:
                    alike.setdefault(repr((one["columns"], one["srid"])), []).append((table, one))
        outcomes = []
        for group in alike.values():
            for cut in range(0, len(group), self.layers_per_job):
                some = group[cut : cut + self.layers_per_job]
                if len(some) > 1:
                    outcomes += self._publish_some(contents, some, by_table, if_exists)
        return outcomes

    def _publish_some(self, contents: DataFrame, some: list, by_table: dict[str, list], if_exists: str) -> list[tuple]:
        started = time.time()
        targets = [Target(one["order_id"], one["layer_name"], table) for table, one in some]
        orders, names = [sorted({one[c] for _, one in some}) for c in ledger_ops.KEY]
        try:
            keys = self.spark.createDataFrame([(t.order_id, t.layer_name) for t in targets], "order_id string, layer_name string")
            mine = contents.filter(F.col("order_id").isin(orders) & F.col("layer_name").isin(names))
            mine = mine.join(F.broadcast(keys), ledger_ops.KEY, "left_semi")  # layers_per_job rows at most
            features = archives.read_layer(mine, some[0][1]["columns"]).drop("zip_name", "inner_path", "source_row")
            loaded = publish_together(features, targets, self.database, some[0][1]["srid"], self.target_srid, if_exists)
        except Exception as error:  # one of them may be at fault: they are tried one by one
            warnings.warn(f"{len(some)} layers could not be published together: {str(error)[:200]}", stacklevel=2)
            return []
        done = [(table, one, stats) for (table, one), stats in zip(some, loaded, strict=True) if not isinstance(stats, Exception)]
        if done:
            rows = [
                (one["order_id"], one["source_file"], one["source_hash"], table, one["layer_name"], stats.count, *stats.box) for table, one, stats in done
            ]
            shape = "order_id string, source_file string, source_hash string, table_name string, layer_name string, feature_count bigint, minx double, miny double, maxx double, maxy double"
            new = self.spark.createDataFrame(rows, shape).withColumns({"bbox": layers.box_text(), "loaded_at": F.current_timestamp()})
            try:
                with self._ledger_lock:
                    self.ledger.upsert(new)
            except Exception as error:
                seconds = (time.time() - started) / len(some)
                for table, one, _ in done:
                    by_table[table].remove(one)
                return [(one["order_id"], table, one["layer_name"], 0, seconds, "failed", str(error)) for table, one, _ in done]
        seconds = (time.time() - started) / len(some)
        for table, one, _ in done:
            by_table[table].remove(one)
        return [(one["order_id"], table, one["layer_name"], stats.count, seconds, "ok", None) for table, one, stats in done]

    def _publish_one(self, contents: DataFrame, one, table: str, if_exists: str) -> tuple:
        """Publish one layer, enter it in the ledger, return its report row."""
        order_id, layer, started = one["order_id"], one["layer_name"], time.time()
        mine = (F.col("order_id") == order_id) & (F.col("layer_name") == layer)
        try:
            if not one["uniform"]:
                raise ValueError("the layer's files differ in columns or coordinate system")
            features = archives.read_layer(contents.filter(mine), one["columns"])
            stats = publish_layer(
                features.drop("order_id", "layer_name", "zip_name", "inner_path", "source_row"),
                table,
                self.database,
                source_srid=one["srid"],
                target_srid=self.target_srid,
                if_exists=if_exists,
                order_id=order_id,
                layer_name=layer,
            ).first()
            row = (order_id, one["source_file"], one["source_hash"], table, layer, stats["feature_count"], stats["bbox"])
            new = self.spark.createDataFrame([row], T.StructType(ledger_ops.LEDGER_SCHEMA.fields[:-1]))
            with self._ledger_lock:
                self.ledger.upsert(new.withColumn("loaded_at", F.current_timestamp()))
        except Exception as error:  # one layer does not stop the rest
            return (order_id, table, layer, 0, time.time() - started, "failed", str(error))
        return (order_id, table, layer, stats["feature_count"], time.time() - started, "ok", None)

    def cleanup_stale(self) -> list[str]:
        """Drop the layers of vanished orders, forget them, return their names.

        A table that other orders' layers share loses the rows of the vanished ones only.
        """
        ledger = self.ledger.read()
        stale = cut_lineage(ledger_ops.stale(ledger, self.orders()))
        kept = ledger.join(self.orders(), "order_id", "left_semi")
        shared = kept.select("table_name").distinct().withColumn("shared", F.lit(True))
        gone = stale.join(shared, "table_name", "left").orderBy(*ledger_ops.KEY)
        removed = []
        for row in gone.toLocalIterator():
            name = row["table_name"]
            removed.append(name)
            if row["shared"] and self.spark.catalog.tableExists(f"{self.database}.{name}"):
                drop_load(self.spark, self.database, name, load_key(row["order_id"], row["layer_name"]))
            elif not row["shared"]:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self.database}`.`{name}`")
                files.delete_tree(self.spark, f"{self.location}/{self.database}.db/{name}")
        if not removed:
            return []
        self.ledger.delete(stale.select(*ledger_ops.KEY))
        self.seen.replace(self.seen.read().join(self.orders(), "order_id", "left_semi"))
        return removed

    def set_package_name(self, order_id: str, package_name: str) -> None:
        row = self.spark.createDataFrame([(order_id, package_name)], LABEL_SCHEMA)
        self.labels.upsert(row)


def text_stem(path: str | None) -> str:
    """File name without its folders and last ending."""
    return (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]


# --- delivery metadata ---------------------------------------------------------------------


def write_order_metadata(listing: DataFrame, folder: str, delivered_at) -> None:
    """Metadata after a delivery: a line per order with its totals, a line per file.

    Kept as two JSON-lines tables, so an order with very many files is many
    lines and not one document.
    """
    listing.withColumn("updated", F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.mode(
        "overwrite"
    ).json(f"{folder}/files")
    per_order = listing.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size")
    )
    per_order.withColumn("download_date", F.date_format(delivered_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.mode(
        "overwrite"
    ).json(f"{folder}/orders")
