"""Queries on published layers: projection, filters, pages, counts, extents.

A layer is a DataFrame with ``fid``, its attributes, ``geom`` (see
``functions.geometry``), the envelope columns and two bookkeeping columns. The
filters are comparisons on stored columns, so on a Parquet layer they reach the
scan and skip row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, crs
from ..functions import geometry as G

ENVELOPE = ("xmin", "ymin", "xmax", "ymax")
STORAGE = ("geom", "geom_wkb", "srid", *ENVELOPE, "cell", "_load")
BOOKKEEPING = ("_source_order", "_loaded_at")

# Page limits.
PAGE_DEFAULT, PAGE_MAX = 1000, 10000
SAMPLE_ROWS, SAMPLE_COLUMNS = 3, 10
PREVIEW_ROWS, PREVIEW_WIDTH = 20, 50

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains")

Box = tuple[float, float, float, float]


def with_envelope(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumns(G.envelope(geom))


def envelope_columns(prefix: str = "") -> dict[str, str]:
    return {name: prefix + name for name in ENVELOPE}


def literal_box(b: Box) -> dict[str, str]:
    return {name: f"{float(value)!r}D" for name, value in zip(ENVELOPE, b)}


def parse_box(text: str) -> Box:
    """``minx,miny,maxx,maxy``; anything else is an error."""
    try:
        minx, miny, maxx, maxy = (float(part) for part in text.split(","))
    except ValueError:
        raise ValueError("a box is written minx,miny,maxx,maxy") from None
    return minx, miny, maxx, maxy


# --- projection ------------------------------------------------------------------


def properties(df: DataFrame, bookkeeping: bool = True) -> DataFrame:
    """All but the geometry; without ``bookkeeping`` also no fid or load columns."""
    dropped = STORAGE if bookkeeping else (*STORAGE, "fid", *BOOKKEEPING)
    return df.drop(*dropped)


def in_system(df: DataFrame, source: int, target: int) -> DataFrame:
    """Features with geometry and envelope in another system; as they are when both are equal."""
    if source == target:
        return df
    moved = df.withColumn("geom", crs.transform_geometry("geom", source, target)).drop("geom_wkb", "cell")
    return with_envelope(moved).withColumn("srid", F.lit(target))


# --- filters ---------------------------------------------------------------------


CELL_COMMENT = "layout cell in system "  # and its number: comment of a published layer's cell column


def cell_column(cell: Column, srid: int) -> Column:
    """The layout column under its name, with the system of its grid as a comment."""
    return cell.alias("cell", metadata={"comment": f"{CELL_COMMENT}{srid}"})


def cell_system(df: DataFrame) -> int | None:
    """The system of a published layer's layout cells; nothing for other DataFrames."""
    told = df.schema["cell"].metadata.get("comment", "") if "cell" in df.columns else ""
    return int(told.removeprefix(CELL_COMMENT)) if told.startswith(CELL_COMMENT) else None


def bbox_filter(df: DataFrame, box: Box | str) -> DataFrame:
    """Rows whose envelope meets the box, edges included.

    A published layer is also asked for the ranges of layout cells that can meet the box: its files are sorted by
    cell, so Parquet skips all row groups outside the ranges.
    """
    b = parse_box(box) if isinstance(box, str) else box
    meets = F.expr(G.boxes_overlap_sql(envelope_columns(), literal_box(b)))
    srid = cell_system(df)
    if srid is not None:
        meets = meets & cells.in_ranges(F.col("cell"), cells.box_ranges(b, srid))
    return df.filter(meets)


def intersects_box(df: DataFrame, box: Box) -> DataFrame:
    """Rows whose geometry meets the box; the envelope decides first."""
    return bbox_filter(df, box).filter(G.intersects_box("geom", literal_box(box)))


def projected_box(box: Box, source: int, target: int, spark: SparkSession) -> list[tuple[float, float]]:
    """The four corners of a box in another system (one literal row, no data read)."""
    xmin, ymin, xmax, ymax = box
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)]
    fields = []
    for i, (x, y) in enumerate(corners):
        moved = crs.transform_xy(f"{float(x)!r}D", f"{float(y)!r}D", source, target)
        fields += [moved[0].alias(f"x{i}"), moved[1].alias(f"y{i}")]
    row = spark.range(1).select(*fields).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(4)]


def intersects_box_in(df: DataFrame, box: Box, box_srid: int, layer_srid: int) -> DataFrame:
    """Rows that meet a box given in another system, taken as a projected quadrilateral."""
    if box_srid == layer_srid:
        return intersects_box(df, box)
    quad = projected_box(box, box_srid, layer_srid, df.sparkSession)
    xs, ys = [x for x, _ in quad], [y for _, y in quad]
    shape = G.polygon(*[(F.lit(x), F.lit(y)) for x, y in quad])
    near = bbox_filter(df, (min(xs), min(ys), max(xs), max(ys)))
    return near.withColumn("_quad", shape).filter(G.intersects("geom", "_quad")).drop("_quad")


def attr_filter(df: DataFrame, field: str, op: str, value: str) -> DataFrame:
    """One attribute condition; the value is cast to the column's type."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    column = F.col(f"`{field}`")
    if op == "contains":
        return df.filter(F.contains(column.cast("string"), F.lit(value)))
    wanted = F.lit(value).cast(df.schema[field].dataType)
    compare = {
        "=": column == wanted,
        "!=": column != wanted,
        ">": column > wanted,
        "<": column < wanted,
        ">=": column >= wanted,
        "<=": column <= wanted,
    }
    return df.filter(compare[op])


def only_layers(df: DataFrame, layers: Iterable[str] | None, column: str = "layer_name") -> DataFrame:
    """Rows of the named layers, all when no list is given."""
    names = list(layers or ())
    return df.filter(F.col(column).isin(names)) if names else df


def resolved_names(wanted: Iterable[str], there: DataFrame) -> list[str]:
    """The layers that are meant by names: the name itself, the only layer there is, or names equal but for case.

    A name that fits none is an error that tells the choices.
    """
    names = list(wanted)
    known = there.select("layer_name").distinct()
    few = [r[0] for r in known.limit(2).collect()]
    close = [r[0] for r in known.filter(F.lower("layer_name").isin([n.lower() for n in names])).collect()]
    out: list[str] = []
    for name in names:
        same = [n for n in close if n == name] or (few if len(few) == 1 else [n for n in close if n.lower() == name.lower()])
        if not same:
            choices = ", ".join(r[0] for r in known.orderBy("layer_name").toLocalIterator())
            raise ValueError(f"no layer {name}; there are: {choices}")
        out += same
    return list(dict.fromkeys(out))


def feature(df: DataFrame, fid: int) -> DataFrame:
    return df.filter(F.col("fid") == fid)


def public_only(df: DataFrame, column: str = "table_name") -> DataFrame:
    return df.filter(~F.startswith(F.col(column), F.lit("_")))


# --- pages -----------------------------------------------------------------------


def page(df: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in fid order."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit is 1 to {PAGE_MAX} and offset not negative")
    return df.orderBy("fid").offset(offset).limit(limit)


def page_after(df: DataFrame, last_fid: int, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Next page by key: deep pages cost no more than the first."""
    return page(df.filter(F.col("fid") > last_fid), limit)


def capped(df: DataFrame, limit: int = PAGE_DEFAULT) -> DataFrame:
    """At most ``limit`` rows, never above the cap, the lowest fids so that it repeats."""
    return df.orderBy("fid").limit(min(limit, PAGE_MAX))


def sample(df: DataFrame) -> DataFrame:
    """A few rows of the first plain columns, each as JSON text too."""
    plain = [c for c in df.columns if c not in ("geom", "geom_wkb")][:SAMPLE_COLUMNS]
    rows = df.select(*plain).limit(SAMPLE_ROWS)
    return rows.withColumn("row_json", F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}))


def preview(df: DataFrame) -> DataFrame:
    """First rows as short text, NULL spelled out, nested values as JSON."""

    def show(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.to_json(value), F.lit("NULL")).alias(field.name)
        text = F.substring(value.cast("string"), 1, PREVIEW_WIDTH)
        return F.coalesce(text, F.lit("NULL")).alias(field.name)

    return df.limit(PREVIEW_ROWS).select(*[show(field) for field in df.schema.fields])


# --- counts and extents ------------------------------------------------------------


def extent_aggregates() -> list[Column]:
    return [
        F.min("xmin").alias("minx"),
        F.min("ymin").alias("miny"),
        F.max("xmax").alias("maxx"),
        F.max("ymax").alias("maxy"),
    ]


def match_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def extent(df: DataFrame) -> DataFrame:
    """minx, miny, maxx, maxy; nulls for an empty layer."""
    return df.agg(*extent_aggregates())


def box_text(minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> Column:
    """Envelope as polygon text, corners from the lower left, up first."""
    corners = [(minx, miny), (minx, maxy), (maxx, maxy), (maxx, miny), (minx, miny)]
    pairs = ", ', ', ".join(f"{G.number_sql(x)}, ' ', {G.number_sql(y)}" for x, y in corners)
    return F.expr(f"concat('POLYGON((', {pairs}, '))')")


def extent_text(df: DataFrame) -> DataFrame:
    e = extent(df)
    return e.select(box_text().alias("bbox"))  # null for an empty layer


def source_extent(catalogue: DataFrame, features: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Stored extent of each layer, computed from its features where it is not complete."""
    keys = list(keys)
    stored = ("min_x", "min_y", "max_x", "max_y")
    complete = F.lit(True)
    for name in stored:
        complete = complete & F.col(name).isNotNull()
    missing = catalogue.filter(~complete).select(*keys)
    computed = features.join(missing, keys, "left_semi").groupBy(*keys).agg(*extent_aggregates())
    pick = [
        F.when(complete, F.col(s)).otherwise(F.col(c)).alias(c)
        for s, c in zip(stored, ("minx", "miny", "maxx", "maxy"))
    ]
    return catalogue.join(computed, keys, "left").select(*keys, *pick)


def table_stats(df: DataFrame, name: str) -> DataFrame:
    """Count, extent, columns, owning order and load time in one pass."""
    columns = ", ".join(c for c in df.columns if c not in STORAGE)
    return df.agg(
        F.count(F.lit(1)).alias("feature_count"),
        *extent_aggregates(),
        F.min_by("_source_order", "fid").alias("source_order"),
        F.min_by("_loaded_at", "fid").alias("loaded_at"),
    ).select(F.lit(name).alias("table_name"), "*", F.lit(columns).alias("columns"))


def schema_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: columns with types, geometry type, srid, row count."""
    profiles = []
    for name, df in tables.items():
        shown = ", ".join(
            f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name not in STORAGE
        )
        kind = F.max(F.col("geom")["type"]) if "geom" in df.columns else F.lit(None).cast("string")
        srid = F.max("srid") if "srid" in df.columns else F.lit(None).cast("int")
        profiles.append(
            df.agg(kind.alias("geometry_type"), srid.alias("srid"), F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(shown).alias("columns"), "geometry_type", "srid", "row_count"
            )
        )
    whole = profiles[0]
    for profile in profiles[1:]:
        whole = whole.unionByName(profile)
    return whole


# Table properties that publishing sets: features, features of each geometry type, system, the last fid that was given,
# and whether a run was lost before these were told.
FACT_COUNT, FACT_KINDS, FACT_SRID = "layer.feature_count", "layer.geometry_types", "layer.srid"
FACT_LAST, FACT_UNSURE = "layer.last_fid", "layer.unsure"


def table_facts(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def kind_counts(facts: Mapping[str, str]) -> dict[str, int]:
    """Features of each geometry type, from the facts of a table."""
    pairs = (part.split(":") for part in filter(None, facts.get(FACT_KINDS, "").split(",")))
    return {kind: int(n) for kind, n in pairs if int(n)}


def published_profile(spark: SparkSession, database: str) -> DataFrame:
    """One row per published layer: columns with types, geometry type, srid, row count.

    All of it is what publishing noted in the catalogue; no layer is read. Several geometry types stand
    side by side, separated by commas.
    """
    rows = []
    for name, df in layer_catalogue(spark, database).items():
        facts = table_facts(spark, f"`{database}`.`{name}`")
        shown = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name not in STORAGE)
        srid = facts.get(FACT_SRID)
        kinds = ",".join(sorted(kind_counts(facts)))
        rows.append((name, shown, kinds or None, int(srid) if srid else None, int(facts.get(FACT_COUNT, 0))))
    return spark.createDataFrame(rows, "table_name string, columns string, geometry_type string, srid int, row_count bigint")


def load_folders(spark: SparkSession, table: str) -> list[str]:
    """Folders of a published table's loads, from the catalogue: a name per load."""
    state = spark._jsparkSession.sessionState()
    found = state.catalog().listPartitions(state.sqlParser().parseTableIdentifier(table), spark.sparkContext._jvm.scala.Option.empty()).iterator()
    out = []
    while found.hasNext():
        out.append(found.next().location().toString())
    return out


V1_SOURCES = "spark.sql.sources.useV1SourceList"


def from_footers(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a published table through the Parquet reader that answers counts, minima and maxima from file footers.

    For whole tables; with a filter or a grouping it reads the columns like any other. Row counts and column statistics of a
    footer are exact, so the answers are those of a scan.
    """
    folders = load_folders(spark, table)
    schema = T.StructType([f for f in spark.table(table).schema.fields if f.name != "_load"])
    if not folders:
        return spark.createDataFrame([], schema)
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, ",".join(name for name in before.split(",") if name.strip() != "parquet"))
    try:
        return spark.read.schema(schema).parquet(*folders)
    finally:
        spark.conf.set(V1_SOURCES, before)


def _told_count(count: str, last: str) -> Column:
    """A count from footers; files without any row tell none, though the column is never null for Spark."""
    return F.when(F.col(last).isNull(), F.lit(0).cast("bigint")).otherwise(F.col(count))


def table_count(spark: SparkSession, table: str) -> DataFrame:
    """:func:`match_count` of a whole published table; no column is read."""
    found = from_footers(spark, table).agg(F.count(F.lit(1)).alias("n"), F.max("fid").alias("last"))
    return found.select(_told_count("n", "last").alias("total_count"))


def table_extent(spark: SparkSession, table: str) -> DataFrame:
    """:func:`extent` of a whole published table; no column is read."""
    return extent(from_footers(spark, table))


def published_stats(spark: SparkSession, database: str, name: str) -> DataFrame:
    """:func:`table_stats` of a published table: count and extent from footers, the first feature's order and load time
    from three narrow columns."""
    table = f"`{database}`.`{name}`"
    whole = from_footers(spark, table).agg(F.count(F.lit(1)).alias("feature_count"), *extent_aggregates(), F.max("fid").alias("last"))
    whole = whole.withColumn("feature_count", _told_count("feature_count", "last")).drop("last")
    first = spark.table(table).agg(F.min_by("_source_order", "fid").alias("source_order"), F.min_by("_loaded_at", "fid").alias("loaded_at"))
    columns = ", ".join(c for c in spark.table(table).columns if c not in STORAGE)
    both = whole.join(F.broadcast(first), F.lit(True))  # a row each
    return both.select(F.lit(name).alias("table_name"), "*", F.lit(columns).alias("columns"))


def layer_catalogue(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """Public layers of a database by name."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    return {name: spark.table(f"{database}.`{name}`") for name in names if not name.startswith("_")}


def owning_orders(layer: DataFrame, orders: DataFrame) -> DataFrame:
    """Features with the row of the order they came from."""
    return layer.join(orders, layer["_source_order"] == orders["order_id"], "inner")
