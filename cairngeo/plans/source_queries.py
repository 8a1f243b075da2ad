"""Readers and sinks over deliveries landed from the derived views, registered."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geometry as G
from ..functions.sql import register_functions
from ..operators import deliveries, export, feeds, filters, layers, ledger, publish
from ..operators import tiles as tile_ops
from ..operators.entrylog import EntryLog
from ..sources import archives, gpkg
from ..sources import deliveries as readers
from ..sources import feeds as feed_readers
from . import landing, views
from .layer_queries import BOX, IN_BOX, STAMP, stamp
from .registry import query
from .view_sql import projected, sql

ARCHIVES = "SELECT DISTINCT 'o' || (c_custkey % 4) AS order_id, 'points_' || (c_custkey // 20000) || '.zip' AS file_name FROM customer"


@query("S1_scan_orders", ARCHIVES)
def s1(spark, d):
    return readers.scan_orders(spark, landing.land_archives(spark, d)).select("order_id", "file_name")


@query(
    "S2_zip_members",
    f"SELECT order_id, file_name AS zip_name, entry, CASE entry WHEN 0 THEN 'data/points_' || order_id || '_sverige.gpkg' ELSE 'readme.txt' END AS inner_path,"
    f" CASE entry WHEN 0 THEN '.gpkg' ELSE '.txt' END AS extension FROM ({ARCHIVES}), (VALUES (0), (1)) AS e(entry)",
)
def s2(spark, d):
    files = readers.scan_orders(spark, landing.land_archives(spark, d))
    return archives.zip_members(files).filter("error IS NULL").select("order_id", "zip_name", "entry", "inner_path", "extension")


def _staged(spark, d, rows_per_archive=landing.ROWS_PER_ARCHIVE):
    root = landing.land_archives(spark, d, rows_per_archive)
    members = archives.zip_members(readers.scan_orders(spark, root))
    return archives.unpack(members, landing.new_folder(spark, "unpacked"))


@query(
    "S4_source_layers",
    """SELECT 'o' || (c_custkey % 4) AS order_id, 'points_' || (c_custkey // 20000) || '.zip' AS zip_name,
              'points_o' || (c_custkey % 4) AS layer_name, 'POINT' AS geometry_type, 3006 AS srid, count(*) AS feature_count,
              'c_name:TEXT, c_acctbal:REAL, C-MktSegment:TEXT(10)' AS columns, true AS hashed
       FROM customer GROUP BY ALL""",
)
def s4(spark, d):
    members = archives.zip_members(readers.scan_orders(spark, landing.land_archives(spark, d)))
    found = archives.catalogue(members)  # no feature is unpacked
    shown = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ", ")
    return found.select(
        "order_id",
        "zip_name",
        "layer_name",
        "geometry_type",
        "srid",
        "feature_count",
        shown.alias("columns"),
        (F.length("source_hash") == 64).alias("hashed"),
    )


COLUMNS = [
    {"name": "c_name", "type": "TEXT"},
    {"name": "c_acctbal", "type": "REAL"},
    {"name": "C-MktSegment", "type": "TEXT(10)"},
]


def _ingested(spark, d):
    return archives.read_layer(_staged(spark, d), COLUMNS)


@query(
    "S3_layer_ingest",
    sql(
        "SELECT 'o' || (fid % 4) AS order_id, 'points_o' || (fid % 4) AS layer_name, fid AS source_row, c_name, c_acctbal,"
        " c_mktsegment, x, y FROM point_layer",
        "point_layer",
    ),
)
def s3(spark, d):
    rows = _ingested(spark, d).withColumn("geom", G.parse_wkb("geom_wkb")).withColumns(G.envelope("geom"))
    return rows.selectExpr(
        "order_id", "layer_name", "source_row", "c_name", "c_acctbal", "c_mktsegment", "xmin AS x", "ymin AS y"
    )


@query(
    "S3_data_source",
    sql(
        "SELECT 'o1' AS order_id, 'points_' || (fid // 300) || '.zip' AS zip_name, fid AS source_row, c_name, c_acctbal, c_mktsegment, x, y"
        " FROM point_layer WHERE fid % 4 = 1 AND fid >= 200 AND fid // 300 <> 2",
        "point_layer",
    ),
)
def s3c(spark, d):
    """One layer as a data source, in ranges of 40 features, with filters that leave out archives and rows."""
    root, folder = landing.land_archives(spark, d, 300), landing.new_folder(spark, "catalogue")
    archives.catalogue(archives.zip_members(readers.scan_orders(spark, root))).write.parquet(folder)
    gpkg.register(spark)
    read = spark.read.format("gpkg").option("layer", "points_o1").option("rowsPerTask", 40).load(folder)
    names = [f"points_{k}.zip" for k in range(views.table(spark, d, "customer").count() // 300 + 1) if k != 2]
    rows = read.filter(F.col("zip_name").isin(names) & (F.col("source_row") >= 200))
    rows = rows.withColumn("geom", G.parse_wkb("geom_wkb")).withColumns(G.envelope("geom"))
    return rows.selectExpr("order_id", "zip_name", "source_row", "c_name", "c_acctbal", "c_mktsegment", "xmin AS x", "ymin AS y")


@query(
    "O3_source_page",
    sql(
        "SELECT fid AS source_row, c_name FROM point_layer WHERE fid % 4 = 1"
        " ORDER BY 'points_' || (fid // 90) || '.zip', fid LIMIT 20 OFFSET 30",
        "point_layer",
    ),
)
def o3(spark, d):
    # archives of 90 customers: a page spans several of them, in the order of their names
    rows = archives.read_layer(_staged(spark, d, 90).filter("order_id = 'o1'"), COLUMNS)
    return archives.read_rows(rows, limit=20, offset=30).select("source_row", "c_name")


@query("F30_column_types", "SELECT 'c_name:string, c_acctbal:double, c_mktsegment:string' AS columns, count(*) AS features FROM customer")
def f30(spark, d):
    fields = archives.layer_fields(COLUMNS)
    shown = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return _ingested(spark, d).agg(F.count(F.lit(1)).alias("features")).withColumn("columns", F.lit(shown))


@query(
    "S5_delivery_stats",
    sql(
        """SELECT o.order_id, o.filename, CAST(coalesce(sum(s.objects), 0) AS BIGINT) AS objects, count(s.objects) AS tables,
                  CAST(any_value(o.k) AS DOUBLE) AS e
           FROM (SELECT DISTINCT 'o' || (l_orderkey % 200) AS order_id, 'f' || l_partkey || '.gpkg' AS filename, l_partkey AS k
                 FROM lineitem) o
           LEFT JOIN every_statistic s ON s.order_id = o.order_id AND s.filename = o.filename GROUP BY o.order_id, o.filename""",
        "every_statistic",
    ),
)
def s5(spark, d):
    read = readers.read_delivery_stats(spark, landing.land_statistics(spark, d))
    return read.select(
        "order_id",
        "filename",
        deliveries.object_count(F.col("statistics")).alias("objects"),
        F.size("statistics").alias("tables"),
        F.col("geometry.coordinates")[0][0][0].alias("e"),
    )


@query(
    "S6_tile_index",
    sql("SELECT t.order_id, t.title, t.size, 'https://tiles/' || t.title AS href, grid_x, grid_y FROM laz_tiles t", "laz_tiles"),
)
def s6(spark, d):
    read = tile_ops.parsed(readers.read_tile_index(spark, landing.land_tile_index(spark, d)))
    return read.select("order_id", "title", "size", "href", "grid_x", "grid_y")


@query("S7_file_listing", sql(f"SELECT order_id, title, 'https://files/' || title AS href, length, {STAMP.format('updated')} AS updated FROM listing", "listing"))
def s7(spark, d):
    read = readers.read_file_listing(spark, landing.land_listing(spark, d), "listing.json")
    return read.select("order_id", "title", "href", "length", stamp("updated"))


@query(
    "S8_order_metadata",
    sql(
        f"""SELECT order_id, {STAMP.format('download_date')} AS download_date,
                   CASE WHEN k % 2 = 1 THEN k * 100 END AS total_size,
                   CASE WHEN k % 3 = 0 THEN 'package ' || order_id ELSE '' END AS package_name
            FROM (SELECT *, CAST(substr(order_id, 2) AS INT) AS k FROM every_folder) WHERE k % 2 = 0 OR k % 3 = 0""",
        "every_folder",
    ),
)
def s8(spark, d):
    read = readers.read_order_metadata(spark, landing.land_metadata(spark, d))
    return read.select("order_id", stamp("download_date"), "total_size", "package_name")


@query(
    "S9_feed_readers",
    sql(f"SELECT announcement_id, train, station_name, lon, lat, origin, destination, delay, operator, {STAMP.format('time')} AS time FROM train_rows", "train_rows"),
)
def s9(spark, d):
    folder = landing.new_folder(spark, "feeds")
    # the feeds carry their times with a zone
    zoned = {c: F.col(c).cast("timestamp") for c in ("TimeAtLocation", "AdvertisedTimeAtLocation")}
    views.announcements(spark, d).withColumns(zoned).write.json(f"{folder}/announcements")
    views.stations(spark, d).write.json(f"{folder}/stations")
    stations = feeds.advertised_stations(feed_readers.read_stations(spark, f"{folder}/stations"))
    rows = feeds.train_rows(feed_readers.read_announcements(spark, f"{folder}/announcements"), stations)
    return rows.drop("delay_class", "delay_text").withColumn("time", stamp("time"))


@query(
    "S9_weather_reader",
    sql(f"SELECT id, name, lon, lat, round(air_temp, 4) AS air_temp, wind_dir, precipitation, {STAMP.format('sample')} AS sample FROM weather", "weather"),
)
def s9b(spark, d):
    folder = landing.new_folder(spark, "feeds")
    zoned = F.col("Observation").withField("Sample", F.col("Observation.Sample").cast("timestamp"))
    views.weather(spark, d).withColumn("Observation", zoned).drop("event_id").write.json(folder)
    rows = feeds.weather_rows(feed_readers.read_weather(spark, folder))
    shown = rows.select("id", "name", "lon", "lat", "air_temp", "wind_dir", "precipitation", "sample")
    return shown.withColumns({"sample": stamp("sample"), "air_temp": F.round("air_temp", 4)})


# --- sinks -------------------------------------------------------------------------------


def _database(spark) -> str:
    folder = landing.new_folder(spark, "db")
    name = "geo_" + folder.rsplit("-", 1)[1]
    publish.create_database(spark, name, folder)
    return name


def _published(spark, d, target_srid=crs.WGS84):
    return spark.table(f"{_published_in(spark, d, target_srid)}.points")


def _published_in(spark, d, target_srid):
    name = _database(spark)
    source = views.point_layer(spark, d).select("fid", "geom", "c_name").withColumnRenamed("fid", "source_fid")
    publish.publish_layer(source, "points", name, crs.SWEREF, ["source_fid"], target_srid=target_srid, order_id="o1")
    return name


DEGREES = projected("SELECT fid, c_name, x AS e, y AS n FROM point_layer")


@query(
    "K1_publish_layer",
    sql("", "point_layer") + f""" SELECT row_number() OVER (ORDER BY fid) AS fid, c_name, round(lon, 6) AS lon, round(lat, 6) AS lat,
        4326 AS srid, 21 AS wkb_bytes, 'o1' AS _source_order FROM {DEGREES}""".replace(" SELECT row", "\nSELECT row"),
)
def k1(spark, d):
    return _published(spark, d).select(
        "fid",
        "c_name",
        F.round("xmin", 6).alias("lon"),
        F.round("ymin", 6).alias("lat"),
        "srid",
        F.length("geom_wkb").alias("wkb_bytes"),
        "_source_order",
    )


@query("S10_layer_scan", sql("SELECT row_number() OVER (ORDER BY fid) AS fid, c_name, x, y FROM point_layer", "point_layer"))
def s10(spark, d):
    published = _published_in(spark, d, crs.SWEREF)
    return feed_readers.layer(spark, "points", published).selectExpr("fid", "c_name", "xmin AS x", "ymin AS y")


@query("K2_cell_layout_filter", sql(f"SELECT c_name, x, y FROM point_layer WHERE {IN_BOX}", "point_layer"))
def k2(spark, d):
    return layers.bbox_filter(_published(spark, d, crs.SWEREF), BOX).selectExpr("c_name", "xmin AS x", "ymin AS y")


@query("A1_count_from_footers", sql("SELECT count(*) AS total_count FROM box_layer", "box_layer"))
def a1f(spark, d):
    """The count of a whole published layer, from the footers of its files."""
    return layers.table_count(spark, f"{_published_boxes(spark, d)}.boxes")


@query("A2_extent_from_footers", sql("SELECT min(xmin) AS minx, min(ymin) AS miny, max(xmax) AS maxx, max(ymax) AS maxy FROM box_layer", "box_layer"))
def a2f(spark, d):
    """The extent of a whole published layer, from the footers of its files."""
    return layers.table_extent(spark, f"{_published_boxes(spark, d)}.boxes")


@query(
    "A21_published_stats",
    sql(
        """SELECT 'boxes' AS table_name, count(*) AS feature_count, min(xmin) AS minx, min(ymin) AS miny, max(xmax) AS maxx, max(ymax) AS maxy,
                  'o7' AS source_order, true AS loaded, 'fid, source_fid, s_name, _source_order, _loaded_at' AS columns FROM box_layer""",
        "box_layer",
    ),
)
def a21p(spark, d):
    """Statistics of a published layer; of its columns only the first feature's order and load time are read."""
    found = layers.published_stats(spark, _published_boxes(spark, d), "boxes")
    return found.withColumn("loaded", F.col("loaded_at").isNotNull()).drop("loaded_at")


def _published_boxes(spark, d) -> str:
    name = _database(spark)
    source = views.box_layer(spark, d).select(F.col("fid").alias("source_fid"), "geom", "s_name")
    publish.publish_layer(source, "boxes", name, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, order_id="o7")
    return name


CELL_BOXES = (BOX, (310000.0, 6210000.0, 310500.0, 6290000.0), (-1e9, -1e9, 1e9, 1e9), (555000.0, 6900000.0, 556000.0, 6901000.0))


@query(
    "K2_cell_ranges",
    sql(
        "SELECT k, s_name, xmin, ymin, xmax, ymax FROM box_layer, (VALUES "
        + ", ".join(f"({k}, {b[0]}, {b[1]}, {b[2]}, {b[3]})" for k, b in enumerate(CELL_BOXES))
        + ") v(k, x0, y0, x1, y1) WHERE xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0",
        "box_layer",
    ),
)
def k2b(spark, d):
    """Boxes of several sizes by the ranges of layout cells that Parquet skips row groups with."""
    name = _published_boxes(spark, d)
    found = [layers.bbox_filter(spark.table(f"{name}.boxes"), b).select(F.lit(k).alias("k"), "s_name", *layers.ENVELOPE) for k, b in enumerate(CELL_BOXES)]
    return functools.reduce(DataFrame.unionByName, found)


def _graph(*orders: str) -> dict:
    """Orders into a filter on the balance, that into one on the segment, and both filters into a table each."""

    def node(name, data, *feeding):
        return {"name": name, "data": data, "inputs": {"input_1": {"connections": [{"node": n} for n in feeding]}} if feeding else {}}

    nodes = {f"o{k}": node("OrderNode", {"orderId": order}) for k, order in enumerate(orders)}
    nodes["rich"] = node("FilterNode", {"field": "c_acctbal", "operator": ">", "value": "0"}, *nodes)
    nodes["some"] = node("FilterNode", {"field": "c_mktsegment", "operator": "contains", "value": "M"}, "rich")
    nodes["one"] = node("DatabaseNode", {"connectionName": "rich"}, "rich")
    nodes["two"] = node("DatabaseNode", {"connectionName": "rich_m"}, "some")
    return {"drawflow": {"Home": {"data": nodes}}}


@query(
    "P6_run_graph",
    sql(
        """SELECT t.name, row_number() OVER (PARTITION BY t.name ORDER BY p.fid) AS fid, p.fid AS source_fid, c_name, x, y
           FROM point_layer p, (VALUES ('rich', ''), ('rich_m', 'M')) AS t(name, part)
           WHERE c_acctbal > 0 AND contains(c_mktsegment, t.part) AND _source_order IN ('o3', 'o17', 'o249')""",
        "point_layer",
    ),
)
def p6b(spark, d):
    """A graph of three named orders run to the end: what reaches its tables is published."""
    name = _database(spark)
    source = filters.orders_in(views.point_layer(spark, d).withColumn("source_fid", F.col("fid")))
    filters.run_graph(_graph("o3", "o17", "o249", "gone"), source, name, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF)
    found = [spark.table(f"{name}.{t}").selectExpr(f"'{t}' AS name", "fid", "source_fid", "c_name", "xmin AS x", "ymin AS y") for t in ("rich", "rich_m")]
    return found[0].unionByName(found[1])


@query("U1_append_layer", sql("SELECT c_name, CASE WHEN c_mktsegment < 'F' THEN row_number() OVER (PARTITION BY c_mktsegment < 'F' ORDER BY fid) ELSE (SELECT count(*) FROM point_layer WHERE c_mktsegment < 'F') + row_number() OVER (PARTITION BY c_mktsegment < 'F' ORDER BY fid) END AS fid FROM point_layer", "point_layer"))
def u1(spark, d):
    name = _database(spark)
    source = views.point_layer(spark, d).withColumnRenamed("fid", "source_fid")
    for mode, rows in (("fail", source.filter("c_mktsegment < 'F'")), ("append", source.filter("c_mktsegment >= 'F'"))):
        picked = rows.select("source_fid", "geom", "c_name")
        publish.publish_layer(picked, "points", name, crs.SWEREF, ["source_fid"], if_exists=mode, target_srid=crs.SWEREF)
    return spark.table(f"{name}.points").select("c_name", "fid")


@query("W2_serial_fids", sql("SELECT row_number() OVER (ORDER BY c_mktsegment, point_layer.fid) AS fid, c_name FROM point_layer", "point_layer"))
def w2(spark, d):
    rows = views.point_layer(spark, d).selectExpr("fid AS source_fid", "c_name", "c_mktsegment")
    return publish.assign_fids(rows, ["c_mktsegment", "source_fid"]).select("fid", "c_name")


def _ledger_store(spark, d) -> EntryLog:
    store = publish.ledger_table(spark, landing.new_folder(spark, "ledger"))
    store.replace(views.ledger(spark, d).withColumn("bbox", F.lit(None).cast("string")))
    return store


@query("K4_ledger_creation", sql(f"SELECT order_id, layer_name, source_hash, feature_count, {STAMP.format('loaded_at')} AS loaded_at FROM ledger", "ledger"))
def k4(spark, d):
    store = publish.ledger_table(spark, landing.new_folder(spark, "ledger"))
    store.upsert(store.read())  # making it again changes nothing
    store.upsert(views.ledger(spark, d).withColumn("bbox", F.lit(None).cast("string")))
    return store.read().select("order_id", "layer_name", "source_hash", "feature_count", stamp("loaded_at"))


@query(
    "K3_ledger_upsert",
    sql(
        """SELECT coalesce(c.order_id, l.order_id) AS order_id, coalesce(c.layer_name, l.layer_name) AS layer_name,
                  coalesce(c.source_hash, l.source_hash) AS source_hash, coalesce(c.feature_count, l.feature_count) AS feature_count
           FROM ledger l FULL JOIN candidates c ON c.order_id = l.order_id AND c.layer_name = l.layer_name""",
        "candidates",
    ),
)
def k3(spark, d):
    store = _ledger_store(spark, d)
    due = ledger.due(views.candidates(spark, d), store.read())
    filled = due.withColumns(
        {
            "source_file": F.concat("layer_name", F.lit(".gpkg")),
            "table_name": F.col("layer_name"),
            "bbox": F.lit(None).cast("string"),
            "loaded_at": F.lit("2024-06-01").cast("timestamp"),
        }
    )
    store.upsert(filled)
    return store.read().select("order_id", "layer_name", "source_hash", "feature_count")


LOG_TURNS = 12


@query(
    "K3_ledger_log",
    sql(
        f"""SELECT coalesce(c.order_id, l.order_id) AS order_id, coalesce(c.layer_name, l.layer_name) AS layer_name,
                  coalesce(c.source_hash, l.source_hash) AS source_hash, coalesce(c.feature_count, l.feature_count) AS feature_count
           FROM ledger l FULL JOIN candidates c ON c.order_id = l.order_id AND c.layer_name = l.layer_name
           WHERE CAST(substr(coalesce(c.order_id, l.order_id), 2) AS INT) % {LOG_TURNS} <> 5""",
        "candidates",
    ),
)
def k3b(spark, d):
    """The ledger as a log: many small changes and a deletion, folded on the way, then read as a table."""
    store = EntryLog(spark, landing.new_folder(spark, "ledger"), ledger.LEDGER_SCHEMA, ledger.KEY, fanout=3)
    turn = F.substring("order_id", 2, 9).cast("int") % LOG_TURNS
    old = views.ledger(spark, d).withColumn("bbox", F.lit(None).cast("string"))
    new = views.candidates(spark, d).select("order_id", "layer_name", "source_hash", "feature_count")
    empty = {"source_file": "string", "table_name": "string", "bbox": "string", "loaded_at": "timestamp"}
    new = new.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
    store.replace(old.filter(turn < LOG_TURNS // 2))
    store.upsert(old.filter(turn >= LOG_TURNS // 2))
    for k in range(LOG_TURNS):
        store.upsert(new.filter(turn == k))
    store.delete(store.read().filter(turn == 5).select(*ledger.KEY))
    return store.read().select("order_id", "layer_name", "source_hash", "feature_count")


def _publisher(spark, d) -> publish.Publisher:
    location = landing.new_folder(spark, "store")
    name = "geo_" + location.rsplit("-", 1)[1]
    return publish.Publisher(spark, landing.land_archives(spark, d), name, location=location)


PER_ORDER = "SELECT 'o' || (c_custkey % 4) AS order_id, 'points_o' || (c_custkey % 4) AS table_name, count(*) AS feature_count FROM customer GROUP BY ALL"


@query("K5_publish_orders", f"SELECT order_id, table_name, table_name AS layer_name, feature_count, 'ok' AS status FROM ({PER_ORDER})")
def k5(spark, d):
    report = _publisher(spark, d).publish_orders()
    return report.select("order_id", "table_name", "layer_name", "feature_count", "status")


def _changed_order(spark, d):
    """What ``o2`` delivers the second time: every other of its customers, with another balance."""
    again = views.point_layer(spark, d).filter(F.col("fid") % (2 * landing.ORDERS) == 2)
    return again.withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query(
    "K5_append_again",
    """SELECT 'o' || (c_custkey % 4) AS _source_order, count(*) AS features,
              CAST(sum(CAST(round(100 * (c_acctbal + CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END)) AS BIGINT)) AS BIGINT) AS cents,
              true AS fids_unique, true AS told
       FROM customer WHERE c_custkey % 4 <> 2 OR c_custkey % 8 = 2 GROUP BY 1""",
)
def k5d(spark, d):
    """Orders in one table, one of them delivered again with other rows: it replaces its own and nothing else."""
    publisher = _publisher(spark, d)
    publisher.publish_orders(table_name="all_points", if_exists="append")
    landing.put_orders(_changed_order(spark, d), publisher.root)
    publisher.publish_orders(table_name="all_points", if_exists="append")
    rows = feed_readers.layer(spark, "all_points", publisher.database)
    told = layers.published_profile(spark, publisher.database).select("row_count")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fid").alias("fids"))
    unique = total.join(told, F.col("n") == F.col("row_count"), "left")
    per_order = rows.groupBy("_source_order").agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.round(100 * F.col("c_acctbal")).cast("bigint")).alias("cents")
    )
    marks = unique.select((F.col("n") == F.col("fids")).alias("fids_unique"), F.col("row_count").isNotNull().alias("told"))
    return per_order.join(F.broadcast(marks), F.lit(True))  # one row


@query(
    "K6_publish_incremental",
    f"SELECT order_id, table_name, CASE WHEN order_id = 'o2' THEN 'ok' ELSE 'skipped' END AS status FROM ({PER_ORDER})",
)
def k6(spark, d):
    publisher = _publisher(spark, d)
    publisher.publish_orders()
    landing.put_orders(_changed_order(spark, d), publisher.root)
    return publisher.publish_incremental().select("order_id", "table_name", "status")


@query(
    "K7_cleanup_stale",
    sql("SELECT order_id, layer_name FROM ledger WHERE order_id IN ('o0', 'o1', 'o2', 'o3')", "ledger"),
)
def k7(spark, d):
    publisher = _publisher(spark, d)
    publisher.ledger.replace(views.ledger(spark, d).withColumn("bbox", F.lit(None).cast("string")))
    publisher.cleanup_stale()
    return publisher.ledger.read().select("order_id", "layer_name")


@query("K9_run_report", f"SELECT order_id, table_name, feature_count, 'ok' AS status, true AS timed FROM ({PER_ORDER})")
def k9(spark, d):
    publisher = _publisher(spark, d)
    publisher.publish_orders()
    written = spark.read.parquet(publisher.reports)
    return written.select("order_id", "table_name", "feature_count", "status", (F.col("duration_seconds") > 0).alias("timed"))


FEATURE = """'{"type":"Feature","id":' || fid || ',"geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"fid":'
    || fid || ',"c_name":"' || c_name || '","c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '","_source_order":"o' || (fid % 250)
    || '","_loaded_at":"' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(fid AS INT)), '%Y-%m-%dT%H:%M:%S.000') || '"}}'"""


@query("K8_geojson_export", sql(f"SELECT {FEATURE} AS value FROM point_layer", "point_layer"))
def k8(spark, d):
    path = landing.new_folder(spark, "geojson")
    export.write_geojson(views.point_layer(spark, d), path)
    return spark.read.text(path)


@query(
    "K8_feature_collection",
    sql(
        f"""SELECT '{{"type":"FeatureCollection","features":[' || string_agg({FEATURE}, ',' ORDER BY fid) || '],"total_count":'
            || any_value(total) || '}}' AS value
            FROM (SELECT *, count(*) OVER () AS total FROM point_layer WHERE {IN_BOX} ORDER BY fid LIMIT 50)""",
        "point_layer",
    ),
)
def k8b(spark, d):
    return export.feature_collection(layers.bbox_filter(views.point_layer(spark, d), BOX), 50)


@query(
    "K10_metadata_snapshot",
    sql("SELECT order_id, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_size, '2024-06-01 00:00:00' AS download_date, count(updated) AS dated FROM listing GROUP BY order_id", "listing"),
)
def k10(spark, d):
    folder = landing.new_folder(spark, "snapshot")
    listing = views.listing(spark, d).withColumn("updated", F.col("updated").cast("timestamp"))
    publish.write_order_metadata(listing.drop("zip_name"), folder, F.lit("2024-06-01").cast("timestamp"))
    orders, files = readers.read_landed_metadata(spark, folder)
    dated = files.groupBy("order_id").agg(F.count("updated").alias("dated"))
    return orders.join(dated, "order_id").select("order_id", "file_count", "total_size", stamp("download_date"), "dated")


@query(
    "K11_package_labels",
    sql("SELECT order_id, CASE WHEN k % 4 = 0 THEN 'renamed ' || k ELSE 'package ' || k END AS package_name FROM (SELECT order_id, CAST(substr(order_id, 2) AS INT) AS k FROM every_folder)", "every_folder"),
)
def k11(spark, d):
    store = EntryLog(spark, landing.new_folder(spark, "labels"), publish.LABEL_SCHEMA, ["order_id"])
    number = F.expr("substring(order_id, 2)")
    named = views.folders(spark, d, every=True).select("order_id", F.concat(F.lit("package "), number).alias("package_name"))
    store.upsert(named)
    again = named.filter(number.cast("int") % 4 == 0).withColumn("package_name", F.concat(F.lit("renamed "), number))
    store.upsert(again)
    return store.read()


# --- SQL functions -----------------------------------------------------------------------


@query(
    "SQL_functions",
    sql(
        """SELECT fid, 'POLYGON((' || xmin || ' ' || ymin || ', ' || xmax || ' ' || ymin || ', ' || xmax || ' ' || ymax || ', ' || xmin || ' ' || ymax
                  || ', ' || xmin || ' ' || ymin || '))' AS wkt, xmax - xmin AS width,
                  xmin <= 600000 AND xmax >= 400000 AND ymin <= 7000000 AND ymax >= 6500000 AS meets, true AS same, true AS back,
                  cx > 400000 AS east
           FROM box_layer""",
        "box_layer",
    ),
)
def sql_functions(spark, d):
    register_functions(spark)
    views.box_layer(spark, d).createOrReplaceTempView("boxes")
    return spark.sql(
        """SELECT fid, geo_astext(geom) AS wkt, geo_xmax(geom) - geo_xmin(geom) AS width,
                  geo_intersects_box(geom, 400000, 6500000, 600000, 7000000) AS meets,
                  geo_parts(geo_aswkb(geom)) = geom AS same,
                  abs(geo_xmin(geo_transform(geo_transform(geom, 3006, 4326), 4326, 3006)) - xmin) < 0.001 AS back,
                  (geo_xmin(geom) + geo_xmax(geom)) / 2 > 400000 AS east
           FROM boxes"""
    )



# --- publishing that loses nothing ---------------------------------------------------------


def _with_broken(spark, d) -> publish.Publisher:
    """The landed archives of customers, and beside those of ``o1`` one that is cut short."""
    publisher = _publisher(spark, d)
    landing.put(f"{publisher.root}/o1/cut.zip", b"PK\x03\x04 cut short")
    return publisher


@query(
    "K5_broken_archive",
    f"""SELECT order_id, layer_name, CASE WHEN order_id = 'o1' THEN 0 ELSE feature_count END AS feature_count,
               CASE WHEN order_id = 'o1' THEN 'failed' ELSE 'ok' END AS status
        FROM (SELECT order_id, table_name AS layer_name, feature_count FROM ({PER_ORDER}))
        UNION ALL SELECT 'o1', 'cut', 0, 'failed'""",
)
def k5b(spark, d):
    """An archive that cannot be read is reported, and nothing of its order is published."""
    return _with_broken(spark, d).publish_orders().select("order_id", "layer_name", "feature_count", "status")


@query(
    "A14_refused_orders",
    f"SELECT order_id, CAST(NULL AS VARCHAR) AS layer_name, order_id || ': no such order' AS error_text FROM (SELECT 'gone' || (c_custkey % 4) AS order_id FROM customer GROUP BY 1)",
)
def a14b(spark, d):
    publisher = _publisher(spark, d)
    report = publisher.publish_orders([f"gone{k}" for k in range(landing.ORDERS)])
    return deliveries.run_errors(report)


@query(
    "K5_two_orders_append",
    f"SELECT _source_order, count(*) AS features, min(fid) >= 1 AND max(fid) <= (SELECT count(*) FROM customer) AS in_range FROM (SELECT 'o' || (c_custkey % 4) AS _source_order, c_custkey, row_number() OVER () AS fid FROM customer) GROUP BY 1",
)
def k5c(spark, d):
    """Layers of several orders in one table."""
    publisher = _publisher(spark, d)
    publisher.publish_orders(table_name="all_points", if_exists="append")
    rows = feed_readers.layer(spark, "all_points", publisher.database)
    within = (F.min("fid") >= 1) & (F.max("fid") <= rows.count())
    return rows.groupBy("_source_order").agg(F.count_distinct("fid").alias("features"), within.alias("in_range"))


@query(
    "K1_append_count",
    "SELECT k AS turn, count(*) AS feature_count FROM (SELECT c_custkey % 3 AS k FROM customer) GROUP BY k",
)
def k1b(spark, d):
    """An append reports what it loaded, not what the table holds by then."""
    name = _database(spark)
    source = views.point_layer(spark, d).withColumnRenamed("fid", "source_fid").select("source_fid", "geom", "c_name")
    counted = None
    for turn in range(3):
        part = source.filter(F.col("source_fid") % 3 == turn)
        mode = "append" if turn else "fail"
        stats = publish.publish_layer(part, "points", name, crs.SWEREF, ["source_fid"], if_exists=mode, target_srid=crs.SWEREF)
        one = stats.select(F.lit(turn).alias("turn"), "feature_count")
        counted = one if counted is None else counted.unionByName(one)
        counted = spark.createDataFrame(counted.collect(), "turn int, feature_count bigint")  # the table changes meanwhile
    return counted


@query(
    "S3_attribute_names",
    sql("SELECT fid, fid * 7 AS srid_attr, -x AS xmin_attr, c_name AS order_id_attr, c_name AS a_b, c_mktsegment AS a_b_2, 3006 AS srid FROM point_layer", "point_layer"),
)
def s3b(spark, d):
    """Attributes named like storage columns, or alike once cleaned, keep their values."""
    root, location = landing.land_odd_names(spark, d), landing.new_folder(spark, "store")
    name = "geo_" + location.rsplit("-", 1)[1]
    publisher = publish.Publisher(spark, root, name, target_srid=crs.SWEREF, location=location)
    publisher.publish_orders(table_name="odd", if_exists="append")
    rows = feed_readers.layer(spark, "odd", name)
    return rows.select(F.col("cell_attr").alias("fid"), "srid_attr", "xmin_attr", "order_id_attr", "a_b", "a_b_2", "srid")


@query("F18_file_hash", "SELECT 'o' || (c_custkey % 4) AS order_id, 'names_' || (c_custkey // 10000) || '.txt' AS file_name, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS source_hash FROM customer GROUP BY 1, 2")
def f18b(spark, d):
    """SHA-256 of the bytes of landed files."""
    found = archives.file_hashes(readers.scan_orders(spark, landing.land_names(spark, d)))
    return found.select("order_id", "file_name", "source_hash")


@query(
    "A16_published_profile",
    """SELECT 'points' AS table_name, 'fid:bigint, source_fid:bigint, c_name:string, _source_order:string, _loaded_at:timestamp' AS columns,
              'Point' AS geometry_type, 4326 AS srid, count(*) AS row_count FROM customer""",
)
def a16p(spark, d):
    """The catalogue of published layers, from what was noted when they were published."""
    return layers.published_profile(spark, _published_in(spark, d, crs.WGS84))
