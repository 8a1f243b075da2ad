"""Ledger, delivery and tile queries, registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from ..operators import deliveries, layers, ledger, tiles
from . import views
from .layer_queries import STAMP, stamp
from .registry import query
from .view_sql import projected, sql

LOADED = STAMP.format("loaded_at")


# --- ledger ------------------------------------------------------------------------


@query(
    "J1_published_layers",
    sql(
        "SELECT c.order_id, c.layer_name, l.order_id IS NOT NULL AS is_published FROM candidates c"
        " LEFT JOIN ledger l ON l.order_id = c.order_id AND l.layer_name = c.layer_name",
        "candidates",
    ),
)
def j1(spark, d):
    return ledger.published_flags(views.candidates(spark, d), views.ledger(spark, d)).select(
        "order_id", "layer_name", "is_published"
    )


@query(
    "J8_stale_ledger",
    sql("SELECT order_id, layer_name, table_name FROM ledger WHERE order_id NOT IN (SELECT order_id FROM folders)", "ledger", "folders"),
)
def j8(spark, d):
    return ledger.stale(views.ledger(spark, d), views.folders(spark, d)).select("order_id", "layer_name", "table_name")


@query(
    "J9_layers_due",
    sql(
        "SELECT order_id, layer_name, source_hash FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM ledger l"
        " WHERE l.order_id = c.order_id AND l.layer_name = c.layer_name AND l.source_hash = c.source_hash)",
        "candidates",
    ),
)
def j9(spark, d):
    return ledger.due(views.candidates(spark, d), views.ledger(spark, d)).select("order_id", "layer_name", "source_hash")


@query(
    "J9_layers_unknown",
    sql(
        "SELECT order_id, layer_name FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM ledger l"
        " WHERE l.order_id = c.order_id AND l.layer_name = c.layer_name)",
        "candidates",
    ),
)
def j9b(spark, d):
    return ledger.due(views.candidates(spark, d), views.ledger(spark, d), by_hash=False).select("order_id", "layer_name")


@query(
    "A6_status",
    sql(
        f"SELECT count(DISTINCT order_id) AS orders_processed, count(DISTINCT table_name) AS total_tables,"
        f" CAST(sum(feature_count) AS BIGINT) AS total_features, {STAMP.format('max(loaded_at)')} AS last_processed FROM ledger",
        "ledger",
    ),
)
def a6(spark, d):
    return ledger.status(views.ledger(spark, d)).withColumn("last_processed", stamp("last_processed"))


@query(
    "A7_order_totals",
    sql(
        "SELECT order_id, count(*) AS layers, CAST(sum(feature_count) AS BIGINT) AS total_features FROM ledger"
        " GROUP BY ROLLUP (order_id)",
        "ledger",
    ),
)
def a7(spark, d):
    return ledger.order_totals(views.ledger(spark, d))


@query(
    "A7_order_layers",
    sql(
        "SELECT order_id, layer_name, feature_count, count(*) OVER (PARTITION BY order_id) AS layers,"
        " CAST(sum(feature_count) OVER (PARTITION BY order_id) AS BIGINT) AS total_features FROM ledger",
        "ledger",
    ),
)
def a7b(spark, d):
    return ledger.order_layers(views.ledger(spark, d))


@query("A9_layer_names", sql("SELECT DISTINCT order_id, layer_name FROM every_candidate ORDER BY 1, 2", "every_candidate"))
def a9(spark, d):
    return ledger.layer_names(views.all_candidates(spark, d)).orderBy("order_id", "layer_name")


@query(
    "O4_ledger_listing",
    sql(
        f"SELECT order_id, source_file, source_hash, table_name, layer_name, feature_count, {LOADED} AS loaded_at"
        " FROM ledger ORDER BY order_id, layer_name",
        "ledger",
    ),
)
def o4(spark, d):
    return ledger.listing(views.ledger(spark, d)).withColumn("loaded_at", stamp("loaded_at"))


@query(
    "O4_order_listing",
    sql(
        f"SELECT order_id, source_file, source_hash, table_name, layer_name, feature_count, {LOADED} AS loaded_at"
        " FROM ledger WHERE order_id = 'o17' ORDER BY layer_name",
        "ledger",
    ),
)
def o4b(spark, d):
    return ledger.listing(views.ledger(spark, d), "o17").withColumn("loaded_at", stamp("loaded_at"))


@query(
    "P7_selected_layers",
    sql("SELECT order_id, layer_name, feature_count FROM ledger WHERE layer_name IN ('af', 'no')", "ledger"),
)
def p7(spark, d):
    return layers.only_layers(views.ledger(spark, d), ["af", "no"]).select("order_id", "layer_name", "feature_count")


@query(
    "P9_public_layers",
    sql("SELECT order_id, layer_name FROM ledger WHERE order_id NOT LIKE 'o1%'", "ledger"),
)
def p9(spark, d):
    hidden = F.when(F.col("order_id").startswith("o1"), F.concat(F.lit("_"), "layer_name")).otherwise(F.col("layer_name"))
    named = views.ledger(spark, d).withColumn("table_name", hidden)
    return layers.public_only(named).select("order_id", "layer_name")


@query(
    "U2_layer_name_union",
    sql("SELECT order_id, layer_name FROM every_candidate UNION SELECT order_id, layer_name FROM ledger", "every_candidate"),
)
def u2(spark, d):
    return ledger.layer_names(views.all_candidates(spark, d), views.ledger(spark, d))


@query(
    "U3_missing_orders",
    sql("SELECT order_id FROM ledger EXCEPT SELECT order_id FROM folders", "ledger", "folders"),
)
def u3(spark, d):
    return ledger.missing_orders(views.ledger(spark, d), views.folders(spark, d))


@query(
    "U4_existing_layers",
    sql("SELECT layer_name FROM every_candidate INTERSECT SELECT layer_name FROM ledger", "every_candidate"),
)
def u4(spark, d):
    return ledger.existing_layers(views.all_candidates(spark, d), views.ledger(spark, d))


# --- delivery files ------------------------------------------------------------------


OBJECTS = "SELECT order_id, filename, sum(objects) AS objects, string_agg('t' || table_no || ': ' || format('{:,}', objects), ', ' ORDER BY table_no) AS shown FROM statistics GROUP BY ALL"


@query(
    "A11_objects_per_file",
    sql(
        """SELECT o.order_id, o.filename, CAST(coalesce(s.objects, 0) AS BIGINT) AS objects, coalesce(s.shown, '-') AS objects_text
           FROM (SELECT DISTINCT 'o' || (l_orderkey % 200) AS order_id, 'f' || l_partkey || '.gpkg' AS filename
                 FROM lineitem) o
           LEFT JOIN (""" + OBJECTS.replace("FROM statistics", "FROM every_statistic") + """) s USING (order_id, filename)""",
        "every_statistic",
    ),
)
def a11(spark, d):
    stats = F.col("statistics")
    return views.statistics(spark, d, every=True).select(
        "order_id",
        "filename",
        deliveries.object_count(stats).alias("objects"),
        deliveries.object_text(stats).alias("objects_text"),
    )


@query(
    "J4_files_with_statistics",
    sql(
        "SELECT l.order_id, l.title, l.length, CAST(coalesce(s.objects, 0) AS BIGINT) AS objects,"
        " coalesce(s.shown, '-') AS objects_text FROM listing l LEFT JOIN (" + OBJECTS + ") s"
        " ON s.order_id = l.order_id AND s.filename = l.title",
        "listing",
        "statistics",
    ),
)
def j4(spark, d):
    joined = deliveries.with_statistics(views.listing(spark, d), views.statistics(spark, d))
    return joined.select("order_id", "title", "length", "objects", "objects_text")


@query(
    "A10_delivery_totals",
    sql(
        "SELECT l.order_id, count(*) AS files, CAST(sum(l.length) AS BIGINT) AS bytes,"
        " CAST(sum(coalesce(s.objects, 0)) AS BIGINT) AS objects FROM listing l LEFT JOIN (" + OBJECTS + ") s"
        " ON s.order_id = l.order_id AND s.filename = l.title GROUP BY ROLLUP (l.order_id)",
        "listing",
        "statistics",
    ),
)
def a10(spark, d):
    joined = deliveries.with_statistics(views.listing(spark, d), views.statistics(spark, d))
    return deliveries.delivery_totals(joined)


TYPES = """
    , m AS (SELECT order_id, zip_name, title, CASE regexp_extract(title, '\\.[^.]*$') WHEN '.gpkg' THEN 'vector_gpkg'
              WHEN '.laz' THEN 'lidar_laz' WHEN '.tif' THEN 'raster_dem' WHEN '.jp2' THEN 'raster_ortho' END AS kind FROM listing),
    h AS (SELECT order_id, CASE WHEN datatyp IS NOT NULL THEN 'raster_dem' WHEN produkttyp LIKE 'Orto%' THEN 'raster_ortho'
              WHEN produkttyp LIKE 'Topo%' THEN 'vector_gpkg' WHEN produkttyp LIKE 'Laser%' THEN 'lidar_laz' END AS hint FROM hints),
    c AS (SELECT m.order_id, CASE WHEN kind = 'raster_dem' AND hint = 'raster_ortho' THEN 'raster_ortho' ELSE kind END AS kind,
              count(*) AS n, min(zip_name || '/' || title) AS first
          FROM m LEFT JOIN h ON h.order_id = m.order_id WHERE kind IS NOT NULL GROUP BY ALL),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC, first) = 1),
    o AS (SELECT order_id FROM m UNION SELECT order_id FROM h),
    t AS (SELECT o.order_id, coalesce(b.kind, h.hint, 'unknown') AS data_type, coalesce(b.n, 0) AS files_of_type
          FROM o LEFT JOIN b ON b.order_id = o.order_id LEFT JOIN h ON h.order_id = o.order_id)"""
LABELS = """CASE data_type WHEN 'vector_gpkg' THEN 'Vector (GeoPackage)' WHEN 'lidar_laz' THEN 'LiDAR (LAZ)'
    WHEN 'lidar_index' THEN 'LiDAR (On-Demand)' WHEN 'raster_dem' THEN 'Raster (DEM)'
    WHEN 'raster_ortho' THEN 'Raster (Orthophoto)' ELSE 'Unknown' END AS data_type_label"""


def _types(spark, d, hints=None):
    members = views.listing(spark, d).select(
        "order_id", "zip_name", F.col("title").alias("entry"), text.extension(F.col("title")).alias("extension")
    )
    return deliveries.dominant_type(members, views.hints(spark, d) if hints is None else hints)


@query(
    "A8_dominant_type",
    sql("", "listing", "hints") + TYPES + f" SELECT order_id, data_type, {LABELS}, data_type = 'vector_gpkg' AS is_publishable, files_of_type FROM t",
)
def a8(spark, d):
    return _types(spark, d)


@query(
    "A8_repeated_hints",
    sql("", "listing", "hints") + TYPES + " SELECT order_id, data_type, files_of_type FROM t",
)
def a8r(spark, d):
    """Several metadata files of an order count no file twice."""
    hints = views.hints(spark, d)
    twice = hints.unionByName(hints).unionByName(hints.withColumn("produkttyp", F.lit(None).cast("string")).withColumn("datatyp", F.lit(None).cast("string")))
    return _types(spark, d, twice).select("order_id", "data_type", "files_of_type")


@query(
    "W3_type_rank",
    sql("", "listing", "hints") + TYPES + " SELECT order_id, data_type FROM t WHERE files_of_type > 0",
)
def w3(spark, d):
    return _types(spark, d).filter("files_of_type > 0").select("order_id", "data_type")


@query("P13_publishable_orders", sql("", "listing", "hints") + TYPES + " SELECT order_id FROM t WHERE data_type = 'vector_gpkg'")
def p13(spark, d):
    return deliveries.publishable(_types(spark, d)).select("order_id")


@query(
    "A8_index_orders_first",
    sql("", "listing", "hints", "laz_tiles") + TYPES + f"""
    , i AS (SELECT order_id, count(*) AS tiles FROM laz_tiles GROUP BY 1),
    r AS (SELECT coalesce(t.order_id, i.order_id) AS order_id, coalesce(i.tiles, 0) AS tiles,
                 CASE WHEN i.tiles > 0 THEN 'lidar_index' ELSE coalesce(t.data_type, 'unknown') END AS data_type
          FROM t FULL JOIN i ON i.order_id = t.order_id)
    SELECT order_id, data_type, {LABELS}, data_type = 'vector_gpkg' AS is_publishable, tiles FROM r""",
)
def a8b(spark, d):
    return deliveries.index_first(_types(spark, d), tiles.parsed(views.tiles(spark, d)))


@query(
    "J1_order_overview",
    sql("", "listing", "hints", "ledger", "laz_tiles", "every_folder") + TYPES + f"""
    , i AS (SELECT order_id, count(*) AS n, sum(size) AS bytes FROM laz_tiles GROUP BY 1),
    r AS (SELECT coalesce(t.order_id, i.order_id) AS order_id, CASE WHEN i.n > 0 THEN 'lidar_index' ELSE coalesce(t.data_type, 'unknown') END AS data_type
          FROM t FULL JOIN i ON i.order_id = t.order_id),
    f0 AS (SELECT order_id, count(*) AS n, sum(length) AS bytes FROM listing GROUP BY 1),
    s AS (SELECT coalesce(f0.order_id, i.order_id) AS order_id, coalesce(i.n, f0.n) AS n, CASE WHEN i.n IS NULL THEN f0.bytes ELSE i.bytes END AS bytes
          FROM f0 FULL JOIN i ON i.order_id = f0.order_id)
    SELECT t.order_id, data_type, {LABELS}, data_type = 'vector_gpkg' AS is_publishable, coalesce(s.n, 0) AS file_count,
           round_even(coalesce(s.bytes, 0) / 1048576.0e0, 2) AS total_size_mb, coalesce(l.n, 0) AS published_layers,
           l.n IS NOT NULL AS is_published,
           CASE WHEN f.order_id IS NOT NULL AND CAST(substr(t.order_id, 2) AS INT) % 3 = 0 THEN 'package ' || t.order_id ELSE '' END AS package_name
    FROM r t LEFT JOIN s ON s.order_id = t.order_id
    LEFT JOIN (SELECT order_id, count(*) AS n FROM ledger GROUP BY 1) l ON l.order_id = t.order_id
    LEFT JOIN every_folder f ON f.order_id = t.order_id ORDER BY t.order_id""",
)
def j1b(spark, d):
    labels = views.folders(spark, d, every=True).filter("cast(substring(order_id, 2) AS int) % 3 = 0")
    named = labels.select("order_id", F.concat(F.lit("package "), "order_id").alias("package_name"))
    indexed = tiles.parsed(views.tiles(spark, d))
    types = deliveries.index_first(_types(spark, d), indexed)
    return deliveries.order_overview(types, views.listing(spark, d), views.ledger(spark, d), named, indexed)


BOUNDS = """
    , box AS (SELECT order_id, min(e) AS e0, min(n) AS n0, max(e) + 1000 AS e1, max(n) + 2000 AS n1 FROM outlines
              WHERE kind = 'Polygon' GROUP BY 1),
    sw AS (SELECT * FROM %s), ne AS (SELECT * FROM %s)
    SELECT box.order_id, round(CASE WHEN good THEN sw.lat ELSE 55.3 END, 6) AS south, round(CASE WHEN good THEN sw.lon ELSE 10.9 END, 6) AS west,
           round(CASE WHEN good THEN ne.lat ELSE 69.1 END, 6) AS north, round(CASE WHEN good THEN ne.lon ELSE 24.2 END, 6) AS east
    FROM (SELECT *, e0 > 100000 AND e1 < 1100000 AND n0 > 6000000 AND n1 < 7800000 AS good FROM box) box
    JOIN sw USING (order_id) JOIN ne USING (order_id)""" % (
    projected("SELECT order_id, e0 AS e, n0 AS n FROM box"),
    projected("SELECT order_id, e1 AS e, n1 AS n FROM box"),
)


@query("A5_delivery_bounds", sql("", "outlines") + BOUNDS)
def a5(spark, d):
    bounds = deliveries.delivery_bounds(views.outlines(spark, d))
    return bounds.select("order_id", *[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


@query(
    "J10_local_status",
    sql(
        "SELECT l.order_id, l.title, CASE WHEN f.title IS NULL THEN 'Missing' ELSE 'OK' END AS status FROM listing l"
        " LEFT JOIN local_files f ON f.order_id = l.order_id AND f.title = l.title",
        "listing",
        "local_files",
    ),
)
def j10(spark, d):
    status = deliveries.local_status(views.listing(spark, d), views.local_files(spark, d))
    return status.select("order_id", "title", "status")


PLAN = """
    , plan AS (SELECT l.order_id, l.title, l.length,
        CASE WHEN f.title IS NULL THEN 'fetch' WHEN l.updated IS NULL THEN 'skip'
             WHEN l.updated <= o.download_date THEN 'skip' ELSE 'fetch' END AS action
        FROM listing l LEFT JOIN local_files f ON f.order_id = l.order_id AND f.title = l.title
        LEFT JOIN folders o ON o.order_id = l.order_id)"""


def _plan(spark, d):
    return deliveries.transfer_plan(views.listing(spark, d), views.local_files(spark, d), views.folders(spark, d))


@query("J7_transfer_plan", sql("", "listing", "local_files", "folders") + PLAN + " SELECT * FROM plan")
def j7(spark, d):
    return _plan(spark, d).select("order_id", "title", "length", "action")


@query(
    "A15_transfer_summary",
    sql("", "listing", "local_files", "folders") + PLAN
    + " SELECT count(*) FILTER (action = 'fetch') AS to_fetch, count(*) FILTER (action = 'skip') AS skipped,"
    " CAST(sum(length) FILTER (action = 'fetch') AS BIGINT) AS fetch_bytes FROM plan",
)
def a15(spark, d):
    return deliveries.transfer_summary(_plan(spark, d))


@query(
    "A13_update_check",
    sql("", "listing", "folders") + f"""
    , r AS (SELECT order_id, max(updated) AS remote FROM listing GROUP BY 1),
    n AS (SELECT order_id, count(*) AS newer FROM listing JOIN folders USING (order_id) WHERE updated > download_date GROUP BY 1)
    SELECT order_id, {STAMP.format('download_date')} AS local_date,
           CASE WHEN download_date IS NOT NULL THEN {STAMP.format('remote')} END AS remote_date,
           download_date IS NULL OR coalesce(remote > download_date, false) AS has_update, coalesce(newer, 0) AS newer_files,
           CASE WHEN download_date IS NULL THEN 'All files (no local download)' END AS note
    FROM r FULL JOIN folders USING (order_id) LEFT JOIN n USING (order_id)""",
)
def a13(spark, d):
    check = deliveries.update_check(views.listing(spark, d), views.folders(spark, d))
    return check.withColumns({"local_date": stamp("local_date"), "remote_date": stamp("remote_date")})


@query(
    "A13_newer_files",
    sql(f"SELECT order_id, title, {STAMP.format('updated')} AS updated FROM listing JOIN folders USING (order_id) WHERE updated > download_date", "listing", "folders"),
)
def a13b(spark, d):
    newer = deliveries.newer_files(views.listing(spark, d), views.folders(spark, d))
    return newer.select("order_id", "title", stamp("updated"))


RUN = """
    , run AS (SELECT order_id, layer_name, feature_count,
         CASE CAST(substr(order_id, 2) AS INT) % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status FROM ledger)"""


def _report(spark, d):
    number = F.expr("cast(substring(order_id, 2) AS int) % 6")
    status = F.when(number == 0, "failed").when(number == 1, "skipped").otherwise("ok")
    error = F.when(number == 0, F.concat(F.lit("no layer "), "layer_name"))
    return views.ledger(spark, d).withColumns({"status": status, "error": error})


@query(
    "A14_run_summary",
    sql("", "ledger") + RUN + """
    SELECT order_id, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
           count(*) FILTER (status <> 'skipped') AS total, count(*) FILTER (status = 'skipped') AS skipped,
           CAST(coalesce(sum(feature_count) FILTER (status = 'ok'), 0) AS BIGINT) AS total_features,
           count(*) FILTER (status = 'failed') = 0 AS all_success,
           CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'Failed layers (' || count(*) FILTER (status = 'failed') || ')' END AS error
    FROM run GROUP BY order_id""",
)
def a14(spark, d):
    return deliveries.run_summary(_report(spark, d), ["order_id"])


@query(
    "A14_run_errors",
    sql("", "ledger") + RUN + " SELECT order_id, layer_name, layer_name || ': no layer ' || layer_name AS error_text FROM run WHERE status = 'failed'",
)
def a14b(spark, d):
    return deliveries.run_errors(_report(spark, d))


# --- names, sizes, times ---------------------------------------------------------------


@query(
    "F11_table_name",
    "SELECT DISTINCT p_type, CASE WHEN clean SIMILAR TO '[0-9].*' THEN '_' || clean ELSE clean END AS table_name"
    " FROM (SELECT p_type, regexp_replace(lower(p_type || '-' || p_size), '[^a-z0-9_]', '_', 'g') AS clean FROM part"
    " UNION ALL SELECT p_name, regexp_replace(lower(p_size || p_name), '[^a-z0-9_]', '_', 'g') FROM part)",
)
def f11(spark, d):
    part = views.table(spark, d, "part")
    named = part.selectExpr("p_type", "concat(p_type, '-', p_size) AS layer").unionByName(
        part.selectExpr("p_name AS p_type", "concat(p_size, p_name) AS layer")
    )
    return named.select("p_type", text.table_name(F.col("layer")).alias("table_name")).distinct()


@query(
    "F12_layer_name",
    "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'b' || p_size WHEN 1 THEN 'b' || p_size || '_sverige' ELSE 'b' || p_size END AS layer_name, p_size FROM part",
)
def f12(spark, d):
    # some names end in one of the nation-wide endings, some in both
    ending = "element_at(array('', '_sverige_sweden', '_sweden'), p_size % 3 + 1)"
    part = views.table(spark, d, "part").selectExpr("p_size", f"concat('data/x.y/b', p_size, {ending}, '.gpkg') AS path")
    return part.select(text.layer_name(F.col("path")).alias("layer_name"), "p_size").distinct()


@query(
    "F13_file_types",
    sql(
        f"""SELECT ext AS extension, data_type, {LABELS}, coalesce(data_type = 'vector_gpkg', false) AS publishable, count(*) AS files
            FROM (SELECT regexp_extract(title, '\\.[^.]*$') AS ext, CASE regexp_extract(title, '\\.[^.]*$') WHEN '.gpkg' THEN 'vector_gpkg'
              WHEN '.laz' THEN 'lidar_laz' WHEN '.tif' THEN 'raster_dem' WHEN '.jp2' THEN 'raster_ortho' END AS data_type FROM listing)
            GROUP BY ALL""",
        "listing",
    ),
)
def f13(spark, d):
    ext = views.listing(spark, d).select(text.extension(F.upper("title")).alias("extension"))
    kind = text.data_type(F.col("extension"))
    counted = ext.groupBy("extension").agg(F.count(F.lit(1)).alias("files"))
    return counted.select(
        "extension",
        kind.alias("data_type"),
        text.type_label(kind).alias("data_type_label"),
        F.coalesce(text.is_publishable(kind), F.lit(False)).alias("publishable"),
        "files",
    )


@query(
    "F14_product_hint",
    sql(
        """SELECT order_id, CASE WHEN datatyp IS NOT NULL THEN 'raster_dem' WHEN produkttyp LIKE 'Orto%' THEN 'raster_ortho'
           WHEN produkttyp LIKE 'Topo%' THEN 'vector_gpkg' WHEN produkttyp LIKE 'Laser%' THEN 'lidar_laz' END AS hint FROM every_hint""",
        "every_hint",
    ),
)
def f14(spark, d):
    return views.hints(spark, d, every=True).select(
        "order_id", text.product_hint([F.col(k) for k in text.HINT_KEYS]).alias("hint")
    )


SIZES = (1, 300, 20000, 90000000)


@query(
    "F15_size_text",
    " UNION ALL ".join(
        f"""SELECT p_partkey, {k} AS scale, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN format('{{:.1f}} KB', s / 1024.0e0)
            WHEN s < 1073741824 THEN format('{{:.1f}} MB', s / 1048576.0e0) ELSE format('{{:.2f}} GB', s / 1073741824.0e0) END AS size_text,
            CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN regexp_replace(format('{{:.1f}}', round(s / 1024.0e0, 1)), '\\.0$', '') || ' KB'
            WHEN s < 1073741824 THEN regexp_replace(format('{{:.1f}}', round(s / 1048576.0e0, 1)), '\\.0$', '') || ' MB'
            ELSE regexp_replace(format('{{:.1f}}', round(s / 1073741824.0e0, 1)), '\\.0$', '') || ' GB' END AS short_text
            FROM (SELECT p_partkey, p_partkey * {k} + p_partkey % 7 AS s FROM part)"""
        for k in SIZES
    ),
)
def f15(spark, d):
    scales = F.explode(F.array(*[F.lit(k) for k in SIZES])).alias("scale")
    sized = views.table(spark, d, "part").select("p_partkey", scales)
    size = F.col("p_partkey") * F.col("scale") + F.col("p_partkey") % 7
    return sized.select(
        "p_partkey", "scale", text.size_text(size).alias("size_text"), text.size_text_short(size).alias("short_text")
    )


@query("F16_size_mb", sql("SELECT order_id, title, round_even(length / 1048576.0e0, 2) AS size_mb, round_even(length / 1048576.0e0, 1) AS size_mb_1 FROM listing", "listing"))
def f16(spark, d):
    length = F.col("length")
    return views.listing(spark, d).select(
        "order_id", "title", text.size_mb(length).alias("size_mb"), text.size_mb(length, 1).alias("size_mb_1")
    )


@query(
    "F17_iso_instant",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(o_orderdate) - 7200000000
       ELSE epoch_us(o_orderdate) END AS micros FROM orders""",
)
def f17(spark, d):
    # with Z, naive, with an offset of two hours, and no date at all
    written = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    key = F.col("o_orderkey") % 4
    shown = F.concat(written, F.when(key == 0, "Z").when(key == 2, "+02:00").otherwise(""))
    iso = F.when(key == 3, F.lit("no date")).otherwise(shown)
    return views.table(spark, d, "orders").select(
        "o_orderkey", F.unix_micros(text.iso_instant(iso)).alias("micros")
    )


@query("F18_content_hash", "SELECT doc_id, sha256(text) AS source_hash FROM documents")
def f18(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"))


@query(
    "F29_minute_and_grouping",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS shown,"
    " format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) AS grouped FROM orders",
)
def f29(spark, d):
    iso = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return views.table(spark, d, "orders").select(
        "o_orderkey",
        text.minute_text(iso).alias("shown"),
        text.grouped(F.round(F.col("o_totalprice") * 100)).alias("grouped"),
    )


@query(
    "F31_length_fallback",
    sql("SELECT order_id, title, CASE WHEN length % 3 = 0 THEN 0 ELSE length END AS size FROM listing", "listing"),
)
def f31(spark, d):
    own = F.when(F.col("length") % 3 == 1, F.col("length"))
    other = F.when(F.col("length") % 3 == 2, F.col("length"))
    return views.listing(spark, d).select("order_id", "title", text.file_length(own, other).alias("size"))


# --- LiDAR tiles -------------------------------------------------------------------------


def _tiles(spark, d):
    return tiles.with_boxes(tiles.parsed(views.tiles(spark, d)))


@query("F10_tile_titles", sql("SELECT order_id, title, grid_x, grid_y FROM laz_tiles", "laz_tiles"))
def f10(spark, d):
    return tiles.parsed(views.tiles(spark, d)).select("order_id", "title", "grid_x", "grid_y")


@query(
    "F8_tile_boxes",
    sql(
        "SELECT order_id, title, grid_x * 1000 AS xmin, 6000000 + grid_y * 10000 AS ymin, grid_x * 1000 + 2500 AS xmax,"
        " 6000000 + grid_y * 10000 + 2500 AS ymax, round_even(size / 1048576.0e0, 2) AS size_mb FROM laz_tiles",
        "laz_tiles",
    ),
)
def f8(spark, d):
    return _tiles(spark, d).select("order_id", "title", "xmin", "ymin", "xmax", "ymax", "size_mb")


CORNERS = f"""
    , a AS (SELECT * FROM {projected("SELECT k, order_id, title, grid_x * 1000.0e0 AS e, 6000000.0e0 + grid_y * 10000.0e0 AS n FROM laz_tiles")}),
    b AS (SELECT * FROM {projected("SELECT k, grid_x * 1000.0e0 + 2500 AS e, 6000000.0e0 + grid_y * 10000.0e0 + 2500 AS n FROM laz_tiles")})"""


@query(
    "F9_tile_polygons",
    sql("", "laz_tiles") + CORNERS + """
    SELECT a.order_id, a.title, 5 AS vertices, round(a.lon, 6) AS west, round(a.lat, 6) AS south,
           round(b.lon, 6) AS east, round(b.lat, 6) AS north FROM a JOIN b USING (k)""",
)
def f9(spark, d):
    shown = tiles.with_polygons(_tiles(spark, d))
    corner = [F.get(G.vertices("geom"), F.lit(i)) for i in (0, 2)]
    return shown.select(
        "order_id",
        "title",
        F.size(G.vertices("geom")).alias("vertices"),
        F.round(corner[0]["x"], 6).alias("west"),
        F.round(corner[0]["y"], 6).alias("south"),
        F.round(corner[1]["x"], 6).alias("east"),
        F.round(corner[1]["y"], 6).alias("north"),
    )


@query(
    "A12_tile_totals",
    sql(
        "SELECT order_id, count(*) AS tiles, CAST(sum(size) AS BIGINT) AS total_size, round_even(sum(size) / 1048576.0e0, 2) AS total_size_mb"
        " FROM laz_tiles GROUP BY order_id",
        "laz_tiles",
    ),
)
def a12(spark, d):
    return tiles.totals(tiles.parsed(views.tiles(spark, d)))


@query(
    "A19_fit_box",
    sql("", "laz_tiles") + CORNERS + """
    SELECT round(min(a.lon), 6) AS west, round(min(a.lat), 6) AS south, round(max(b.lon), 6) AS east,
           round(max(b.lat), 6) AS north FROM a JOIN b USING (k)""",
)
def a19(spark, d):
    fit = tiles.fit_box(tiles.with_polygons(_tiles(spark, d)))
    return fit.select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


def _downloaded(spark, d):
    return tiles.parsed(views.tiles(spark, d)).filter("k % 3 = 0").select("order_id", "title", "size")


@query(
    "J5_downloaded_tiles",
    sql(
        "SELECT t.order_id, t.title, CASE WHEN f.title IS NULL THEN 0 ELSE 1 END AS downloaded FROM laz_tiles t"
        " LEFT JOIN (SELECT DISTINCT order_id, title FROM laz_tiles WHERE k % 3 = 0) f ON f.order_id = t.order_id AND f.title = t.title",
        "laz_tiles",
    ),
)
def j5(spark, d):
    flagged = tiles.downloaded_flags(tiles.parsed(views.tiles(spark, d)), _downloaded(spark, d))
    return flagged.select("order_id", "title", "downloaded")


@query(
    "J6_converted_tiles",
    sql(
        "SELECT f.order_id, f.title, f.size, c.title IS NOT NULL AS copc_ready, replace(c.title, '.laz', '.copc.laz') AS copc_filename,"
        " round_even(f.size / 1048576.0e0, 1) AS size_mb FROM laz_tiles f"
        " LEFT JOIN (SELECT DISTINCT order_id, title FROM laz_tiles WHERE k % 6 = 0) c ON c.order_id = f.order_id AND c.title = f.title",
        "laz_tiles",
    ),
)
def j6(spark, d):
    converted = (
        tiles.parsed(views.tiles(spark, d))
        .filter("k % 6 = 0")
        .select("order_id", text.converted_name(F.col("title")).alias("copc_name"))
    )
    every = tiles.parsed(views.tiles(spark, d)).select("order_id", "title", "size")
    return tiles.converted_flags(every, converted)


@query(
    "F32_converted_names",
    sql(
        "SELECT title, replace(title, '.laz', '.copc.laz') AS copc_name, replace(title, '.laz', '') AS tile_name, title AS laz_name FROM laz_tiles",
        "laz_tiles",
    ),
)
def f32(spark, d):
    named = tiles.parsed(views.tiles(spark, d)).select("title", text.converted_name(F.col("title")).alias("copc_name"))
    return named.select(
        "title",
        "copc_name",
        text.converted_stem(F.col("copc_name")).alias("tile_name"),
        text.source_tile(F.col("copc_name")).alias("laz_name"),
    )


