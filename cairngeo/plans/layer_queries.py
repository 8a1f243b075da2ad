"""Layer projections, filters, pages, counts, extents and joins, registered."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, text
from ..functions import geometry as G
from ..operators import filters, layers, readonly, spatial
from . import views
from .registry import query
from .view_sql import projected, sql

BOX = (400000.0, 6500000.0, 600000.0, 7000000.0)
DEGREES_BOX = (14.0, 59.0, 17.5, 63.0)
IN_BOX = "x >= 400000 AND x <= 600000 AND y >= 6500000 AND y <= 7000000"
BOX_MEETS = "xmin <= 600000 AND xmax >= 400000 AND ymin <= 7000000 AND ymax >= 6500000"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(
    "P1_properties",
    sql(f"SELECT fid, c_name, c_acctbal, c_mktsegment, _source_order, {STAMP.format('_loaded_at')} AS _loaded_at FROM point_layer", "point_layer"),
)
def p1(spark: SparkSession, d: str) -> DataFrame:
    return layers.properties(views.point_layer(spark, d)).withColumn("_loaded_at", stamp("_loaded_at"))


@query("P1_attributes_only", sql("SELECT c_name, c_acctbal, c_mktsegment FROM point_layer", "point_layer"))
def p1b(spark, d):
    return layers.properties(views.point_layer(spark, d), bookkeeping=False)


@query("P2_bbox_filter", sql(f"SELECT fid, c_name, x, y FROM point_layer WHERE {IN_BOX}", "point_layer"))
def p2(spark, d):
    found = layers.bbox_filter(views.point_layer(spark, d), "400000,6500000,600000,7000000")
    return found.selectExpr("fid", "c_name", "xmin AS x", "ymin AS y")


@query("P2_bbox_filter_boxes", sql(f"SELECT fid, s_name FROM box_layer WHERE {BOX_MEETS}", "box_layer"))
def p2b(spark, d):
    return layers.bbox_filter(views.box_layer(spark, d), BOX).select("fid", "s_name")


# A diamond meets a box when the box, grown by the diamond, holds its centre: the
# larger of the axis distances minus the box, added, is at most the half diagonal.
@query(
    "P3_intersects_box",
    sql(
        """SELECT fid, s_name FROM box_layer
           WHERE greatest(400000 - cx, cx - 600000, 0) + greatest(6500000 - cy, cy - 7000000, 0) <= half""",
        "box_layer",
    ),
)
def p3(spark, d):
    return layers.intersects_box(views.diamond_layer(spark, d), BOX).select("fid", "s_name")


def _corners_sql() -> str:
    west, south, east, north = DEGREES_BOX
    values = ", ".join(f"({i}, {lon}e0, {lat}e0)" for i, (lon, lat) in enumerate([(west, south), (east, south), (east, north), (west, north)]))
    # forward series on the four corners, then the even-odd rule on the quadrilateral
    return f"""
    k AS (SELECT *, (1/298.257222101e0) / (2 - 1/298.257222101e0) AS h, sqrt((1/298.257222101e0)*(2 - 1/298.257222101e0)) AS ec,
                 radians(lat) AS phi, radians(lon - 15.0e0) AS lam FROM (VALUES {values}) AS c(i, lon, lat)),
    k2 AS (SELECT *, sinh(asinh(tan(phi)) - ec * atanh(ec * sin(phi))) AS tau FROM k),
    k3 AS (SELECT *, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau*tau + cos(lam)*cos(lam))) AS et,
                  h/2 - 2*h^2/3 + 5*h^3/16 + 41*h^4/180 AS a1, 13*h^2/48 - 3*h^3/5 + 557*h^4/1440 AS a2,
                  61*h^3/240 - 103*h^4/140 AS a3, 49561*h^4/161280 AS a4,
                  0.9996e0 * 6378137.0e0 / (1 + h) * (1 + h^2/4 + h^4/64) AS rad FROM k2),
    corner AS (SELECT i,
        500000.0e0 + rad * (et + a1*cos(2*xi)*sinh(2*et) + a2*cos(4*xi)*sinh(4*et) + a3*cos(6*xi)*sinh(6*et) + a4*cos(8*xi)*sinh(8*et)) AS e,
        rad * (xi + a1*sin(2*xi)*cosh(2*et) + a2*sin(4*xi)*cosh(4*et) + a3*sin(6*xi)*cosh(6*et) + a4*sin(8*xi)*cosh(8*et)) AS n FROM k3),
    edge AS (SELECT p.e AS x1, p.n AS y1, q.e AS x2, q.n AS y2 FROM corner p JOIN corner q ON q.i = (p.i + 1) % 4)"""


@query(
    "P4_box_in_other_srid",
    sql("SELECT 1", "point_layer").replace("\nSELECT 1", "," + _corners_sql())
    + """
    SELECT fid, c_name FROM point_layer p
    WHERE (SELECT count(*) FROM edge WHERE (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1) % 2 = 1""",
)
def p4(spark, d):
    found = layers.intersects_box_in(views.point_layer(spark, d), DEGREES_BOX, crs.WGS84, crs.SWEREF)
    return found.select("fid", "c_name")


@query(
    "P5_attribute_filters",
    sql(
        "SELECT fid, c_name, c_acctbal FROM point_layer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 100.5"
        " AND c_acctbal < 9000 AND contains(c_name, '1') AND fid > 10 AND fid <= 100000",
        "point_layer",
    ),
)
def p5(spark, d):
    df = views.point_layer(spark, d)
    for field, op, value in (
        ("c_mktsegment", "!=", "BUILDING"),
        ("c_acctbal", ">=", "100.5"),
        ("c_acctbal", "<", "9000"),
        ("c_name", "contains", "1"),
        ("fid", ">", "10"),
        ("fid", "<=", "100000"),
    ):
        df = layers.attr_filter(df, field, op, value)
    return df.select("fid", "c_name", "c_acctbal")


FILTER_GRAPH = {
    "drawflow": {
        "Home": {
            "data": {
                "1": {
                    "name": "OrderNode",
                    "data": {"orderId": "customers"},
                    "inputs": {},
                    "outputs": {"output_1": {"connections": [{"node": "2", "output": "input_1"}]}},
                },
                "2": {
                    "name": "FilterNode",
                    "data": {"field": "c_acctbal", "operator": ">", "value": "0"},
                    "inputs": {"input_1": {"connections": [{"node": "1", "input": "output_1"}]}},
                    "outputs": {"output_1": {"connections": [{"node": "3", "output": "input_1"}]}},
                },
                "3": {
                    "name": "FilterNode",
                    "data": {"field": "c_mktsegment", "operator": "=", "value": "MACHINERY"},
                    "inputs": {"input_1": {"connections": [{"node": "2", "input": "output_1"}]}},
                    "outputs": {"output_1": {"connections": [{"node": "4", "output": "input_1"}]}},
                },
                "4": {
                    "name": "DatabaseNode",
                    "data": {"connectionName": "rich_machinery"},
                    "inputs": {"input_1": {"connections": [{"node": "3", "input": "output_1"}]}},
                    "outputs": {},
                },
            }
        }
    }
}


@query(
    "P6_filter_graph",
    sql("SELECT fid, c_name, c_acctbal FROM point_layer WHERE c_acctbal > 0 AND c_mktsegment = 'MACHINERY'", "point_layer"),
)
def p6(spark, d):
    outputs = filters.compile_graph(json.dumps(FILTER_GRAPH), lambda order_id: views.point_layer(spark, d))
    return outputs["rich_machinery"].select("fid", "c_name", "c_acctbal")


@query("P8_feature_by_fid", sql("SELECT fid, c_name, x, y FROM point_layer WHERE fid = 42", "point_layer"))
def p8(spark, d):
    return layers.feature(views.point_layer(spark, d), 42).selectExpr("fid", "c_name", "xmin AS x", "ymin AS y")


READONLY = (
    "SELECT c_mktsegment, count(*) AS customers, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS cents"
    " FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment"
)


@query("P12_readonly_sql", READONLY)
def p12(spark, d):
    return readonly.readonly_sql(spark, READONLY, {"customer": views.table(spark, d, "customer")}).rows


JOINS = (
    "SELECT n.n_name, count(o.o_orderkey) AS orders, count(DISTINCT c.c_custkey) AS customers"
    " FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey"
    " LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 50000"
    " WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)"
    " AND NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey AND r.r_name = 'ASIA')"
    " GROUP BY n.n_name ORDER BY n.n_name"
)


@query("J13_user_joins", JOINS)
def j13(spark, d):
    names = ("nation", "customer", "orders", "supplier", "region")
    return readonly.readonly_sql(spark, JOINS, {n: views.table(spark, d, n) for n in names}).rows


@query("F26_result_rendering", f"""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
           CASE WHEN o_orderpriority IS NOT NULL THEN '<binary>' END AS priority_bytes FROM orders""")
def f26(spark, d):
    df = views.table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "cast(o_orderpriority AS binary) AS priority_bytes"
    )
    return text.rendered(df)


# --- counts, extents, pages --------------------------------------------------------


@query("A1_match_count", sql(f"SELECT count(*) AS total_count FROM point_layer WHERE {IN_BOX}", "point_layer"))
def a1(spark, d):
    return layers.match_count(layers.bbox_filter(views.point_layer(spark, d), BOX))


EXTENT = "min(xmin) AS minx, min(ymin) AS miny, max(xmax) AS maxx, max(ymax) AS maxy"


@query("A2_extent", sql(f"SELECT {EXTENT} FROM box_layer", "box_layer"))
def a2(spark, d):
    return layers.extent(views.box_layer(spark, d))


@query("A2_extent_empty", sql(f"SELECT {EXTENT} FROM box_layer WHERE fid < 0", "box_layer"))
def a2b(spark, d):
    return layers.extent(views.box_layer(spark, d).filter("fid < 0"))


@query(
    "A3_extent_text",
    sql(
        """SELECT 'POLYGON((' || a || ' ' || b || ', ' || a || ' ' || d || ', ' || c || ' ' || d || ', ' || c || ' ' || b
                  || ', ' || a || ' ' || b || '))' AS bbox
           FROM (SELECT CAST(min(xmin) AS VARCHAR) AS a, CAST(min(ymin) AS VARCHAR) AS b,
                        CAST(max(xmax) AS VARCHAR) AS c, CAST(max(ymax) AS VARCHAR) AS d FROM box_layer)""",
        "box_layer",
    ),
)
def a3(spark, d):
    return layers.extent_text(views.box_layer(spark, d))


@query(
    "A4_source_extent",
    sql(
        """SELECT _source_order AS order_id,
                  CASE WHEN stored THEN 1.0e0 ELSE min(xmin) END AS minx, CASE WHEN stored THEN 2.0e0 ELSE min(ymin) END AS miny,
                  CASE WHEN stored THEN 3.0e0 ELSE max(xmax) END AS maxx, CASE WHEN stored THEN 4.0e0 ELSE max(ymax) END AS maxy
           FROM (SELECT *, CAST(substr(_source_order, 2) AS INT) % 3 = 0 AS stored FROM box_layer)
           GROUP BY _source_order, stored""",
        "box_layer",
    ),
)
def a4(spark, d):
    boxes = views.box_layer(spark, d).withColumn("order_id", F.col("_source_order"))
    known = F.expr("cast(substring(order_id, 2) AS int) % 3 = 0")
    catalogue = boxes.select("order_id").distinct()
    for value, name in enumerate(("min_x", "min_y", "max_x", "max_y"), 1):
        catalogue = catalogue.withColumn(name, F.when(known, F.lit(float(value))))
    return layers.source_extent(catalogue, boxes, ["order_id"])


@query(
    "A16_schema_profile",
    sql(
        """SELECT 'boxes' AS table_name,
                  'fid:bigint, s_name:string, s_acctbal:double, _source_order:string, _loaded_at:timestamp_ntz' AS columns,
                  'Polygon' AS geometry_type, 3006 AS srid, count(*) AS row_count FROM box_layer
           UNION ALL SELECT 'nation', 'n_nationkey:int, n_name:string, n_regionkey:int', NULL, NULL, count(*) FROM nation
           UNION ALL SELECT 'points', 'fid:bigint, c_name:string, c_acctbal:double, c_mktsegment:string, _source_order:string, _loaded_at:timestamp_ntz',
                  'Point', 3006, count(*) FROM point_layer""",
        "box_layer",
        "point_layer",
    ),
)
def a16(spark, d):
    return layers.schema_profile(
        {
            "boxes": views.box_layer(spark, d),
            "nation": views.table(spark, d, "nation"),
            "points": views.point_layer(spark, d),
        }
    )


@query("A17_centroid", sql("SELECT fid, (4 * cx + cx) / 5 AS x, (5 * cy - half) / 5 AS y FROM box_layer", "box_layer"))
def a17(spark, d):
    # a diamond's ring repeats its southern corner, which pulls the mean south
    df = views.diamond_layer(spark, d).withColumn("c", G.centroid("geom"))
    return df.select("fid", "c.x", "c.y")


@query(
    "A20_map_tiles",
    sql("", "point_layer")
    + f"""
    , ll AS (SELECT * FROM {projected("SELECT fid, x AS e, y AS n FROM point_layer")}),
    z AS (SELECT unnest(range(0, 15)) AS z)
    SELECT 'points' AS layer, z, CAST(floor((lon + 180.0e0) / 360.0e0 * 16384.0e0) AS BIGINT) >> (14 - z) AS x,
           CAST(floor((1.0e0 - asinh(tan(radians(lat))) / pi()) / 2.0e0 * 16384.0e0) AS BIGINT) >> (14 - z) AS y,
           count(*) AS features
    FROM ll, z GROUP BY ALL""",
)
def a20(spark, d):
    lon, lat = crs.grid_to_lonlat("xmin", "ymin")
    degrees = views.point_layer(spark, d).select(lon.alias("lon"), lat.alias("lat"))
    boxed = degrees.selectExpr("lon AS xmin", "lat AS ymin", "lon AS xmax", "lat AS ymax")
    return spatial.tile_pyramid(boxed, F.lit("points"))


@query(
    "A20_map_tiles_boxes",
    sql("", "box_layer")
    + f"""
    , sw AS (SELECT * FROM {projected("SELECT fid, xmin AS e, ymin AS n FROM box_layer")}),
    ne AS (SELECT * FROM {projected("SELECT fid, xmax AS e, ymax AS n FROM box_layer")}),
    z AS (SELECT unnest(range(0, 15)) AS z),
    r AS (SELECT z, sw.fid,
             CAST(floor((sw.lon + 180.0e0) / 360.0e0 * (1 << z)) AS BIGINT) AS x0, CAST(floor((ne.lon + 180.0e0) / 360.0e0 * (1 << z)) AS BIGINT) AS x1,
             CAST(floor((1.0e0 - asinh(tan(radians(ne.lat))) / pi()) / 2.0e0 * (1 << z)) AS BIGINT) AS y0,
             CAST(floor((1.0e0 - asinh(tan(radians(sw.lat))) / pi()) / 2.0e0 * (1 << z)) AS BIGINT) AS y1
          FROM sw JOIN ne USING (fid), z),
    rx AS (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r)
    SELECT 'boxes' AS layer, z, x, y, count(*) AS features
    FROM (SELECT z, x, unnest(range(y0, y1 + 1)) AS y FROM rx) GROUP BY ALL""",
)
def a20b(spark, d):
    b = views.box_layer(spark, d)
    west, south = crs.grid_to_lonlat("xmin", "ymin")
    east, north = crs.grid_to_lonlat("xmax", "ymax")
    boxed = b.select(west.alias("xmin"), south.alias("ymin"), east.alias("xmax"), north.alias("ymax"))
    return spatial.tile_pyramid(boxed, F.lit("boxes"))


@query(
    "A21_table_stats",
    sql(
        f"""SELECT 'points' AS table_name, count(*) AS feature_count, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy,
                   arg_min(_source_order, fid) AS source_order, {STAMP.format('arg_min(_loaded_at, fid)')} AS loaded_at,
                   'fid, c_name, c_acctbal, c_mktsegment, _source_order, _loaded_at' AS columns FROM point_layer""",
        "point_layer",
    ),
)
def a21(spark, d):
    return layers.table_stats(views.point_layer(spark, d), "points").withColumn("loaded_at", stamp("loaded_at"))


@query("O1_feature_page", sql(f"SELECT fid, c_name FROM point_layer WHERE {IN_BOX} ORDER BY fid LIMIT 25 OFFSET 10", "point_layer"))
def o1(spark, d):
    return layers.page(layers.bbox_filter(views.point_layer(spark, d), BOX), 25, 10).select("fid", "c_name")


@query("O1_page_after", sql("SELECT fid, c_name FROM point_layer WHERE fid > 40 ORDER BY fid LIMIT 1000", "point_layer"))
def o1b(spark, d):
    return layers.page_after(views.point_layer(spark, d), 40).select("fid", "c_name")


@query("O2_capped", sql("SELECT fid, c_name FROM point_layer ORDER BY fid LIMIT 10000", "point_layer"))
def o2(spark, d):
    return layers.capped(views.point_layer(spark, d), 20000).select("fid", "c_name")


@query("O5_table_sample", "SELECT n_nationkey, n_name, n_regionkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS row_json FROM nation ORDER BY n_nationkey LIMIT 3")
def o5(spark, d):
    return layers.sample(views.table(spark, d, "nation").orderBy("n_nationkey"))


@query("O6_result_preview", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 50) AS text, coalesce(lang, 'NULL') AS lang FROM documents ORDER BY documents.doc_id LIMIT 20")
def o6(spark, d):
    return layers.preview(views.table(spark, d, "documents").orderBy("doc_id").select("doc_id", "text", "lang"))


@query("J11_owning_orders", sql(f"SELECT fid, order_id, {STAMP.format('download_date')} AS download_date FROM point_layer JOIN folders ON _source_order = order_id", "point_layer", "folders"))
def j11(spark, d):
    joined = layers.owning_orders(views.point_layer(spark, d), views.folders(spark, d))
    return joined.select("fid", "order_id", stamp("download_date"))


# --- spatial joins -----------------------------------------------------------------


@query(
    "J12_points_in_boxes",
    sql("SELECT p.fid AS point_fid, b.fid AS box_fid FROM point_layer p JOIN box_layer b ON p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax", "point_layer", "box_layer"),
)
def j12(spark, d):
    pairs = spatial.spatial_join(views.point_layer(spark, d), views.box_layer(spark, d))
    return pairs.selectExpr("left_key AS point_fid", "right_key AS box_fid")


@query(
    "J12_boxes_meet_boxes",
    sql("SELECT a.fid AS a_fid, b.fid AS b_fid FROM box_layer a JOIN box_layer b ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin", "box_layer"),
)
def j12b(spark, d):
    pairs = spatial.spatial_join(views.box_layer(spark, d), views.box_layer(spark, d))
    return pairs.selectExpr("left_key AS a_fid", "right_key AS b_fid")


@query(
    "J12_points_in_diamonds",
    sql("SELECT p.fid AS point_fid, b.fid AS box_fid FROM point_layer p JOIN box_layer b ON abs(p.x - b.cx) + abs(p.y - b.cy) <= b.half", "point_layer", "box_layer"),
)
def j12c(spark, d):
    pairs = spatial.spatial_join(views.point_layer(spark, d), views.diamond_layer(spark, d))
    return pairs.selectExpr("left_key AS point_fid", "right_key AS box_fid")


@query(
    "J12_diamonds_meet_boxes",
    sql("SELECT a.fid AS a_fid, b.fid AS b_fid FROM box_layer a JOIN box_layer b ON greatest(b.xmin - a.cx, a.cx - b.xmax, 0) + greatest(b.ymin - a.cy, a.cy - b.ymax, 0) <= a.half", "box_layer"),
)
def j12d(spark, d):
    pairs = spatial.spatial_join(views.diamond_layer(spark, d), views.box_layer(spark, d))
    return pairs.selectExpr("left_key AS a_fid", "right_key AS b_fid")


SIZED = "SELECT fid, x - half AS xmin, y - half AS ymin, x + half AS xmax, y + half AS ymax FROM (SELECT fid, x, y, pow(2, fid % 18) AS half FROM point_layer) s"


@query(
    "J12_boxes_of_many_sizes",
    sql(f"SELECT b.fid AS box_fid, p.fid AS point_fid FROM ({SIZED}) b JOIN point_layer p ON p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax", "point_layer"),
)
def j12s(spark, d):
    """Boxes of 18 sizes, from 2 to 262,144 metres wide."""
    points = views.point_layer(spark, d)
    half = F.pow(F.lit(2.0), F.col("fid") % 18)
    sized = points.select("fid", F.col("xmin").alias("x"), F.col("ymin").alias("y"), half.alias("half"))
    corners = {"xmin": F.col("x") - F.col("half"), "ymin": F.col("y") - F.col("half"), "xmax": F.col("x") + F.col("half"), "ymax": F.col("y") + F.col("half")}
    boxes = sized.withColumns(corners).withColumn("geom", G.box(*[F.col(c) for c in layers.ENVELOPE]))
    return spatial.spatial_join(boxes, points).selectExpr("left_key AS box_fid", "right_key AS point_fid")


CROWD = "SELECT fid, CASE WHEN fid % 10 < 3 THEN 500000 + fid % 50 ELSE x END AS x, CASE WHEN fid % 10 < 3 THEN 6500000 + fid % 40 ELSE y END AS y FROM point_layer"


@query(
    "J12_crowded_cell",
    sql(f"SELECT p.fid AS point_fid, b.fid AS box_fid FROM ({CROWD}) p JOIN box_layer b ON p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax", "point_layer", "box_layer"),
)
def j12h(spark, d):
    """Three points of ten lie in one cell."""
    points, crowd = views.point_layer(spark, d), F.col("fid") % 10 < 3
    x = F.when(crowd, (500000 + F.col("fid") % 50).cast("double")).otherwise(F.col("xmin"))
    y = F.when(crowd, (6500000 + F.col("fid") % 40).cast("double")).otherwise(F.col("ymin"))
    placed = points.select("fid", x.alias("xmin"), y.alias("ymin")).withColumns({"xmax": F.col("xmin"), "ymax": F.col("ymin")})
    placed = placed.withColumn("geom", G.point(F.col("xmin"), F.col("ymin")))
    return spatial.spatial_join(placed, views.box_layer(spark, d)).selectExpr("left_key AS point_fid", "right_key AS box_fid")


# --- geometry and projection ---------------------------------------------------------


HEADER = "concat(unhex('4750'), unhex('00'), unhex('{flags}'), unhex('BE0B0000'), unhex(repeat('00', {pad})))"


def _blobs(spark, d) -> DataFrame:
    """Diamonds as blobs with each envelope size, and some without a header."""
    wkb = views.diamond_layer(spark, d).select("fid", G.write_wkb(F.col("geom")).alias("wkb"))
    blob = F.col("wkb")
    for envelope, width in G.ENVELOPE_BYTES.items():
        head = F.expr(HEADER.format(flags=f"{envelope * 2 + 1:02X}", pad=width))
        blob = F.when(F.col("fid") % 6 == envelope, F.concat(head, F.col("wkb"))).otherwise(blob)
    return wkb.withColumn("blob", blob)


@query(
    "F1_strip_header",
    sql("SELECT fid, 93 AS wkb_bytes, 93 + CASE fid % 6 WHEN 0 THEN 8 WHEN 1 THEN 40 WHEN 2 THEN 56 WHEN 3 THEN 56 WHEN 4 THEN 72 ELSE 0 END AS blob_bytes, true AS same FROM box_layer", "box_layer"),
)
def f1(spark, d):
    stripped = _blobs(spark, d).withColumn("stripped", G.strip_header(F.col("blob")))
    return stripped.select(
        "fid",
        F.length("stripped").alias("wkb_bytes"),
        F.length("blob").alias("blob_bytes"),
        (F.col("stripped") == F.col("wkb")).alias("same"),
    )


DIAMOND = [("cx", "cy - half"), ("cx + half", "cy"), ("cx", "cy + half"), ("cx - half", "cy"), ("cx", "cy - half")]


def _pairs(left: str, between: str, right: str, join: str) -> str:
    return (" || '" + join + "' || ").join(f"'{left}' || ({x}) || '{between}' || ({y}) || '{right}'" for x, y in DIAMOND)


@query(
    "F2_wkb_to_geojson",
    sql("SELECT fid, '{\"type\":\"Polygon\",\"coordinates\":[[' || " + _pairs("[", ",", "]", ",") + " || ']]}' AS geojson FROM box_layer", "box_layer"),
)
def f2(spark, d):
    parsed = _blobs(spark, d).withColumn("geom", G.parse_wkb(G.strip_header(F.col("blob"))))
    return parsed.select("fid", G.as_geojson("geom").alias("geojson"))


@query("F3_geometry_text", sql("SELECT fid, 'POLYGON((' || " + _pairs("", " ", "", ", ") + " || '))' AS wkt FROM box_layer", "box_layer"))
def f3(spark, d):
    return views.diamond_layer(spark, d).select("fid", G.as_text("geom").alias("wkt"))


@query(
    "F4_vertices",
    sql(" UNION ALL ".join(f"SELECT fid, {i} AS pos, {x} AS x, {y} AS y FROM box_layer" for i, (x, y) in enumerate(DIAMOND)), "box_layer"),
)
def f4(spark, d):
    df = views.diamond_layer(spark, d)
    return df.select("fid", F.posexplode(G.vertices("geom")).alias("pos", "v")).select("fid", "pos", "v.x", "v.y")


@query("F5_envelope", sql("SELECT fid, xmin, ymin, xmax, ymax FROM box_layer", "box_layer"))
def f5(spark, d):
    shapes = views.diamond_layer(spark, d).select("fid", "geom")
    return layers.with_envelope(shapes).drop("geom")


@query(
    "F6_metric_to_degrees",
    f"SELECT fid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {projected('SELECT c_custkey AS fid, CAST(300000 + (c_custkey * 7919) % 500000 AS DOUBLE) AS e, CAST(6200000 + (c_custkey * 104729) % 1300000 AS DOUBLE) AS n FROM customer')}",
)
def f6(spark, d):
    at = crs.sweref_to_wgs84("xmin", "ymin")
    df = views.point_layer(spark, d).select("fid", at.alias("at"))
    return df.select("fid", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"))


@query(
    "F7_transform_geometry",
    f"SELECT fid, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS back FROM {projected('SELECT s_suppkey AS fid, CAST(300000 + (s_suppkey * 7919) % 500000 AS DOUBLE) AS e, CAST(6200000 + (s_suppkey * 104729) % 1300000 - (5000 + (s_suppkey % 7) * 5000) AS DOUBLE) AS n FROM supplier')}",
)
def f7(spark, d):
    # the first vertex of each diamond in degrees, and whether it returns within a millimetre
    there = crs.transform_geometry("geom", crs.SWEREF, crs.WGS84)
    df = views.diamond_layer(spark, d).select("fid", "geom", there.alias("moved"))
    df = df.withColumn("again", crs.transform_geometry("moved", crs.WGS84, crs.SWEREF))
    far = F.zip_with(
        G.vertices("geom"),
        G.vertices("again"),
        lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])),
    )
    first = F.get(G.vertices("moved"), F.lit(0))
    return df.select(
        "fid",
        F.round(first["x"], 6).alias("lon"),
        F.round(first["y"], 6).alias("lat"),
        (F.array_max(far) < 0.001).alias("back"),
    )


@query(
    "F7_output_in_degrees",
    "SELECT fid, 4326 AS srid, round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax FROM "
    + projected(
        """SELECT fid, cx + sx * half AS e, cy + sy * half AS n FROM (SELECT s_suppkey AS fid,
           CAST(300000 + (s_suppkey * 7919) % 500000 AS DOUBLE) AS cx, CAST(6200000 + (s_suppkey * 104729) % 1300000 AS DOUBLE) AS cy,
           CAST(5000 + (s_suppkey % 7) * 5000 AS DOUBLE) AS half FROM supplier), (VALUES (-1, -1), (-1, 1), (1, 1), (1, -1)) AS c(sx, sy)"""
    )
    + " GROUP BY fid",
)
def f7b(spark, d):
    moved = layers.in_system(views.box_layer(spark, d), crs.SWEREF, crs.WGS84)
    return moved.select("fid", "srid", *[F.round(c, 6).alias(c) for c in layers.ENVELOPE])
