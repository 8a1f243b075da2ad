"""Delivery, layer, feed and point tables derived from the generated tables.

Each function has a twin of the same name in ``view_sql`` with the same meaning.
Positions come from whole-number arithmetic, so both engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS fid",
        "c_name",
        "c_acctbal",
        "c_mktsegment",
        "cast(300000 + (c_custkey * 7919) % 500000 AS double) AS x",
        "cast(6200000 + (c_custkey * 104729) % 1300000 AS double) AS y",
        "concat('o', c_custkey % 250) AS _source_order",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey AS int), 0) AS _loaded_at",
    )
    x, y = F.col("x"), F.col("y")
    return base.select(
        "fid",
        "c_name",
        "c_acctbal",
        "c_mktsegment",
        G.point(x, y).alias("geom"),
        F.lit(3006).alias("srid"),
        x.alias("xmin"),
        y.alias("ymin"),
        x.alias("xmax"),
        y.alias("ymax"),
        "_source_order",
        "_loaded_at",
    )


def box_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS fid",
        "s_name",
        "s_acctbal",
        "cast(300000 + (s_suppkey * 7919) % 500000 AS double) AS cx",
        "cast(6200000 + (s_suppkey * 104729) % 1300000 AS double) AS cy",
        "cast(5000 + (s_suppkey % 7) * 5000 AS double) AS half",
        "concat('o', s_suppkey % 250) AS _source_order",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(s_suppkey AS int), 0) AS _loaded_at",
    )
    boxed = base.selectExpr(
        "*", "cx - half AS xmin", "cy - half AS ymin", "cx + half AS xmax", "cy + half AS ymax"
    ).drop("cx", "cy", "half")
    corners = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return boxed.withColumn("geom", G.box(*corners)).withColumn("srid", F.lit(3006))


def diamond_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds around the box centres: half diagonal as the box's half side."""
    b = box_layer(spark, sf_dir)
    mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    shape = G.polygon(
        (mx, F.col("ymin")), (F.col("xmax"), my), (mx, F.col("ymax")), (F.col("xmin"), my)
    )
    return b.withColumn("geom", shape)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "concat('o', l_orderkey % 200) AS order_id",
            "lower(concat(l_returnflag, l_linestatus)) AS layer_name",
            "l_shipdate",
        )
        .groupBy("order_id", "layer_name")
        .agg(F.count(F.lit(1)).alias("feature_count"), F.max("l_shipdate").alias("loaded_at"))
        .selectExpr(
            "order_id",
            "concat(layer_name, '.gpkg') AS source_file",
            "sha2(concat(order_id, layer_name), 256) AS source_hash",
            "layer_name AS table_name",
            "layer_name",
            "feature_count",
            "loaded_at",
        )
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ledger(spark, sf_dir).select("order_id", "layer_name", "source_hash", "feature_count")
    extra = (
        table(spark, sf_dir, "orders")
        .filter("o_orderkey % 250 >= 200")
        .selectExpr("concat('o', o_orderkey % 250) AS order_id", "lower(o_orderstatus) AS layer_name")
        .groupBy("order_id", "layer_name")
        .agg(F.count(F.lit(1)).alias("feature_count"))
        .selectExpr(
            "order_id", "layer_name", "sha2(concat(order_id, layer_name), 256) AS source_hash", "feature_count"
        )
    )
    changed = F.expr("cast(substring(order_id, 2) AS int) % 10 = 3")
    return known.unionByName(extra).withColumn(
        "source_hash", F.when(changed, F.concat(F.lit("x"), "source_hash")).otherwise(F.col("source_hash"))
    )


def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the ledger and of every order in ``orders``."""
    known = ledger(spark, sf_dir).select("order_id", "layer_name")
    every = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey % 250) AS order_id", "lower(o_orderstatus) AS layer_name")
    return known.unionByName(every)


def folders(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Delivered orders; without ``every`` some that the ledger has are missing."""
    return (
        table(spark, sf_dir, "orders")
        .filter(F.lit(every) | F.expr("o_orderkey % 250 >= 20"))
        .selectExpr("concat('o', o_orderkey % 250) AS order_id", "o_orderdate")
        .groupBy("order_id")
        .agg(F.max("o_orderdate").alias("download_date"))
    )


def hints(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Delivery metadata that may name a product."""
    return (
        folders(spark, sf_dir, every)
        .selectExpr("order_id", "cast(substring(order_id, 2) AS int) AS k")
        .selectExpr(
            "order_id",
            "element_at(array('Ortofoto RGB', 'Topografi 10', null, 'Laserdata NH', 'annat'), k % 5 + 1) AS produkttyp",
            "cast(null AS string) AS product_type",
            "CASE WHEN k % 7 = 0 THEN 'HOJDDATA grid' END AS datatyp",
            "cast(null AS string) AS data_type",
        )
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('o', l_orderkey % 200) AS order_id",
        "concat('f', l_partkey, element_at(array('.gpkg', '.laz', '.tif', '.jp2', '.txt'), l_linenumber % 5 + 1)) AS title",
        "cast(round(l_extendedprice * 100) AS bigint) AS length",
        "CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS updated",
        "concat('z', l_orderkey % 7, '.zip') AS zip_name",
    )


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files already delivered: those of parts not divisible by four."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_partkey % 4 <> 0")
        .selectExpr(
            "concat('o', l_orderkey % 200) AS order_id",
            "concat('f', l_partkey, element_at(array('.gpkg', '.laz', '.tif', '.jp2', '.txt'), l_linenumber % 5 + 1)) AS title",
        )
    )


def statistics(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Per-file table statistics, zero to three tables each; without ``every`` many files have none."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.lit(every) | F.expr("l_linenumber % 5 = 0 AND l_partkey % 3 <> 0"))
        .selectExpr("concat('o', l_orderkey % 200) AS order_id", "l_partkey AS k")
        .distinct()
        .selectExpr(
            "order_id",
            "concat('f', k, '.gpkg') AS filename",
            "transform(slice(array(1, 2, 3), 1, cast(k % 4 AS int)), i -> named_struct("
            "'table', concat('t', i), 'objects', (k * i * 37) % 5000)) AS statistics",
        )
    )


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric outline of each delivered file; a fifth are points, one order in twenty is far north."""
    base = table(spark, sf_dir, "part").selectExpr(
        "concat('o', p_partkey % 200) AS order_id",
        "CASE WHEN p_partkey % 5 = 0 THEN 'Point' ELSE 'Polygon' END AS kind",
        "cast(300000 + (p_partkey * 7919) % 500000 AS double) AS e",
        "cast(6200000 + (p_partkey * 104729) % 1300000"
        " + CASE WHEN p_partkey % 20 = 19 THEN 2000000 ELSE 0 END AS double) AS n",
    )
    return base.selectExpr(
        "order_id",
        "named_struct('type', kind, 'coordinates', array(array("
        "array(e, n), array(e + 1000, n), array(e + 1000, n + 2000), array(e, n + 2000), array(e, n)))) AS geometry",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('o', p_partkey % 250) AS order_id",
        "CASE WHEN p_partkey % 11 = 0 THEN concat('scan', p_partkey, '.laz')"
        " WHEN p_partkey % 13 = 0 THEN concat('note', p_partkey, '.txt')"
        " ELSE concat('S', p_size, '_', 300 + p_partkey % 600, '_', 10 + p_partkey % 150, '_0000.laz') END AS title",
        "p_partkey * 1000 AS size",
        "concat(30 + p_partkey % 60, '_', 1 + p_partkey % 15) AS index_name",
        "p_partkey AS k",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey AS string) AS LocationSignature",
        "n_name AS AdvertisedLocationName",
        "n_nationkey % 6 <> 0 AS Advertised",
        "named_struct('WGS84', concat('POINT (', 11 + n_nationkey * 0.4, ' ', 56 + n_nationkey * 0.5, ')')) AS Geometry",
    )


ANNOUNCEMENT_COLUMNS = (
    "event_id AS announcement_id",
    "cast(user_id AS string) AS AdvertisedTrainIdent",
    "cast(event_id % 30 AS string) AS LocationSignature",
    "CASE WHEN event_id % 4 <> 0 THEN event_type END AS Operator",
    "array(named_struct('LocationName', cast(user_id % 25 AS string))) AS FromLocation",
    "CASE WHEN event_id % 9 <> 0 THEN array(named_struct('LocationName', cast((user_id * 7) % 30 AS string))) END AS ToLocation",
    "ts AS TimeAtLocation",
    "CASE WHEN event_id % 11 <> 0 THEN ts - make_dt_interval(0, 0, cast(event_id % 23 AS int), 0)"
    " + make_dt_interval(0, 0, 0, 30 * (event_id % 2)) END AS AdvertisedTimeAtLocation",
)


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*ANNOUNCEMENT_COLUMNS)


WEATHER_COLUMNS = (
    "cast(user_id AS string) AS Id",
    "concat('point ', user_id) AS Name",
    "named_struct('WGS84', concat('POINT (', user_id % 40 - 20, ' ', 50 + user_id % 15, ')')) AS Geometry",
    "event_id",
    "named_struct('Sample', ts,"
    " 'Air', named_struct('Temperature', named_struct('Value', value / 10 - 15),"
    "   'RelativeHumidity', named_struct('Value', cast(event_id % 100 AS double)),"
    "   'VisibleDistance', named_struct('Value', cast(event_id % 2000 AS double))),"
    " 'Surface', named_struct('Temperature', named_struct('Value', value / 10 - 12)),"
    " 'Wind', CASE WHEN event_id % 17 <> 0 THEN array(named_struct("
    "   'Speed', named_struct('Value', cast(event_id % 25 AS double)),"
    "   'Direction', named_struct('Value', cast(event_id % 360 AS double)))) END,"
    " 'Weather', named_struct('Precipitation', CASE WHEN event_id % 5 <> 0 THEN event_type END)) AS Observation",
)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*WEATHER_COLUMNS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS point_id",
        "l_suppkey % 20 AS tile",
        "concat(l_linenumber % 6, '-0-0-0') AS node_key",
        "cast(l_partkey AS double) AS x",
        "cast(l_suppkey AS double) AS y",
        "l_quantity AS z",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_partkey % 65536 AS int) END AS red",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_suppkey % 65536 AS int) END AS green",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_orderkey % 65536 AS int) END AS blue",
        "CASE WHEN l_linenumber % 3 = 1 THEN cast((l_partkey * 31) % 65536 AS int) END AS intensity",
    )
