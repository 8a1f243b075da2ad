"""The derived views as DuckDB SQL, written apart from the Spark ones."""

from __future__ import annotations

TITLE = "'f' || l_partkey || ['.gpkg','.laz','.tif','.jp2','.txt'][l_linenumber % 5 + 1]"

VIEWS = {
    "point_layer": """
        SELECT c_custkey AS fid, c_name, c_acctbal, c_mktsegment,
               CAST(300000 + (c_custkey * 7919) % 500000 AS DOUBLE) AS x,
               CAST(6200000 + (c_custkey * 104729) % 1300000 AS DOUBLE) AS y,
               'o' || (c_custkey % 250) AS _source_order,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey AS INT)) AS _loaded_at
        FROM customer""",
    "box_layer": """
        SELECT fid, s_name, s_acctbal, _source_order, cx, cy, half,
               cx - half AS xmin, cy - half AS ymin, cx + half AS xmax, cy + half AS ymax, _loaded_at
        FROM (SELECT s_suppkey AS fid, s_name, s_acctbal, 'o' || (s_suppkey % 250) AS _source_order,
                     CAST(300000 + (s_suppkey * 7919) % 500000 AS DOUBLE) AS cx,
                     CAST(6200000 + (s_suppkey * 104729) % 1300000 AS DOUBLE) AS cy,
                     CAST(5000 + (s_suppkey % 7) * 5000 AS DOUBLE) AS half,
                     TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(s_suppkey AS INT)) AS _loaded_at
              FROM supplier)""",
    "ledger": """
        SELECT 'o' || (l_orderkey % 200) AS order_id,
               lower(l_returnflag || l_linestatus) AS layer_name,
               lower(l_returnflag || l_linestatus) AS table_name,
               lower(l_returnflag || l_linestatus) || '.gpkg' AS source_file,
               sha256('o' || (l_orderkey % 200) || lower(l_returnflag || l_linestatus)) AS source_hash,
               count(*) AS feature_count, max(l_shipdate) AS loaded_at
        FROM lineitem GROUP BY ALL""",
    "candidates": """
        SELECT order_id, layer_name, feature_count,
               CASE WHEN CAST(substr(order_id, 2) AS INT) % 10 = 3 THEN 'x' || source_hash ELSE source_hash END AS source_hash
        FROM (SELECT order_id, layer_name, feature_count, source_hash FROM ledger
              UNION ALL
              SELECT 'o' || (o_orderkey % 250), lower(o_orderstatus), count(*),
                     sha256('o' || (o_orderkey % 250) || lower(o_orderstatus))
              FROM orders WHERE o_orderkey % 250 >= 200 GROUP BY ALL)""",
    "folders": """
        SELECT 'o' || (o_orderkey % 250) AS order_id, max(o_orderdate) AS download_date
        FROM orders WHERE o_orderkey % 250 >= 20 GROUP BY 1""",
    "hints": """
        SELECT order_id,
               ['Ortofoto RGB', 'Topografi 10', NULL, 'Laserdata NH', 'annat'][CAST(substr(order_id, 2) AS INT) % 5 + 1] AS produkttyp,
               CASE WHEN CAST(substr(order_id, 2) AS INT) % 7 = 0 THEN 'HOJDDATA grid' END AS datatyp
        FROM folders""",
    "listing": f"""
        SELECT 'o' || (l_orderkey % 200) AS order_id, {TITLE} AS title,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS length,
               CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS updated,
               'z' || (l_orderkey % 7) || '.zip' AS zip_name
        FROM lineitem""",
    "local_files": f"""
        SELECT DISTINCT 'o' || (l_orderkey % 200) AS order_id, {TITLE} AS title
        FROM lineitem WHERE l_partkey % 4 <> 0""",
    "statistics": """
        SELECT order_id, 'f' || k || '.gpkg' AS filename, i AS table_no, (k * i * 37) % 5000 AS objects
        FROM (SELECT DISTINCT 'o' || (l_orderkey % 200) AS order_id, l_partkey AS k
              FROM lineitem WHERE l_linenumber % 5 = 0 AND l_partkey % 3 <> 0),
             (VALUES (1), (2), (3)) AS t(i)
        WHERE i <= k % 4""",
    "every_candidate": """
        SELECT order_id, layer_name FROM ledger
        UNION SELECT 'o' || (o_orderkey % 250), lower(o_orderstatus) FROM orders""",
    "every_folder": """
        SELECT 'o' || (o_orderkey % 250) AS order_id, max(o_orderdate) AS download_date
        FROM orders GROUP BY 1""",
    "every_hint": """
        SELECT order_id,
               ['Ortofoto RGB', 'Topografi 10', NULL, 'Laserdata NH', 'annat'][CAST(substr(order_id, 2) AS INT) % 5 + 1] AS produkttyp,
               CASE WHEN CAST(substr(order_id, 2) AS INT) % 7 = 0 THEN 'HOJDDATA grid' END AS datatyp
        FROM every_folder""",
    "every_statistic": """
        SELECT order_id, 'f' || k || '.gpkg' AS filename, i AS table_no, (k * i * 37) % 5000 AS objects
        FROM (SELECT DISTINCT 'o' || (l_orderkey % 200) AS order_id, l_partkey AS k
              FROM lineitem),
             (VALUES (1), (2), (3)) AS t(i)
        WHERE i <= k % 4""",
    "outlines": """
        SELECT 'o' || (p_partkey % 200) AS order_id,
               CASE WHEN p_partkey % 5 = 0 THEN 'Point' ELSE 'Polygon' END AS kind,
               CAST(300000 + (p_partkey * 7919) % 500000 AS DOUBLE) AS e,
               CAST(6200000 + (p_partkey * 104729) % 1300000
                    + CASE WHEN p_partkey % 20 = 19 THEN 2000000 ELSE 0 END AS DOUBLE) AS n
        FROM part""",
    "tiles": """
        SELECT 'o' || (p_partkey % 250) AS order_id,
               CASE WHEN p_partkey % 11 = 0 THEN 'scan' || p_partkey || '.laz'
                    WHEN p_partkey % 13 = 0 THEN 'note' || p_partkey || '.txt'
                    ELSE 'S' || p_size || '_' || (300 + p_partkey % 600) || '_' || (10 + p_partkey % 150) || '_0000.laz' END AS title,
               p_partkey * 1000 AS size,
               (30 + p_partkey % 60) || '_' || (1 + p_partkey % 15) AS index_name, p_partkey AS k
        FROM part""",
    "laz_tiles": """
        SELECT order_id, title, size, k,
               CASE WHEN k % 11 = 0 THEN CAST(split_part(index_name, '_', 1) AS INT) * 10 ELSE 300 + k % 600 END AS grid_x,
               CASE WHEN k % 11 = 0 THEN CAST(split_part(index_name, '_', 2) AS INT) * 10 ELSE 10 + k % 150 END AS grid_y
        FROM tiles WHERE title LIKE '%.laz'""",
    "stations": """
        SELECT CAST(n_nationkey AS VARCHAR) AS signature, n_name AS name, n_nationkey AS k,
               n_nationkey % 6 <> 0 AS advertised,
               'POINT (' || (11 + n_nationkey * 0.4) || ' ' || (56 + n_nationkey * 0.5) || ')' AS wgs84
        FROM nation""",
    "known_stations": """
        SELECT signature, name, CAST(split_part(split_part(wgs84, '(', 2), ' ', 1) AS DOUBLE) AS lon,
               CAST(rtrim(split_part(split_part(wgs84, '(', 2), ' ', 2), ')') AS DOUBLE) AS lat
        FROM stations WHERE advertised""",
    "announcements": """
        SELECT event_id AS announcement_id, CAST(user_id AS VARCHAR) AS train,
               CAST(event_id % 30 AS VARCHAR) AS signature,
               CASE WHEN event_id % 4 <> 0 THEN event_type END AS operator,
               CAST(user_id % 25 AS VARCHAR) AS from_code,
               CASE WHEN event_id % 9 <> 0 THEN CAST((user_id * 7) % 30 AS VARCHAR) ELSE '' END AS to_code,
               ts AS seen,
               CASE WHEN event_id % 11 <> 0 THEN ts - to_minutes(CAST(event_id % 23 AS INT))
                    + to_seconds(CAST(30 * (event_id % 2) AS INT)) END AS scheduled
        FROM events""",
    "train_rows": """
        SELECT a.announcement_id, a.train, s.name AS station_name, s.lon, s.lat,
               coalesce(f.name, a.from_code) AS origin, coalesce(t.name, a.to_code) AS destination,
               coalesce(CAST(floor((epoch_us(a.seen) - epoch_us(a.scheduled)) / 60000000.0e0 + 0.5e0) AS INT), 0) AS delay,
               coalesce(a.operator, 'Unknown') AS operator, a.seen AS time
        FROM announcements a JOIN known_stations s ON a.signature = s.signature
        LEFT JOIN known_stations f ON a.from_code = f.signature
        LEFT JOIN known_stations t ON a.to_code = t.signature""",
    "weather": """
        SELECT CAST(user_id AS VARCHAR) AS id, 'point ' || user_id AS name,
               CAST(user_id % 40 - 20 AS DOUBLE) AS lon, CAST(50 + user_id % 15 AS DOUBLE) AS lat, event_id,
               value / 10 - 15 AS air_temp, value / 10 - 12 AS surface_temp,
               CAST(event_id % 100 AS DOUBLE) AS humidity, CAST(event_id % 2000 AS DOUBLE) AS visibility,
               CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 25 AS DOUBLE) END AS wind_speed,
               CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS wind_dir,
               CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'unknown' END AS precipitation, ts AS sample
        FROM events""",
    "points": """
        SELECT l_orderkey * 10 + l_linenumber AS point_id, l_suppkey % 20 AS tile,
               (l_linenumber % 6) || '-0-0-0' AS node_key, l_linenumber % 6 AS depth,
               CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, l_quantity AS z,
               CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 65536 END AS red,
               CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 65536 END AS green,
               CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey % 65536 END AS blue,
               CASE WHEN l_linenumber % 3 = 1 THEN (l_partkey * 31) % 65536 END AS intensity
        FROM lineitem""",
}

NEEDS = {
    "candidates": ("ledger",),
    "every_candidate": ("ledger",),
    "every_hint": ("every_folder",),
    "hints": ("folders",),
    "laz_tiles": ("tiles",),
    "known_stations": ("stations",),
    "train_rows": ("announcements", "known_stations"),
}

# The published series once more, as SQL on columns e and n in metres.
_THIRD = "(1/298.257222101e0) / (2 - 1/298.257222101e0)"
PROJECTED = f"""
    SELECT *, degrees(chi + l1*sin(2*chi) + l2*sin(4*chi) + l3*sin(6*chi) + l4*sin(8*chi)) AS lat,
           15.0e0 + degrees(atan2(sinh(et2), cos(xi2))) AS lon
    FROM (SELECT *, asin(sin(xi2) / cosh(et2)) AS chi,
                 2*h - 2*h^2/3 - 2*h^3 + 116*h^4/45 AS l1, 7*h^2/3 - 8*h^3/5 - 227*h^4/45 AS l2,
                 56*h^3/15 - 136*h^4/35 AS l3, 4279*h^4/630 AS l4
          FROM (SELECT *,
                       xi - b1*sin(2*xi)*cosh(2*et) - b2*sin(4*xi)*cosh(4*et) - b3*sin(6*xi)*cosh(6*et) - b4*sin(8*xi)*cosh(8*et) AS xi2,
                       et - b1*cos(2*xi)*sinh(2*et) - b2*cos(4*xi)*sinh(4*et) - b3*cos(6*xi)*sinh(6*et) - b4*cos(8*xi)*sinh(8*et) AS et2
                FROM (SELECT *, n / rad AS xi, (e - 500000.0e0) / rad AS et,
                             h/2 - 2*h^2/3 + 37*h^3/96 - h^4/360 AS b1, h^2/48 + h^3/15 - 437*h^4/1440 AS b2,
                             17*h^3/480 - 37*h^4/840 AS b3, 4397*h^4/161280 AS b4
                      FROM (SELECT *, 0.9996e0 * 6378137.0e0 / (1 + h) * (1 + h^2/4 + h^4/64) AS rad
                            FROM (SELECT *, {_THIRD} AS h FROM (%s))))))"""


def projected(inner: str) -> str:
    """``inner`` gives columns e and n; the result adds lat and lon."""
    return "(" + PROJECTED.replace("%s", inner) + ")"


def sql(body: str, *views: str) -> str:
    """``body`` with the views it reads in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered) + "\n" + body
