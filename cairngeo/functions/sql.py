"""SQL functions for users who write SQL.

All but the WKB pair are SQL expressions, so the optimizer sees through them.
``geo_parts`` gives the nested geometry the others take.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import crs
from . import geometry as G

GEOM = G.GEOM_TYPE.simpleString()
BOX_PARAMETERS = "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
BOX = {name: name for name in ("xmin", "ymin", "xmax", "ymax")}


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, result type, body)."""
    number, envelope = "DOUBLE", G.envelope_sql("g")
    there, back = crs.transform_sql("g", crs.SWEREF, crs.WGS84), crs.transform_sql("g", crs.WGS84, crs.SWEREF)
    moved = (
        f"CASE WHEN source = target THEN g WHEN source = 3006 AND target = 4326 THEN {there}"
        f" WHEN source = 4326 AND target = 3006 THEN {back}"
        f" ELSE raise_error(concat('no transform from ', source, ' to ', target)) END"
    )
    box_a = {name: f"a.{name}" for name in BOX}
    box_b = {name: f"b.{name}" for name in BOX}
    box_type = "STRUCT<xmin:DOUBLE,ymin:DOUBLE,xmax:DOUBLE,ymax:DOUBLE>"
    return {
        "geo_transform": (f"g {GEOM}, source INT, target INT", GEOM, moved),
        "geo_asgeojson": (f"g {GEOM}", "STRING", G.as_geojson_sql("g")),
        "geo_astext": (f"g {GEOM}", "STRING", G.as_text_sql("g")),
        "geo_xmin": (f"g {GEOM}", number, envelope["xmin"]),
        "geo_ymin": (f"g {GEOM}", number, envelope["ymin"]),
        "geo_xmax": (f"g {GEOM}", number, envelope["xmax"]),
        "geo_ymax": (f"g {GEOM}", number, envelope["ymax"]),
        "geo_envelope": (
            f"g {GEOM}",
            box_type,
            "struct(" + ", ".join(f"{text} AS {name}" for name, text in envelope.items()) + ")",
        ),
        "geo_centroid": (f"g {GEOM}", "STRUCT<x:DOUBLE,y:DOUBLE>", G.centroid_sql("g")),
        "geo_bbox_overlaps": (f"a {box_type}, b {box_type}", "BOOLEAN", G.boxes_overlap_sql(box_a, box_b)),
        "geo_intersects": (f"a {GEOM}, b {GEOM}", "BOOLEAN", G.intersects_sql("a", "b")),
        "geo_intersects_box": (f"g {GEOM}, {BOX_PARAMETERS}", "BOOLEAN", G.intersects_box_sql("g", BOX)),
        "geo_contains": (f"g {GEOM}, x DOUBLE, y DOUBLE", "BOOLEAN", G.contains_sql("g", "x", "y")),
        "geo_sweref_to_wgs84": (
            "e DOUBLE, n DOUBLE",
            "STRUCT<lat:DOUBLE,lon:DOUBLE>",
            crs.sweref_to_wgs84_sql("e", "n"),
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Register every ``geo_`` function in the session and return the names."""
    made = definitions()
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("geo_parts", G.parse_wkb)
    spark.udf.register("geo_aswkb", G.write_wkb)
    return [*made, "geo_parts", "geo_aswkb"]
