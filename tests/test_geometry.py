"""Geometry reading, writing, predicates and projection against hand-made values."""

from __future__ import annotations

import json
import random
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairngeo.functions import crs
from cairngeo.functions import geometry as G


def decode(*blobs):
    return G.decode_batch(pa.array(list(blobs), pa.binary())).to_pylist()


def coords(geom):
    return [[[(v["x"], v["y"]) for v in ring] for ring in part["rings"]] for part in geom["parts"]]


def wkb_point(x, y, order="<", code=1, extra=b"", tail=b""):
    return struct.pack(order + "BI", 0 if order == ">" else 1, code) + extra + struct.pack(order + "dd", x, y) + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_both_byte_orders(order):
    (geom,) = decode(wkb_point(1.5, -2.0, order))
    assert geom["type"] == "Point" and coords(geom) == [[[(1.5, -2.0)]]]


def test_srid_flag_and_extra_dimensions():
    with_srid = wkb_point(1, 2, code=0x20000001, extra=struct.pack("<I", 3006))
    flag_z = wkb_point(1, 2, code=0x80000001, tail=struct.pack("<d", 9))
    iso_z = wkb_point(1, 2, code=1001, tail=struct.pack("<d", 9))
    iso_zm = wkb_point(1, 2, code=3001, tail=struct.pack("<dd", 9, 8))
    assert [coords(g) for g in decode(with_srid, flag_z, iso_z, iso_zm)] == [[[[(1.0, 2.0)]]]] * 4


def test_line_with_heights_keeps_its_stride():
    line = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 0, 0, 5, 3, 4, 6)
    (geom,) = decode(line)
    assert coords(geom) == [[[(0.0, 0.0), (3.0, 4.0)]]]


def test_collection_reads_every_member():
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 0, 0, 1, 1)
    multi = struct.pack("<BII", 1, 4, 2) + wkb_point(7, 8) + wkb_point(9, 10, ">")
    blob = struct.pack("<BII", 1, 7, 3) + line + wkb_point(5, 6) + multi
    (geom,) = decode(blob)
    assert geom["type"] == "GeometryCollection"
    assert [(p["member"], p["kind"]) for p in geom["parts"]] == [
        (0, "LineString"), (1, "Point"), (2, "MultiPoint"), (2, "MultiPoint"),
    ]
    assert G.encode_batch(G.decode_batch(pa.array([blob], pa.binary())))[0].as_py() == blob.replace(
        wkb_point(9, 10, ">"), wkb_point(9, 10)
    )


def test_null_empty_and_bad_blobs():
    empty = wkb_point(float("nan"), float("nan"))
    assert decode(None, empty) == [None, {"type": "Point", "parts": []}]
    assert G.encode_batch(G.decode_batch(pa.array([None], pa.binary()))).to_pylist() == [None]
    for bad in (b"\x01\x01", b"\x05" + b"\0" * 20, struct.pack("<BI", 1, 42) + b"\0" * 16):
        with pytest.raises(ValueError):
            decode(bad)


finite = st.floats(-1e7, 1e7, allow_nan=False)
ring = st.lists(st.tuples(finite, finite), min_size=3, max_size=6).map(lambda r: [*r, r[0]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ring, min_size=1, max_size=3), min_size=1, max_size=4))
def test_write_then_read(polygons):
    vertices = [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in polygons]
    parts = [{"member": 0, "kind": "MultiPolygon", "rings": r} for r in vertices]
    geom = {"type": "MultiPolygon", "parts": parts}
    made = pa.array([None, geom, geom], to_arrow_type(G.GEOM_TYPE))
    blobs = G.encode_batch(made)
    assert G.decode_batch(blobs).to_pylist() == [None, geom, geom]
    assert G.encode_batch(made.slice(1)).to_pylist() == blobs.to_pylist()[1:]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(finite, finite), min_size=1, max_size=20), st.booleans())
def test_points_in_bulk_equal_points_one_by_one(points, other_order):
    blobs = [wkb_point(x, y) for x, y in points]
    mixed = pa.array([*blobs, wkb_point(1, 2, ">")] if other_order else blobs, pa.binary())
    geoms = G.decode_batch(mixed)
    assert [coords(g) for g in geoms.to_pylist()[: len(points)]] == [[[[xy]]] for xy in points]
    assert G.encode_batch(geoms).to_pylist()[: len(points)] == blobs
    assert G.encode_batch(geoms.slice(1)).to_pylist()[: len(points) - 1] == blobs[1:]
    assert G.decode_batch(mixed.slice(1)).to_pylist() == geoms.to_pylist()[1:]


def header(envelope, wkb, size):
    return b"GP\0" + bytes([envelope * 2 + 1]) + struct.pack("<i", 3006) + b"\0" * size + wkb


def test_strip_header(spark):
    wkb = wkb_point(1, 2)
    rows = [(i, header(i, wkb, size)) for i, size in ((0, 0), (1, 32), (2, 48), (3, 48), (4, 64))] + [(9, wkb)]
    df = spark.createDataFrame(rows, "k int, b binary").select(G.strip_header(F.col("b")).alias("b"))
    assert [bytes(r.b) for r in df.collect()] == [wkb] * 6
    short = spark.createDataFrame([(b"GP\0",)], "b binary").select(G.strip_header(F.col("b")))
    with pytest.raises(PySparkException):
        short.collect()


def frame(spark, *blobs):
    df = spark.createDataFrame([(i, bytearray(b) if b else None) for i, b in enumerate(blobs)], "k int, b binary")
    return df.withColumn("g", G.parse_wkb("b"))


LINE = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 0, 0, 10, 10)
MULTILINE = struct.pack("<BII", 1, 5, 1) + LINE
POLY = struct.pack("<BII", 1, 3, 2) + struct.pack("<I", 5) + struct.pack("<10d", 0, 0, 10, 0, 10, 10, 0, 10, 0, 0) + struct.pack("<I", 5) + struct.pack("<10d", 4, 4, 6, 4, 6, 6, 4, 6, 4, 4)
MULTIPOLY = struct.pack("<BII", 1, 6, 1) + POLY
COLLECTION = struct.pack("<BII", 1, 7, 2) + wkb_point(1, 2) + MULTIPOLY


def test_text_and_json(spark):
    blobs = [wkb_point(0.0001, 12345678.5), LINE, MULTILINE, POLY, MULTIPOLY, struct.pack("<BII", 1, 4, 1) + wkb_point(3, 4), None]
    got = frame(spark, *blobs).select(G.as_text("g").alias("t"), G.as_geojson("g").alias("j")).collect()
    assert [r.t for r in got] == [
        "POINT(0.0001 12345678.5)",
        "LINESTRING(0.0 0.0, 10.0 10.0)",
        "MULTILINESTRING((0.0 0.0, 10.0 10.0))",
        "POLYGON((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0), (4.0 4.0, 6.0 4.0, 6.0 6.0, 4.0 6.0, 4.0 4.0))",
        "MULTIPOLYGON(((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0), (4.0 4.0, 6.0 4.0, 6.0 6.0, 4.0 6.0, 4.0 4.0)))",
        "MULTIPOINT((3.0 4.0))",
        None,
    ]
    shapes = [json.loads(r.j) if r.j else None for r in got]
    assert shapes[0] == {"type": "Point", "coordinates": [0.0001, 12345678.5]}
    assert shapes[1] == {"type": "LineString", "coordinates": [[0, 0], [10, 10]]}
    assert shapes[2]["coordinates"] == [[[0, 0], [10, 10]]]
    assert len(shapes[3]["coordinates"]) == 2 and shapes[4]["coordinates"] == [shapes[3]["coordinates"]]
    assert shapes[5] == {"type": "MultiPoint", "coordinates": [[3, 4]]}
    assert shapes[6] is None


def test_collection_has_json_but_no_text(spark):
    df = frame(spark, COLLECTION)
    shape = json.loads(df.select(G.as_geojson("g")).first()[0])
    assert [m["type"] for m in shape["geometries"]] == ["Point", "MultiPolygon"]
    with pytest.raises(PySparkException):
        df.select(G.as_text("g")).collect()


def test_envelope_and_centroid_of_nothing(spark):
    df = frame(spark, wkb_point(float("nan"), 0.0), None, POLY)
    got = df.select(*[c.alias(k) for k, c in G.envelope("g").items()], G.centroid("g").alias("c")).collect()
    assert tuple(got[0])[:4] == (None,) * 4 and tuple(got[0].c) == (0.0, 0.0)
    assert tuple(got[1].c) == (None, None)
    assert tuple(got[2])[:4] == (0.0, 0.0, 10.0, 10.0) and tuple(got[2].c) == (4.4, 4.4)


@pytest.mark.parametrize(
    ("box", "meets"),
    [
        ((4.5, 4.5, 5.5, 5.5), False),  # inside the hole
        ((3.5, 4.5, 4.5, 5.5), True),  # over the hole's edge
        ((1, 1, 2, 2), True),  # inside, no vertex near
        ((-5, -5, 20, 20), True),  # around it all
        ((10, 10, 12, 12), True),  # one corner in common
        ((10.5, 0, 12, 12), False),
        ((-1, 4, 11, 5), True),  # straight through
    ],
)
def test_polygon_with_hole_meets_box(spark, box, meets):
    names = dict(zip(("xmin", "ymin", "xmax", "ymax"), (f"{float(v)}D" for v in box)))
    df = frame(spark, POLY, MULTIPOLY, COLLECTION.replace(wkb_point(1, 2), wkb_point(99, 99)))
    assert [r[0] for r in df.select(G.intersects_box("g", names)).collect()] == [meets] * 3


def test_line_meets_box_only_where_it_runs(spark):
    df = frame(spark, LINE)
    for box, meets in (((6, 0, 10, 4), False), ((4, 3, 6, 5), True), ((10, 10, 11, 11), True)):
        names = dict(zip(("xmin", "ymin", "xmax", "ymax"), (f"{float(v)}D" for v in box)))
        assert df.select(G.intersects_box("g", names)).first()[0] is meets


def test_axis_box(spark):
    turned = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + struct.pack("<10d", 0, -1, 1, 0, 0, 1, -1, 0, 0, -1)
    square = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + struct.pack("<10d", 0, 0, 1, 0, 1, 1, 0, 1, 0, 0)
    df = frame(spark, wkb_point(1, 1), square, turned, POLY, LINE)
    assert [r[0] for r in df.select(G.is_axis_box("g")).collect()] == [True, True, False, False, False]


def test_control_points(spark):
    # published pair for central Stockholm, and the central meridian
    df = spark.createDataFrame([(674032.357, 6580821.991), (500000.0, 6500000.0)], "e double, n double")
    lon, lat = crs.grid_to_lonlat("e", "n")
    got = df.select(lon, lat).collect()
    assert got[0][0] == pytest.approx(18.059196, abs=2e-6) and got[0][1] == pytest.approx(59.330231, abs=2e-6)
    assert got[1][0] == pytest.approx(15.0, abs=1e-12)


def test_there_and_back_within_a_millimetre(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(2e5, 1e6), rng.uniform(6.1e6, 7.7e6)) for _ in range(500)]
    df = spark.createDataFrame(rows, "e double, n double")
    lon, lat = crs.grid_to_lonlat("e", "n")
    east, north = crs.lonlat_to_grid("lon", "lat")
    got = df.select("e", "n", lon.alias("lon"), lat.alias("lat")).select("e", "n", east.alias("e2"), north.alias("n2"))
    for r in got.collect():
        assert abs(r.e - r.e2) < 1e-3 and abs(r.n - r.n2) < 1e-3


def test_range_and_unknown_systems(spark):
    df = spark.createDataFrame([(50000.0, 6500000.0), (500000.0, 8000000.0), (500000.0, 6500000.0)], "e double, n double")
    assert [r[0] is None for r in df.select(crs.sweref_to_wgs84("e", "n")).collect()] == [True, True, False]
    assert crs.transform_sql("g", 3006, 3006) == "g"
    with pytest.raises(ValueError):
        crs.transform_sql("g", 3006, 3857)
