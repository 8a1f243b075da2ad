"""Delivery readers and rules on hand-made folders and rows."""

from __future__ import annotations

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cairngeo.functions import feeds as fx
from cairngeo.functions import text
from cairngeo.operators import deliveries, feeds, points, tiles
from cairngeo.operators.versioned import VersionedTable
from cairngeo.sources import archives
from cairngeo.sources import deliveries as readers
from cairngeo.sources import feeds as feed_readers


def put(root, path, content):
    where = os.path.join(root, path)
    os.makedirs(os.path.dirname(where), exist_ok=True)
    with open(where, "w" if isinstance(content, str) else "wb") as out:
        out.write(content)


def pairs(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_scan_keeps_underscore_orders_and_drops_hidden(spark, tmp_path):
    root = str(tmp_path / "in")
    for path in ("a b/x.zip", "_c/y.zip", ".d/z.zip", "e/tiles/t.laz"):
        put(root, path, "12345")
    got = readers.scan_orders(spark, root)
    assert pairs(got, "order_id", "file_name", "size") == [("_c", "y.zip", 5), ("a b", "x.zip", 5), ("e", "t.laz", 5)]
    assert "content" not in got.columns


def test_zip_members_skip_folders_and_report_broken_archives(spark, tmp_path):
    root = str(tmp_path / "in")
    put(root, "o1/bad.zip", "no archive")
    with zipfile.ZipFile(os.path.join(root, "o1", "good.ZIP"), "w") as z:
        z.writestr("d/", "")
        z.writestr("d/A.GPKG", "abc")
        z.writestr("noending", "x")
    got = archives.zip_members(readers.scan_orders(spark, root))
    whole = got.filter("error IS NULL")
    assert pairs(whole, "entry", "inner_path", "extension", "size") == [(0, "d/A.GPKG", ".gpkg", 3), (1, "noending", "", 1)]
    broken = got.filter("error IS NOT NULL").collect()
    assert [(r.order_id, r.zip_name, r.entry) for r in broken] == [("o1", "bad.zip", None)] and "cannot read" in broken[0].error


def test_statistics_last_entry_wins_and_bad_json_gives_nothing(spark, tmp_path):
    root = str(tmp_path / "in")

    def feature(name, *counts):
        stats = [{"tabellnamn": f"t{i}", "antalObjekt": n} for i, n in enumerate(counts)]
        ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
        return {"properties": {"filnamn": name, "statistik": stats}, "geometry": {"type": "Polygon", "coordinates": [ring]}}

    point = {"properties": {"filnamn": "p", "statistik": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    put(root, "o1/uttag.json", json.dumps({"features": [feature("a", 1), feature("", 9), feature("a", 1000, 5), point]}))
    put(root, "o2/uttag.json", "{broken")
    got = readers.read_delivery_stats(spark, root).select(
        "order_id",
        "filename",
        deliveries.object_count(F.col("statistics")).alias("n"),
        deliveries.object_text(F.col("statistics")).alias("t"),
        F.size("geometry.coordinates").alias("rings"),
    )
    rows = {r.filename: r for r in got.collect()}
    assert set(rows) == {"a", "p"}
    assert (rows["a"].n, rows["a"].t, rows["a"].rings) == (1005, "t0: 1,000, t1: 5", 1)
    assert (rows["p"].n, rows["p"].t) == (0, "-")


def test_tile_index_reads_only_arrays_of_tiles(spark, tmp_path):
    root = str(tmp_path / "in")
    entries = [
        {"title": "20C020_650_60_0000.laz", "href": "h", "length": 1048576},
        {"title": "odd.laz"},
        {"title": "note.txt"},
    ]
    put(root, "o1/63_5", "  " + json.dumps(entries))
    put(root, "o1/64_4", '{"title": "x_1_2_.laz"}')
    put(root, "o1/64_5", "[not json")
    put(root, "o1/a_1", json.dumps(entries))
    got = tiles.with_boxes(tiles.parsed(readers.read_tile_index(spark, root)))
    assert pairs(got, "title", "grid_x", "grid_y", "size", "xmin", "ymin", "xmax", "ymax", "size_mb") == [
        ("20C020_650_60_0000.laz", 650, 60, 1048576, 650000, 6600000, 652500, 6602500, 1.0),
        ("odd.laz", 630, 50, 0, 630000, 6500000, 632500, 6502500, 0.0),
    ]


def test_order_metadata_falls_back(spark, tmp_path):
    root = str(tmp_path / "in")
    put(root, "o1/order_metadata.json", json.dumps({"order_id": "o1", "download_date": "2024-05-01T10:00:00Z", "files": []}))
    put(root, "o1/metadata.json", json.dumps({"download_date": "2020-01-01", "package_name": "P", "total_size": 5}))
    put(root, "o2/order_metadata.json", "{broken")
    put(root, "o2/metadata.json", json.dumps({"download_date": "2024-02-03T04:05:06", "total_size": 7}))
    got = readers.read_order_metadata(spark, root)
    shown = got.select("order_id", F.date_format("download_date", "yyyy-MM-dd HH:mm:ss").alias("d"), "total_size", "package_name")
    assert sorted(tuple(r) for r in shown.collect()) == [
        ("o1", "2024-05-01 10:00:00", None, "P"),
        ("o2", "2024-02-03 04:05:06", 7, ""),
    ]


def members(spark, rows):
    return spark.createDataFrame(rows, "order_id string, zip_name string, entry bigint, extension string")


def hint_rows(spark, rows):
    return spark.createDataFrame(rows, "order_id string, produkttyp string, product_type string, datatyp string, data_type string")


def test_dominant_type_rules(spark):
    rows = [
        ("tie", "b.zip", 0, ".gpkg"), ("tie", "a.zip", 1, ".laz"),  # first met wins
        ("ortho", "a.zip", 0, ".tif"), ("ortho", "a.zip", 1, ".jp2"), ("ortho", "a.zip", 2, ".laz"), ("ortho", "a.zip", 3, ".laz"),
        ("ortho", "a.zip", 4, ".tif"),
        ("dem", "a.zip", 0, ".tif"), ("dem", "a.zip", 1, ".TXT"),
        ("none", "a.zip", 0, ".txt"), ("hinted", "a.zip", 0, ".txt"),
    ]
    hints = [
        ("ortho", "Ortofoto 2024", None, None, None),
        ("hinted", "Topografi", None, None, "Laserdata"),  # the last key decides
        ("alone", None, "FASTIGHET", None, None),
    ]
    got = deliveries.dominant_type(members(spark, rows), hint_rows(spark, hints))
    assert pairs(got, "order_id", "data_type", "is_publishable", "files_of_type") == [
        ("alone", "vector_gpkg", True, 0),
        ("dem", "raster_dem", False, 1),
        ("hinted", "lidar_laz", False, 0),
        ("none", "unknown", False, 0),
        ("ortho", "raster_ortho", False, 3),
        ("tie", "lidar_laz", False, 1),
    ]


def test_transfer_rules(spark):
    listing = spark.createDataFrame(
        [
            ("o", "missing", 1, "2024-01-01"), ("o", "same", 2, "2024-01-02"), ("o", "newer", 4, "2024-01-03"),
            ("o", "undated", 8, None), ("n", "nodate", 16, "2024-01-01"),
        ],
        "order_id string, title string, length bigint, updated string",
    ).withColumn("updated", text.iso_instant(F.col("updated")))
    local = spark.createDataFrame(
        [("o", "same"), ("o", "same"), ("o", "newer"), ("o", "undated"), ("n", "nodate")], "order_id string, title string"
    )
    folders = spark.createDataFrame([("o", "2024-01-02")], "order_id string, download_date string").withColumn(
        "download_date", text.iso_instant(F.col("download_date"))
    )
    plan = deliveries.transfer_plan(listing, local, folders)
    assert dict(pairs(plan, "title", "action")) == {
        "missing": "fetch", "same": "skip", "newer": "fetch", "undated": "skip", "nodate": "fetch",
    }
    assert tuple(deliveries.transfer_summary(plan).first()) == (3, 2, 21)
    check = {r.order_id: r for r in deliveries.update_check(listing, folders).collect()}
    assert check["o"].has_update and check["o"].newer_files == 1 and check["o"].note is None
    assert check["n"].has_update and check["n"].note == deliveries.NO_LOCAL_NOTE
    empty = deliveries.update_check(listing.filter("false"), folders).first()
    assert not empty.has_update and empty.remote_date is None


def test_iso_instants(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T05:04:05.5+02:00", "2024-01-02", "soon", "12:30", None]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    got = [r[0] for r in df.select(F.unix_millis(text.iso_instant(F.col("t")))).collect()]
    base = 1704164645000
    assert got == [base, base, base + 500, 1704153600000, None, None, None]


def test_names(spark):
    paths = ["a/b.c/d_sverige.gpkg", "x_sweden_sverige.gpkg", ".hidden", "plain", "A.tar.GZ", "d/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(text.layer_name(F.col("p")).alias("l"), text.extension(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got] == [
        ("d", ".gpkg"), ("x_sweden", ".gpkg"), (".hidden", ""), ("plain", ""), ("A.tar", ".gz"), ("", ""),
    ]
    names = ["Väg 1", "1abc", "ok_2", "", "Ünder-score"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    tables = [r[0] for r in df.select(text.table_name(F.col("n"))).collect()]
    assert tables == ["v_g_1", "_1abc", "ok_2", "", "_nder_score"] == [text.clean_name(n) for n in names]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1280, 1048575, 1048576, 1073741823, 1073741824, 1610612736]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    got = df.select(text.size_text(F.col("s")).alias("a"), text.size_text_short(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == [f"{s} B" if s < 1024 else f"{s / 1024:.1f} KB" if s < 1024**2 else f"{s / 1024**2:.1f} MB" if s < 1024**3 else f"{s / 1024**3:.2f} GB" for s in sizes]
    assert [r.b for r in got] == ["0 B", "1023 B", "1 KB", "1.3 KB", "1024 KB", "1 MB", "1024 MB", "1 GB", "1.5 GB"]


def test_delay_rules(spark):
    base = "timestamp'2024-01-01 12:00:00'"
    rows = [-90, -30, -29, 0, 29, 30, 570, 600]
    df = spark.createDataFrame([(r,) for r in rows], "s int")
    delay = fx.delay_minutes(F.expr(f"{base} + make_interval(0, 0, 0, 0, 0, 0, s)"), F.expr(base))
    got = df.select(delay.alias("d")).select("d", fx.delay_class(F.col("d")).alias("c"), fx.delay_text(F.col("d")).alias("t"))
    assert [tuple(r) for r in got.collect()] == [
        (-1, "ok", "On time"), (0, "ok", "On time"), (0, "ok", "On time"), (0, "ok", "On time"), (0, "ok", "On time"),
        (1, "warn", "1 min delay"), (10, "bad", "10 min delay"), (10, "bad", "10 min delay"),
    ]
    none = spark.range(1).select(fx.delay_minutes(F.lit(None).cast("timestamp"), F.expr(base))).first()[0]
    assert none == 0


def test_wind_air_and_positions(spark):
    df = spark.createDataFrame([(0.0,), (22.4,), (22.5,), (337.4,), (337.5,), (360.0,), (None,)], "d double")
    assert [r[0] for r in df.select(fx.wind_direction(F.col("d"))).collect()] == ["N", "N", "NE", "NW", "N", "N", ""]
    df = spark.createDataFrame([(-0.1,), (0.0,), (10.0,), (20.0,), (None,)], "t double")
    assert [r[0] for r in df.select(fx.air_class(F.col("t"))).collect()] == ["freezing", "cold", "mild", "warm", "warm"]
    df = spark.createDataFrame([("POINT (12.5 57)",), ("POINT (-1 2)",), ("POINT (1.2.3 4)",), ("",), (None,)], "p string")
    signless = [r[0] and tuple(r[0]) for r in df.select(fx.point_text(F.col("p"))).collect()]
    signed = [r[0] and tuple(r[0]) for r in df.select(fx.point_text(F.col("p"), fx.WEATHER_POINT)).collect()]
    assert signless == [(12.5, 57.0), None, None, None, None] and signed[1] == (-1.0, 2.0)


def test_latest_keeps_first_seen_on_equal_times(spark):
    df = spark.createDataFrame(
        [("a", 5, "2024-01-01 10:00:00", "x"), ("a", 3, "2024-01-01 10:00:00", "y"), ("a", 1, "2024-01-01 09:00:00", "z")],
        "k string, n bigint, t string, v string",
    ).withColumn("t", F.col("t").cast("timestamp"))
    got = feeds.latest(df, "k", "t", "n")
    assert [r.v for r in got.collect()] == ["y"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_feed_files(spark, tmp_path):
    put(str(tmp_path), "s.json", json.dumps({"LocationSignature": "G", "AdvertisedLocationName": "Town", "Advertised": True, "Geometry": {"WGS84": "POINT (12 57)"}}))
    put(str(tmp_path), "w.json", json.dumps({"Id": "1", "Name": "n", "Geometry": {"WGS84": "POINT (1 2)"}, "Observation": {"Sample": "2024-01-01T00:00:00Z", "Wind": []}}))
    put(str(tmp_path), "a.json", json.dumps({"announcement_id": 1, "AdvertisedTrainIdent": "7", "LocationSignature": "G", "FromLocation": [{"LocationName": "Q"}], "TimeAtLocation": "2024-01-01T00:03:00Z"}))
    stations = feeds.advertised_stations(feed_readers.read_stations(spark, str(tmp_path / "s.json")))
    row = feeds.train_rows(feed_readers.read_announcements(spark, str(tmp_path / "a.json")), stations).first()
    assert (row.train, row.origin, row.destination, row.operator, row.delay, row.station_name) == ("7", "Q", "", "Unknown", 0, "Town")
    weather = feeds.weather_rows(feed_readers.read_weather(spark, str(tmp_path / "w.json"))).first()
    assert (weather.precipitation, weather.wind_sector, weather.wind_dir, weather.air_temp) == ("unknown", "", None, None)


def test_point_colours(spark):
    df = spark.createDataFrame(
        [("a", "0-0-0-0", 0.0, 0.0, 10.0, 65535, 0, 0, 1), ("a", "4-1-1-1", 1.0, 2.0, 135.0, None, 1, 1, None), ("a", "2-0-0-0", 5.0, 5.0, 20.0, None, None, None, 65535)],
        "tile string, node_key string, x double, y double, z double, red int, green int, blue int, intensity int",
    )
    got = {r.node_key: r for r in points.scene(df).collect()}
    assert (got["0-0-0-0"].r, got["0-0-0-0"].g) == (1.0, 0.0)
    assert (got["4-1-1-1"].r, got["4-1-1-1"].g, got["4-1-1-1"].b) == (0.5, 0.5, 0.5)
    assert got["2-0-0-0"].b == 1.0 and (got["2-0-0-0"].px, got["2-0-0-0"].py, got["2-0-0-0"].pz) == (5.0, 10.0, -5.0)
    assert [r.node_key for r in points.coarse_nodes(df).collect()] == ["0-0-0-0", "2-0-0-0"]
    assert points.MAX_DEPTH == 3


def test_versioned_table_survives_a_half_written_version(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v int").schema
    table = VersionedTable(spark, str(tmp_path / "t"), schema)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", 1), ("b", 2)], schema), ["k"])
    table.upsert(spark.createDataFrame([("b", 3), ("c", 4)], schema), ["k"])
    put(str(tmp_path), "t/v00000003/part-0.parquet", "half")
    assert pairs(table.read(), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    table.upsert(spark.createDataFrame([("a", 9)], schema), ["k"])
    assert pairs(table.read(), "k", "v") == [("a", 9), ("b", 3), ("c", 4)]


@pytest.mark.parametrize("word", ["produkttyp", "data_type"])
def test_hints_are_read_from_the_metadata(spark, tmp_path, word):
    put(str(tmp_path), "o/uttag.json", json.dumps({word: "Hojdmodell 2m", "features": []}))
    row = readers.read_hints(spark, str(tmp_path)).first()
    assert row["order_id"] == "o" and row[word] == "Hojdmodell 2m"
