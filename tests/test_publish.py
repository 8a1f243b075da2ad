"""Publishing from hand-made archives, and the streams."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from cairngeo.operators import feeds, layers
from cairngeo.operators.publish import Publisher
from cairngeo.plans.landing import write_gpkg
from cairngeo.sources import archives
from cairngeo.sources import deliveries as readers
from cairngeo.streaming import live


def blob(x, y):
    return b"GP\0\x01" + struct.pack("<i", 3006) + struct.pack("<BIdd", 1, 1, x, y)


def archive(root, order, name, layers, extra=()):
    """One archive with a GeoPackage per (member, layer, rows, columns)."""
    folder = os.path.join(root, order)
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(os.path.join(folder, name), "w") as out:
        for member, layer, rows, columns in layers:
            part = os.path.join(root, f".{uuid.uuid4().hex}.gpkg")
            write_gpkg(part, layer, rows, columns, "POINT", (None, 1.0, 2.0, 3.0))
            out.write(part, member)
            os.remove(part)
        for member, content in extra:
            out.writestr(member, content)


COLUMNS = [("Name", "TEXT"), ("n", "INTEGER"), ("r", "REAL"), ("when", "DATE"), ("ok", "BOOLEAN"), ("b", "BLOB"), ("d", "NUMERIC")]


def rows(first, count):
    return [
        (fid, blob(500000.0 + fid, 6500000.0), f"name {fid}", fid, fid / 2, "2024-01-02", fid % 2, bytes([fid % 256]), 1.25)
        for fid in range(first, first + count)
    ]


@pytest.fixture()
def root(tmp_path):
    where = str(tmp_path / "in")
    os.makedirs(where)
    archive(where, "one", "a.zip", [("x/roads_sverige.gpkg", "Roads-1", rows(10, 30), COLUMNS)])
    archive(where, "one", "b.zip", [("roads.gpkg", "Roads-1", rows(1, 5), COLUMNS), ("empty.gpkg", "Empty", [], COLUMNS)])
    archive(where, "two", "c.zip", [("lakes.gpkg", "lakes", rows(1, 3), COLUMNS)], [("bad.gpkg", b"no database")])
    archive(where, "dem", "d.zip", [], [("h.tif", b"1")])
    return where


def make(spark, root, tmp_path):
    return Publisher(spark, root, "pub_" + uuid.uuid4().hex[:8], location=str(tmp_path / "store"))


def report_rows(report):
    return sorted((r.order_id, r.layer_name or "", r.feature_count, r.status) for r in report.collect())


def test_catalogue(spark, root, tmp_path):
    staged = archives.unpack(archives.zip_members(readers.scan_orders(spark, root)), str(tmp_path / "staged"))
    got = {(r.zip_name, r.layer_name): r for r in archives.source_layers(staged).collect()}
    assert set(got) == {("a.zip", "Roads-1"), ("b.zip", "Roads-1"), ("b.zip", "Empty"), ("c.zip", "lakes"), ("c.zip", None)}
    roads = got[("a.zip", "Roads-1")]
    assert (roads.feature_count, roads.srid, roads.min_x, roads.max_y) == (30, 3006, None, 3.0)
    assert [c.name for c in roads.columns] == [c for c, _ in COLUMNS]
    assert got[("b.zip", "Empty")].feature_count == 0 and "cannot read" in got[("c.zip", None)].error


def test_hash_over_several_files(spark):
    def hashed(*parts):
        rows = [("o", "l", f"p{i}", h * 64, f"d/f{i}.gpkg", 3006, [("a", "TEXT")], None) for i, h in enumerate(parts)]
        df = spark.createDataFrame(
            rows,
            "order_id string, layer_name string, zip_name string, source_hash string, inner_path string, srid int,"
            " columns array<struct<name:string,type:string>>, error string",
        )
        row = Publisher.layer_groups(df).first()
        assert row.uniform and row.source_file == "f0.gpkg"
        return row.source_hash

    assert hashed("a") == "a" * 64
    assert hashed("a", "b") == hashed("b", "a")
    assert len({hashed("a", "a"), hashed("b", "b"), hashed("a", "b"), hashed("f", "f", "f", "f", "f", "f", "f", "f")}) == 4


def test_serial_numbers_follow_archive_member_and_row(spark, root, tmp_path):
    staged = archives.unpack(archives.zip_members(readers.scan_orders(spark, root)), str(tmp_path / "staged"))
    roads = staged.filter("layer_name = 'Roads-1'")
    columns = archives.source_layers(roads).first().columns
    got = archives.read_layer(roads, columns).orderBy("fid").collect()
    assert [r.fid for r in got] == list(range(1, 36))
    assert [r.source_row for r in sorted(got, key=lambda r: (r.zip_name, r.inner_path, r.source_row))] == [r.source_row for r in got]
    first = next(r for r in got if r.source_row == 12)
    assert (first["name"], first.n, first.r, first.when, first.ok, bytes(first.b), str(first.d)) == (
        "name 12", 12, 6.0, "2024-01-02", False, b"\x0c", "1.250000000000000000",
    )


def test_publish_skip_change_and_clean(spark, root, tmp_path):
    publisher = make(spark, root, tmp_path)
    first = publisher.publish_orders()
    assert report_rows(first) == [
        ("one", "Empty", 0, "ok"), ("one", "Roads-1", 35, "ok"), ("two", "bad", 0, "failed"), ("two", "lakes", 0, "failed"),
    ]
    roads = spark.table(f"{publisher.database}.roads_1")
    assert roads.count() == 35 and roads.agg(F.max("fid")).first()[0] == 35
    row = roads.filter("n = 10").first()
    assert row.srid == 4326 and abs(row.xmin - 15.0) < 1e-3 and row["_source_order"] == "one" and row["_loaded_at"]
    empty = spark.table(f"{publisher.database}.empty")
    assert empty.count() == 0 and "name" in empty.columns
    ledger = {(r.order_id, r.layer_name): r for r in publisher.ledger.read().collect()}
    assert set(ledger) == {("one", "Empty"), ("one", "Roads-1")}
    assert ledger[("one", "Empty")].bbox is None and ledger[("one", "Roads-1")].bbox.startswith("POLYGON((15.0")

    profile = layers.schema_profile(layers.layer_catalogue(spark, publisher.database))
    assert sorted((r.table_name, r.geometry_type, r.srid, r.row_count) for r in profile.collect()) == [
        ("empty", None, None, 0), ("roads_1", "Point", 4326, 35),
    ]

    again = publisher.publish_incremental()
    assert {(r.order_id, r.status) for r in again.collect()} == {("one", "skipped"), ("two", "failed")}

    archive(root, "two", "c.zip", [("lakes.gpkg", "lakes", rows(1, 4), COLUMNS)])
    changed = publisher.publish_incremental()
    assert ("two", "lakes", 4, "ok") in report_rows(changed) and ("one", "Roads-1", 0, "skipped") in report_rows(changed)
    assert spark.table(f"{publisher.database}.lakes").count() == 4

    asked = publisher.publish_orders(["dem", "gone"])
    errors = {r.order_id: r.error for r in asked.collect()}
    assert errors == {"dem": "data type raster_dem cannot be published", "gone": "no such order"}

    shutil.rmtree(os.path.join(root, "two"))
    assert publisher.cleanup_stale() == ["lakes"] and publisher.cleanup_stale() == []
    assert not spark.catalog.tableExists(f"{publisher.database}.lakes")
    assert {r.order_id for r in publisher.ledger.read().collect()} == {"one"}


def test_broken_archive_publishes_nothing_of_its_order(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o1", "a.zip", [("lay.gpkg", "lay", rows(1, 3), COLUMNS)])
    archive(root, "o1", "b.zip", [("lay.gpkg", "lay", rows(4, 6), COLUMNS)])
    archive(root, "o2", "a.zip", [("other.gpkg", "other", rows(1, 2), COLUMNS)])
    publisher = make(spark, root, tmp_path)
    assert report_rows(publisher.publish_orders()) == [("o1", "lay", 9, "ok"), ("o2", "other", 2, "ok")]
    with open(os.path.join(root, "o1", "b.zip"), "r+b") as cut:
        cut.truncate(100)
    report = publisher.publish_orders()
    assert report_rows(report) == [("o1", "b", 0, "failed"), ("o1", "lay", 0, "failed"), ("o2", "other", 0, "skipped")]
    assert spark.table(f"{publisher.database}.lay").count() == 9
    assert "b.zip: cannot read" in next(r.error for r in report.collect() if r.layer_name == "b")


def test_second_run_reads_no_member(spark, root, tmp_path, monkeypatch):
    shutil.rmtree(os.path.join(root, "two"))
    publisher = make(spark, root, tmp_path)
    publisher.publish_orders()
    unpacked = []
    whole = archives.unpack

    def counted(members, staging):
        unpacked.append(members.filter("extension = '.gpkg'").count())
        return whole(members, staging)

    monkeypatch.setattr(archives, "unpack", counted)
    assert {r.status for r in publisher.publish_incremental().collect()} == {"skipped"}
    assert unpacked == [0]
    known = publisher.ledger.read()
    publisher.ledger.replace(known.withColumn("source_hash", F.when(F.col("layer_name") == "Empty", "old").otherwise(F.col("source_hash"))))
    assert report_rows(publisher.publish_incremental()) == [("one", "Empty", 0, "ok"), ("one", "Roads-1", 0, "skipped")]
    assert unpacked == [0, 3]


def test_attribute_names():
    names = ["srid", "Cell", "order_id", "a b", "A-B", "fid", "geom", "a_b", "srid_attr", "xmin"]
    assert archives.attribute_names(names) == ["srid_attr", "cell_attr", "order_id_attr", "a_b", "a_b_2", "fid_attr", "geom_attr", "a_b_3", "srid_attr_2", "xmin_attr"]


def test_attributes_named_like_storage_columns_keep_their_values(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    columns = [("srid", "INTEGER"), ("cell", "INTEGER"), ("xmin", "REAL"), ("order_id", "TEXT"), ("layer_name", "TEXT")]
    archive(root, "o", "a.zip", [("a.gpkg", "lay", [(1, blob(1, 2), 77, 88, -1.0, "x", "y")], columns)])
    publisher = make(spark, root, tmp_path)
    assert report_rows(publisher.publish_orders()) == [("o", "lay", 1, "ok")]
    row = spark.table(f"{publisher.database}.lay").first()
    assert (row.srid_attr, row.cell_attr, row.xmin_attr, row.order_id_attr, row.layer_name_attr, row.srid) == (77, 88, -1.0, "x", "y", 4326)


def test_two_orders_append_to_one_table(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o1", "a.zip", [("a.gpkg", "lay", rows(1, 3), COLUMNS)])
    archive(root, "o2", "a.zip", [("a.gpkg", "Lay", rows(1, 2), COLUMNS)])
    publisher = make(spark, root, tmp_path)
    report = publisher.publish_orders(layer_names=["LAY"], table_name="both", if_exists="append")
    assert report_rows(report) == [("o1", "lay", 3, "ok"), ("o2", "Lay", 2, "ok")]
    assert sorted(r.fid for r in spark.table(f"{publisher.database}.both").collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="there are: Lay, lay"):
        publisher.publish_orders(layer_names=["gone"])


def test_one_failing_layer_does_not_stop_the_rest(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o", "a.zip", [("a.gpkg", "mixed", rows(1, 2), COLUMNS)])
    archive(root, "o", "b.zip", [("b.gpkg", "mixed", [(1, blob(1, 2), 5)], [("other", "INTEGER")])])
    archive(root, "o", "c.zip", [("c.gpkg", "wrong", [(1, blob(1, 2), "word")], [("n", "INTEGER")])])
    archive(root, "o", "d.zip", [("d.gpkg", "fine", rows(1, 2), COLUMNS)])
    report = make(spark, root, tmp_path).publish_orders()
    assert report_rows(report) == [("o", "fine", 2, "ok"), ("o", "mixed", 0, "failed"), ("o", "wrong", 0, "failed")]


def test_selected_layers_and_labels(spark, root, tmp_path):
    publisher = make(spark, root, tmp_path)
    report = publisher.publish_orders(["one"], ["Roads-1"])
    assert report_rows(report) == [("one", "Roads-1", 35, "ok")]
    publisher.set_package_name("one", "A")
    publisher.set_package_name("one", "B")
    assert [tuple(r) for r in publisher.labels.read().collect()] == [("one", "B")]


def test_index_order_is_not_published(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o", "a.zip", [("a.gpkg", "a", rows(1, 2), COLUMNS)])
    with open(os.path.join(root, "o", "63_5"), "w") as out:
        out.write('[{"title": "S_650_60_0.laz", "href": "h", "length": 3}]')
    publisher = make(spark, root, tmp_path)
    types = publisher.types(publisher.members()).first()
    assert (types.data_type, types.tiles, types.is_publishable) == ("lidar_index", 1, False)
    assert publisher.publish_orders().count() == 0


# --- streams -------------------------------------------------------------------------


SCHEMA = "announcement_id bigint, AdvertisedTrainIdent string, LocationSignature string, Operator string, FromLocation array<struct<LocationName:string>>, ToLocation array<struct<LocationName:string>>, TimeAtLocation timestamp, AdvertisedTimeAtLocation timestamp"


def announce(spark, path, rows):
    df = spark.createDataFrame(rows, "announcement_id bigint, AdvertisedTrainIdent string, t string")
    df.selectExpr("announcement_id", "AdvertisedTrainIdent", "'G' AS LocationSignature", "cast(t AS timestamp) AS TimeAtLocation").coalesce(1).write.mode("append").json(path)


def test_trains_over_several_batches(spark, tmp_path):
    path, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    stations = spark.createDataFrame([("G", "Town", 12.0, 57.0)], "signature string, name string, lon double, lat double")
    announce(spark, path, [(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 10:01:00")])

    def turn():
        arriving = spark.readStream.schema(SCHEMA).json(path)
        started, table = live.live_trains(arriving, stations, out, state, available_now=True)
        started.awaitTermination()
        return {r.train: r.announcement_id for r in table.read().collect()}, table

    assert turn()[0] == {"a": 1, "b": 2}
    announce(spark, path, [(3, "a", "2024-01-01 10:20:00"), (4, "b", "2024-01-01 10:00:30"), (5, "a", "2024-01-01 10:20:00")])
    assert turn()[0] == {"a": 3, "b": 2}
    announce(spark, path, [(6, "c", "2024-01-01 09:00:00")])  # older than the watermark
    got, table = turn()
    assert got == {"a": 3, "b": 2}
    now = F.lit("2024-01-01 10:16:00").cast("timestamp")
    assert {r.train for r in live.current_trains(table, now).collect()} == {"a"}


def test_horizon(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = [("11:45:00", False), ("11:45:01", True), ("12:04:59", True), ("12:05:00", False)]
    df = spark.createDataFrame([(f"2024-01-01 {t}",) for t, _ in rows], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r[0] for r in df.select(feeds.in_horizon(F.col("t"), now)).collect()] == [k for _, k in rows]


def test_delivery_watch_publishes_only_what_arrived(spark, root, tmp_path):
    publisher = make(spark, root, tmp_path)
    state = str(tmp_path / "state")
    live.watch_deliveries(publisher, state, available_now=True).awaitTermination()
    assert {r.layer_name for r in publisher.ledger.read().collect()} == {"Empty", "Roads-1"}
    archive(root, "three", "z.zip", [("z.gpkg", "zoo", rows(1, 2), COLUMNS)])
    live.watch_deliveries(publisher, state, available_now=True).awaitTermination()
    last = spark.read.parquet(publisher.reports).filter("layer_name = 'zoo'")
    assert [(r.order_id, r.status) for r in last.collect()] == [("three", "ok")]


def test_update_watch_sends_each_change_once(spark, tmp_path):
    path, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = "order_id string, title string, updated string, seen_at timestamp"

    def snapshot(rows, day):
        df = spark.createDataFrame(rows, "order_id string, title string, updated string")
        df.withColumn("seen_at", F.lit(f"2024-01-{day:02d}").cast("timestamp")).coalesce(1).write.mode("append").json(path)

    def turn():
        arriving = spark.readStream.schema(schema).json(path)
        live.watch_updates(arriving, out, state, available_now=True).awaitTermination()
        return sorted((r.title, r.updated or "") for r in live.sent_updates(spark, out).collect())

    snapshot([("o", "a", "1"), ("o", "a", "1"), ("o", "b", None)], 1)
    assert turn() == [("a", "1"), ("b", "")]
    snapshot([("o", "a", "1"), ("o", "b", "2")], 2)
    assert turn() == [("a", "1"), ("b", ""), ("b", "2")]
    for day in (9, 31):  # long unchanged
        snapshot([("o", "a", "1")], day)
        assert turn() == [("a", "1"), ("b", ""), ("b", "2")]
    snapshot([("o", "c", "1")], 3)  # late
    assert turn() == [("a", "1"), ("b", ""), ("b", "2"), ("c", "1")]
