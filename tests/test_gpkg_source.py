"""The gpkg data source beside the unpacking reader."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cairngeo.sources import archives, gpkg
from cairngeo.sources import deliveries as readers

from test_publish import COLUMNS, archive, blob, rows

ODD = [("n", "INTEGER"), ("r", "REAL"), ("t", "TEXT"), ("b", "BLOB"), ("d", "NUMERIC"), ("ok", "BOOLEAN")]
ODD_ROWS = [
    (1, blob(1.0, 2.0), 7, 1, "x", b"y", 3, 1),
    (5, None, None, None, None, None, None, None),
    (6, blob(3.0, 4.0)[8:], "12", "2.5", 4, "text", "1.25", 0),
    (9, blob(5.0, 6.0), 3.9, 1e20, 1.5e9, 12, 0.1, "yes"),
    (11, blob(5.0, 6.0), -2, -0.0, 2.5e-7, 1.5, -7, ""),
]


@pytest.fixture()
def landed(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "one", "a.zip", [("x/roads.gpkg", "Roads-1", rows(10, 30), COLUMNS), ("odd.gpkg", "odd", ODD_ROWS, ODD)])
    archive(root, "one", "b.zip", [("roads.gpkg", "Roads-1", rows(1, 5), COLUMNS), ("empty.gpkg", "Empty", [], COLUMNS)])
    archive(root, "two", "c.zip", [("roads.gpkg", "Roads-1", rows(100, 7), COLUMNS)], [("bad.gpkg", b"no database")])
    members = archives.zip_members(readers.scan_orders(spark, root)).cache()
    folder = str(tmp_path / "catalogue")
    archives.catalogue(members).write.parquet(folder)
    gpkg.register(spark)
    yield members, folder, str(tmp_path / "staged")
    members.unpersist()


def load(spark, folder, layer, **options):
    return spark.read.format("gpkg").option("layer", layer).options(**options).load(folder)


def test_catalogue_equals_that_of_unpacked_members(spark, landed):
    members, folder, staged = landed
    unpacked = archives.source_layers(archives.unpack(members, staged))
    names = unpacked.columns
    assert sorted(map(str, spark.read.parquet(folder).select(*names).collect())) == sorted(map(str, unpacked.collect()))


@pytest.mark.parametrize("layer", ["Roads-1", "odd"])
def test_rows_equal_those_of_the_unpacking_reader(spark, landed, layer):
    members, folder, staged = landed
    read = load(spark, folder, layer, rowsPerTask=4)
    unpacked = archives.unpack(members, staged).filter(F.col("layer_name") == layer)
    plain = archives.read_layer(unpacked, archives.source_layers(unpacked).first().columns)
    names = [c for c in read.columns if c != "srid"]
    assert sorted(map(str, read.select(*names).collect())) == sorted(map(str, plain.select(*names).collect()))
    assert {r.srid for r in read.select("srid").collect()} == {3006}


def test_ranges_filters_and_errors(spark, landed):
    _, folder, _ = landed
    read = load(spark, folder, "Roads-1", rowsPerTask=10)
    assert read.rdd.getNumPartitions() == 5 and read.count() == 42
    few = read.filter("order_id = 'one' AND zip_name IN ('b.zip', 'c.zip')")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 5
    ranged = read.filter("source_row > 12 AND source_row <= 101 AND name <> 'name 20'")
    assert sorted(r.source_row for r in ranged.collect()) == [*range(13, 20), *range(21, 40), 100, 101]
    assert load(spark, folder, "Empty").count() == 0
    for options, told in (({"layer": "gone"}, "no layer gone"), ({}, "option layer")):
        with pytest.raises(Exception, match=told):
            spark.read.format("gpkg").options(**options).load(folder)


def test_a_value_that_does_not_fit_is_an_error(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o", "a.zip", [("a.gpkg", "wrong", [(1, blob(1, 2), "word")], [("n", "INTEGER")])])
    archive(root, "o", "b.zip", [("a.gpkg", "mixed", [(1, blob(1, 2), 1)], [("n", "INTEGER")])])
    archive(root, "o", "c.zip", [("a.gpkg", "mixed", [(1, blob(1, 2), 1)], [("m", "INTEGER")])])
    folder = str(tmp_path / "catalogue")
    archives.catalogue(archives.zip_members(readers.scan_orders(spark, root))).write.parquet(folder)
    gpkg.register(spark)
    with pytest.raises(Exception, match="word"):
        load(spark, folder, "wrong").collect()
    with pytest.raises(Exception, match="differ in columns"):
        load(spark, folder, "mixed")
