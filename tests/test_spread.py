"""Few rows that stand for much work are dealt out to all tasks, and pairs cost no more than they must."""

from __future__ import annotations

import pickle
import zipfile

from pyspark.sql import functions as F

from cairngeo import schemas
from cairngeo.functions import geometry as G
from cairngeo.operators import spatial
from cairngeo.sources import archives, deliveries, gpkg
from test_crowded import boxes, cluster, meeting
from test_publish import COLUMNS, archive, rows


def test_plain_sides_are_met_without_geometries(spark):
    a, b = cluster(3, 300, (0, 0), (40, 40)), cluster(4, 200, (0, 0), (2, 2))
    left, right = boxes(spark, a), boxes(spark, b)
    found = spatial.candidates(left, right)
    assert found and all(c not in pairs.columns for pairs in found for c in ("left_geom", "right_geom"))
    joined = spatial.spatial_join(left, right)
    assert sorted(tuple(r) for r in joined.collect()) == meeting(a, b)


def test_prepared_rows_are_shared_by_all_tasks(spark, monkeypatch):
    seen, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    spatial.candidates(boxes(spark, cluster(5, 60, (0, 0), (40, 40))).coalesce(1), boxes(spark, cluster(6, 60, (0, 0), (0, 0))).coalesce(1))
    assert all(df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for df in seen[:2])


SHAPES = {
    "diamond": [(0, -4), (4, 0), (0, 4), (-4, 0)],
    "clockwise": [(0, 4), (4, 0), (0, -4), (-4, 0)],
    "triangle": [(-3, -3), (5, -2), (0, 4)],
    "hexagon": [(2, 0), (1, 2), (-1, 2), (-2, 0), (-1, -2), (1, -2)],
    "dented": [(0, -4), (4, 0), (0, 4), (3, 0)],
    "bow": [(0, 0), (4, 4), (4, 0), (0, 4)],
    "twice": [(0, -4), (4, 0), (0, 4), (0, -4), (4, 0), (0, 4)],
    "star": [(0, 4), (2, -3), (-4, 1), (4, 1), (-2, -3)],
    "flat": [(0, 0), (2, 2), (4, 4)],
}


def test_certain_answers_for_convex_shapes_are_the_exact_ones(spark):
    shapes = spark.createDataFrame([(n, [[float(c) for c in v] for v in [*s, s[0]]]) for n, s in SHAPES.items()], "name string, ring array<array<double>>")
    ring = F.transform("ring", lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))
    shapes = shapes.withColumn("g", G.geometry("Polygon", F.array(ring))).withColumn("edges", F.expr(G.convex_edges_sql("g")))
    at = spark.range(-11, 12).selectExpr("id / 2.0D AS v")
    spots = at.selectExpr("v AS xmin").crossJoin(at.selectExpr("v AS ymin")).crossJoin(spark.createDataFrame([(0.0, 0.0), (0.5, 3.0), (2.0, 1.0)], "w double, h double"))
    box = {c: c for c in ("xmin", "ymin", "xmax", "ymax")}
    pairs = shapes.crossJoin(spots.selectExpr("*", "xmin + w AS xmax", "ymin + h AS ymax")).withColumns({f"g_{k}": v for k, v in G.envelope("g").items()})
    pairs = pairs.filter(G.boxes_overlap_sql(box, {c: f"g_{c}" for c in box}))
    told = pairs.selectExpr("name", f"{G.meets_convex_sql('edges', box)} AS quick", f"{G.intersects_box_sql('g', box)} AS exact").collect()
    assert all(r.quick is None or r.quick == r.exact for r in told)
    known = {n: sum(r.quick is not None for r in told if r.name == n) / sum(r.name == n for r in told) for n in SHAPES}
    assert all((known[n] > 0.6) == (n in ("diamond", "clockwise", "triangle")) for n in SHAPES), known


def test_archives_are_listed_by_all_tasks(spark, tmp_path):
    for k in range(60):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w") as out:
            out.writestr("x.gpkg", "x")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    files = spark.createDataFrame([("o", f"{tmp_path}/{n}.zip", f"{n}.zip") for n in [*(f"a{k}" for k in range(60)), "bad"]], "order_id string, path string, file_name string")
    members = archives.zip_members(files)
    assert members.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = members.collect()
    assert sorted((r.zip_name, r.entry) for r in found if r.error is None) == sorted((f"a{k}.zip", 0) for k in range(60))
    assert [r.zip_name for r in found if r.error] == ["bad.zip"]


def _feature(name, coordinates, objects="3"):
    shape = f'"geometry": {{"type": "Polygon", "coordinates": {coordinates}}}'
    return f'{{"properties": {{"filnamn": "{name}", "statistik": [{{"tabellnamn": "t", "antalObjekt": {objects}}}]}}, {shape}}}'


def test_delivery_documents_of_all_kinds_read_as_before(spark, tmp_path):
    def document(*features):
        return f'{{"features": [{", ".join(features)}]}}'

    ring = "[[[1e3, 2.50], [3, 4.000000000000000001], [5.0E0, -0.0]]]"
    plain = document(_feature("a", ring), _feature("å", "[]"), _feature("c", "[1, 2]"), _feature("c", ring, '"few"'))
    texts = {
        "plain": plain.encode(),
        "bom": b"\xef\xbb\xbf" + plain.encode(),
        "utf16": plain.encode("utf-16"),
        "utf16be": plain.encode("utf-16-be"),
        "utf16le": plain.encode("utf-16-le"),
        "many": f" \n[{plain}, {document(_feature('d', ring))}]".encode(),
        "cut": plain[:60].encode(),
        "latin": plain.encode("latin-1"),
        "empty": b"",
        "rest": (plain + " x").encode(),
        "null": b"null",
        "_under": plain.encode(),
    }
    for name, content in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "uttag.json").write_bytes(content)
    old = deliveries._json(spark, str(tmp_path), "uttag.json", schemas.DELIVERY_STATS)
    new = deliveries._documents(spark, str(tmp_path), "uttag.json", schemas.DELIVERY_STATS)
    exploded = [df.select("_order", F.posexplode("features").alias("pos", "f")) for df in (old, new)]
    rings = F.from_json("f.geometry.coordinates", schemas.RINGS).alias("rings")
    told = [df.select("_order", "pos", "f.properties", "f.geometry.type", rings).collect() for df in exploded]
    wide = ("utf16", "utf16be", "utf16le")  # the old reader cut their coordinates at wrong places and lost them
    known = [sorted(str(r) for r in rows_of if r._order not in wide) for rows_of in told]
    assert known[0] == known[1] and {r._order for r in told[1]} >= {"plain", "bom", "many", "_under"}
    assert all(sorted(str(r[1:]) for r in told[1] if r._order == n) == sorted(str(r[1:]) for r in told[1] if r._order == "plain") for n in wide)
    read = deliveries.read_delivery_stats(spark, str(tmp_path))
    assert "FileScan json" not in read._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_the_data_source_carry_their_own_files_only(spark):
    files = [{"order_id": "o", "zip_name": f"z{k}", "inner_path": "m", "feature_count": 75, "columns": []} for k in range(3000)]
    reader = gpkg.GeoPackageReader(files, None, 40, 100)
    tasks = reader.partitions()
    assert len(tasks) == 100 and sum(len(t.ranges) for t in tasks) == 6000
    assert [r[0]["zip_name"] for t in tasks for r in t.ranges] == [f"z{k // 2}" for k in range(6000)]
    assert len(pickle.dumps(reader)) < 2000 and len(reader.files) == 3000


def test_ranges_of_one_task_read_all_rows_once(spark, tmp_path):
    for name, first, count in (("a.zip", 10, 30), ("b.zip", 1, 5)):
        archive(str(tmp_path / "in"), "one", name, [("x/roads.gpkg", "Roads-1", rows(first, count), COLUMNS)])
    folder = str(tmp_path / "catalogue")
    archives.catalogue(archives.zip_members(deliveries.scan_orders(spark, str(tmp_path / "in")))).write.parquet(folder)
    gpkg.register(spark)
    read = spark.read.format("gpkg").options(layer="Roads-1", rowsPerTask=4, mostTasks=3).load(folder)
    assert read.rdd.getNumPartitions() == 3
    assert sorted(r.source_row for r in read.collect()) == sorted([*range(10, 40), *range(1, 6)])
    assert sorted(r.source_row for r in read.filter("source_row > 12 AND source_row < 30").collect()) == [*range(13, 30)]
