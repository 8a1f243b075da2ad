"""Layer filters, pages, spatial join and tiles."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cairngeo.functions import cells, crs
from cairngeo.functions import geometry as G
from cairngeo.operators import export, filters, layers, publish, readonly, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "fid bigint, xmin double, ymin double, xmax double, ymax double")
    return df.withColumn("geom", G.box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def triangles(spark, seed, count, size):
    rng = random.Random(seed)
    rows = []
    for fid in range(count):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
        s = rng.choice(size)
        rows.append((fid, x, y, x + rng.uniform(-s, s), y + rng.uniform(-s, s), x + rng.uniform(-s, s), y + rng.uniform(-s, s)))
    df = spark.createDataFrame(rows, "fid bigint, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    shape = G.polygon(*[(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(3)])
    return layers.with_envelope(df.withColumn("geom", shape)), rows


def triangles_meet(a, b):
    """Separating axes: two triangles are apart if an edge of one parts them."""
    pa, pb = [[(t[1 + 2 * i], t[2 + 2 * i]) for i in range(3)] for t in (a, b)]
    for shape in (pa, pb):
        for i in range(3):
            (x0, y0), (x1, y1) = shape[i], shape[(i + 1) % 3]
            nx, ny = y1 - y0, x0 - x1
            sa, sb = [x * nx + y * ny for x, y in pa], [x * nx + y * ny for x, y in pb]
            if max(sa) < min(sb) or max(sb) < min(sa):
                return False
    return True


@pytest.mark.parametrize("sizes", [((5, 30), (5, 30)), ((1,), (200, 400)), ((300, 2), (3, 150))])
def test_join_equals_brute_force(spark, sizes):
    a, rows_a = triangles(spark, 1, 120, sizes[0])
    b, rows_b = triangles(spark, 2, 120, sizes[1])
    want = sorted((s[0], t[0]) for s in rows_a for t in rows_b if triangles_meet(s, t))
    got = [tuple(r) for r in spatial.spatial_join(a, b, width=4.0).collect()]
    assert len(got) == len(set(got)) and sorted(got) == want and want


def test_join_with_a_hot_cell(spark):
    # a third of the points on one spot, which many boxes cover
    points = [(i, 500.5, 500.5, 500.5, 500.5) for i in range(1000)] + [
        (1000 + i, float(i % 50) * 20, float(i // 50) * 20, float(i % 50) * 20, float(i // 50) * 20) for i in range(2000)
    ]
    areas = [(i, 500.0 - i, 500.0 - i, 501.0 + i, 501.0 + i) for i in range(20)]
    df = spark.createDataFrame(points, "fid bigint, xmin double, ymin double, xmax double, ymax double")
    left = df.withColumn("geom", G.point(F.col("xmin"), F.col("ymin")))
    joined = spatial.spatial_join(left, boxes(spark, areas), width=1.0)
    want = sum(p[1] >= b[1] and p[1] <= b[3] and p[2] >= b[2] and p[2] <= b[4] for p in points for b in areas)
    assert joined.count() == want == joined.distinct().count()
    plan = plan_of(joined)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(("a_size", "b_size"), [((5, 30), (5, 30)), ((300, 2), (3, 150))])
def test_crowded_cells_do_not_change_the_result(spark, a_size, b_size):
    a, rows_a = triangles(spark, 3, 150, a_size)
    b, rows_b = triangles(spark, 4, 150, b_size)
    want = sorted((s[0], t[0]) for s in rows_a for t in rows_b if triangles_meet(s, t))
    joined = spatial.spatial_join(a, b, width=64.0)
    assert "SortMergeJoin" in plan_of(joined) and "Broadcast" not in plan_of(joined)
    assert sorted(tuple(r) for r in joined.collect()) == want and want


def test_join_with_an_empty_side(spark):
    some = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    assert spatial.spatial_join(some, some.filter("fid > 1")).count() == 0


def test_shared_edges_and_corners_meet(spark):
    a = boxes(spark, [(1, 0.0, 0.0, 64.0, 64.0)])
    b = boxes(spark, [(1, 64.0, 0.0, 128.0, 64.0), (2, 64.0, 64.0, 65.0, 65.0), (3, 64.5, 0.0, 65.0, 1.0)])
    assert sorted(r.right_key for r in spatial.spatial_join(a, b).collect()) == [1, 2]


def test_box_text_errors():
    assert layers.parse_box("1,2, 3,4.5") == (1.0, 2.0, 3.0, 4.5)
    for bad in ("1,2,3", "a,b,c,d", "", "1,2,3,4,5"):
        with pytest.raises(ValueError):
            layers.parse_box(bad)


def test_page_bounds(spark):
    df = boxes(spark, [(i, 0.0, 0.0, 1.0, 1.0) for i in range(5)])
    assert [r.fid for r in layers.page(df, 2, 3).collect()] == [3, 4]
    assert [r.fid for r in layers.page_after(df, 2).collect()] == [3, 4]
    for limit, offset in ((0, 0), (10001, 0), (1, -1)):
        with pytest.raises(ValueError):
            layers.page(df, limit, offset)
    assert "TakeOrderedAndProject" in plan_of(layers.page(df, 2, 3))


def test_attribute_operators(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, None)], "n int, t string")
    for op, value, want in (("=", "2", [2]), ("!=", "2", [1, 3]), (">=", "2", [2, 3]), ("<", "2", [1])):
        assert [r.n for r in layers.attr_filter(df, "n", op, value).collect()] == want
    assert [r.n for r in layers.attr_filter(df, "t", ">", "10").collect()] == [2]  # as text
    assert [r.n for r in layers.attr_filter(df, "n", "contains", "1").collect()] == [1]
    with pytest.raises(ValueError):
        layers.attr_filter(df, "n", "~", "1")


def test_filter_graph_with_two_orders_and_a_blank_filter(spark):
    def edges(*nodes):
        return {"input_1": {"connections": [{"node": n} for n in nodes]}}

    nodes = {
        "1": {"name": "OrderNode", "data": {"orderId": "a"}, "inputs": {}},
        "2": {"name": "OrderNode", "data": {"orderId": "b"}, "inputs": {}},
        "3": {"name": "FilterNode", "data": {"field": "", "operator": "=", "value": ""}, "inputs": edges("1", "2")},
        "4": {"name": "FilterNode", "data": {"field": "n", "operator": ">", "value": "1"}, "inputs": edges("3")},
        "5": {"name": "DatabaseNode", "data": {"connectionName": "out"}, "inputs": edges("4")},
        "6": {"name": "DatabaseNode", "data": {}, "inputs": edges("2")},
    }
    tables = {"a": spark.createDataFrame([(1,), (2,)], "n int"), "b": spark.createDataFrame([(3,)], "n int")}
    got = filters.compile_graph({"drawflow": {"Home": {"data": nodes}}}, tables.__getitem__)
    assert sorted(r.n for r in got["out"].collect()) == [2, 3] and got["6"].count() == 1
    nodes["3"]["inputs"] = edges("4")
    with pytest.raises(ValueError):
        filters.compile_graph(json.dumps({"drawflow": {"Home": {"data": nodes}}}), tables.__getitem__)


def test_readonly_guard_and_cap(spark):
    for bad in ("DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH a AS (SELECT 1) SELECT * FROM a", "select 'update'"):
        with pytest.raises(readonly.NotReadOnly):
            readonly.check(bad)
    for bad in (
        "SELECT reflect('java.lang.System', 'nanoTime')",
        "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime')))",
        "SELECT `reflect`('java.lang.System', 'nanoTime')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT id FROM range(3) WHERE id IN (SELECT value FROM text.`/etc/hostname`)",
        "SELECT TRANSFORM(id) USING 'cat' AS (y) FROM range(3)",
    ):
        with pytest.raises(readonly.NotReadOnly):
            readonly.readonly_sql(spark, bad)
        with pytest.raises(readonly.NotReadOnly):
            readonly.run(spark, bad)
    spark.range(7).createOrReplaceTempView("mine")
    given = readonly.readonly_sql(spark, "SELECT count(*) AS n FROM mine", {"mine": spark.range(2)})
    assert given.rows.first().n == 2 and spark.table("mine").count() == 7
    exact = readonly.readonly_sql(spark, "SELECT id FROM range(1000)")
    assert exact.rows.count() == 1000 and not exact.truncated()
    more = readonly.readonly_sql(spark, "select id from range(1001)")
    assert more.rows.count() == 1000 and more.truncated()
    rows, truncated = readonly.run(spark, "SELECT id, cast('x' AS binary) AS b, timestamp_ntz'2024-01-02 03:04:05' AS t FROM range(3)", max_rows=2)
    assert truncated and [tuple(r) for r in rows] == [(i, "<binary>", "2024-01-02T03:04:05") for i in range(2)]


def test_readonly_timeout(spark):
    spark.udf.register("nap", lambda i: __import__("time").sleep(3) or i, "bigint")
    with pytest.raises(Exception, match="(?i)cancel"):
        readonly.run(spark, "SELECT nap(id) FROM range(0, 40, 1, 1)", timeout=2.0)


def test_preview_and_sample(spark):
    df = spark.createDataFrame([(1, "x" * 80, None, [1, 2])], "a int, b string, c double, d array<int>")
    assert tuple(layers.preview(df).first()) == ("1", "x" * 50, "NULL", "[1,2]")
    assert layers.sample(df).first().row_json.startswith('{"a":1,')


def test_published_layer_prunes_and_skips(spark):
    publish.create_database(spark, "prune_db")
    rows = [(i, float(i % 100) * 1000 + 300000, float(i // 100) * 1000 + 6500000) for i in range(10000)]
    df = spark.createDataFrame(rows, "source bigint, x double, y double").withColumn("geom", G.point(F.col("x"), F.col("y")))
    stats = publish.publish_layer(
        df.select("source", "geom"), "grid", "prune_db", crs.SWEREF, ["source"], target_srid=crs.SWEREF
    ).first()
    assert stats.feature_count == 10000
    assert stats.bbox == "POLYGON((300000.0 6500000.0, 300000.0 6599000.0, 399000.0 6599000.0, 399000.0 6500000.0, 300000.0 6500000.0))"
    table = spark.table("prune_db.grid")
    found = layers.bbox_filter(table, "310000,6510000,312000,6511000").select("fid")
    plan = plan_of(found)
    assert found.count() == 6
    pushed = plan.split("PushedFilters")[1]
    assert "LessThanOrEqual(xmin,312000" in pushed or "LessThanOrEqual(xmin,312000" in plan
    assert "geom" not in plan.split("ReadSchema")[1]
    in_order = table.select("cell", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file = {}
    for r in sorted(in_order, key=lambda r: r.i):
        by_file.setdefault(r.f, []).append(r.cell)
    assert all(c == sorted(c) for c in by_file.values())
    with pytest.raises(ValueError):
        publish.publish_layer(df.select("source", "geom"), "grid", "prune_db", crs.SWEREF, ["source"], if_exists="fail")
    with pytest.raises(ValueError):
        publish.publish_layer(df, "grid", "prune_db", crs.SWEREF, ["source"], if_exists="merge")


def test_serial_numbers_with_a_hot_leading_value(spark):
    rows = [(1 if i % 3 else i, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "lead bigint, k bigint").repartition(7)
    got = {r.k: r.fid for r in publish.assign_fids(df, ["lead", "k"]).collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted(rows), 1)}


def test_cells_interleave(spark):
    df = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (0.0, -90.0), (-180.0, 0.0)], "x double, y double")
    got = [r[0] for r in df.select(cells.cell(F.col("x"), F.col("y"), 4326)).collect()]
    assert got == [0, 2**32 - 1, 1 << 30, 1 << 31]


def test_feature_collection_of_no_rows(spark):
    df = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    found = df.filter("fid > 1")
    shown = json.loads(export.feature_collection(found, 100).first().value)
    assert shown == {"type": "FeatureCollection", "features": [], "total_count": 0}
    one = json.loads(export.to_geojson(df.withColumn("note", F.lit(None).cast("string"))).first().value)
    assert one["id"] == 1 and one["properties"] == {"fid": 1, "note": None}


def test_wide_feature_fills_its_tiles(spark):
    df = boxes(spark, [(1, -10.0, -10.0, 10.0, 10.0), (2, -10.0, -10.0, 10.0, 10.0)])
    got = spatial.tile_pyramid(df, F.lit("a"), max_zoom=2).collect()
    assert {(r.z, r.x, r.y): r.features for r in got} == {
        (0, 0, 0): 2, **{(1, x, y): 2 for x in (0, 1) for y in (0, 1)}, **{(2, x, y): 2 for x in (1, 2) for y in (1, 2)},
    }
