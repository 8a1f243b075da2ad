"""Loads of a table, the entry log and layout cells."""

from __future__ import annotations

import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from cairngeo.functions import cells, crs
from cairngeo.functions import geometry as G
from cairngeo.operators import layers, points, publish
from cairngeo.operators.entrylog import EntryLog
from cairngeo.sources import archives, files
from cairngeo.sources import deliveries as readers
from cairngeo.sources import feeds as feed_readers

from test_publish import COLUMNS, archive, blob, make, report_rows, rows

# --- loads ------------------------------------------------------------------------------


def some_points(spark, first, count, label):
    df = spark.range(first, first + count).select(F.col("id").alias("source_fid"), F.lit(label).alias("label"))
    return df.withColumn("geom", G.point(F.col("source_fid") * 10.0 + 400000.0, F.lit(6500000.0)))


@pytest.fixture()
def database(spark, tmp_path):
    name = "loads_" + tmp_path.name.replace("-", "_")
    publish.create_database(spark, name, str(tmp_path / "db"))
    return name


def load(spark, database, first, count, label, mode="append", **options):
    return publish.publish_layer(some_points(spark, first, count, label), "t", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, if_exists=mode, **options).first()


def held(spark, database):
    found = spark.table(f"{database}.t").groupBy("_source_order", "label").agg(F.count("*"), F.min("fid"), F.max("fid"))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_a_load_replaces_its_own_rows(spark, database):
    assert load(spark, database, 0, 5, "a", order_id="o1").feature_count == 5
    load(spark, database, 0, 7, "b", order_id="o2")
    load(spark, database, 0, 2, "c", order_id="o2", layer_name="other")
    assert held(spark, database) == [("o1", "a", 5, 1, 5), ("o2", "b", 7, 6, 12), ("o2", "c", 2, 13, 14)]
    again = load(spark, database, 3, 4, "b2", order_id="o2")
    assert (again.feature_count, again.minx, again.maxx) == (4, 400030.0, 400060.0)
    assert held(spark, database) == [("o1", "a", 5, 1, 5), ("o2", "b2", 4, 15, 18), ("o2", "c", 2, 13, 14)]
    profile = layers.published_profile(spark, database).first()
    assert (profile.table_name, profile.row_count, profile.geometry_type, profile.columns) == (
        "t", 11, "Point", "fid:bigint, source_fid:bigint, label:string, _source_order:string, _loaded_at:timestamp",
    )
    publish.drop_load(spark, database, "t", publish.load_key("o2", "other"))
    assert held(spark, database) == [("o1", "a", 5, 1, 5), ("o2", "b2", 4, 15, 18)]
    assert layers.published_profile(spark, database).first().row_count == 9
    load(spark, database, 0, 1, "d")
    load(spark, database, 0, 1, "d")  # loads without an order add up
    assert (None, "d", 2, 19, 20) in held(spark, database)
    load(spark, database, 0, 3, "e", "replace", order_id="o9's \\ 1")
    load(spark, database, 0, 2, "f", order_id="o9's \\ 1")
    assert held(spark, database) == [("o9's \\ 1", "f", 2, 4, 5)]


def test_an_append_keeps_to_the_table(spark, database):
    load(spark, database, 0, 3, "a", order_id="o1")
    with pytest.raises(ValueError, match="system 3006"):
        publish.publish_layer(some_points(spark, 0, 1, "b"), "t", database, crs.SWEREF, ["source_fid"], if_exists="append", order_id="o2")
    with pytest.raises(Exception, match="label"):
        publish.publish_layer(some_points(spark, 0, 1, "b").drop("label"), "t", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, if_exists="append", order_id="o2")
    wide = some_points(spark, 0, 1, "b").withColumns({"source_fid": F.col("source_fid").cast("int"), "more": F.lit(1)})
    publish.publish_layer(wide, "t", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, if_exists="append", order_id="o2")
    assert held(spark, database) == [("o1", "a", 3, 1, 3), ("o2", "b", 1, 4, 4)]


@pytest.mark.parametrize("lost_in", ["_write_laid_out", "_point_at", "_set_facts"])
def test_a_lost_append_is_repeated_without_double_rows(spark, database, monkeypatch, lost_in):
    load(spark, database, 0, 3, "a", order_id="o1")
    load(spark, database, 0, 4, "b", order_id="o2")
    whole, calls = getattr(publish, lost_in), []

    def lost(*args):
        calls.append(1)
        if lost_in != "_set_facts" or len(calls) > 1:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(publish, lost_in, lost)
    with pytest.raises(RuntimeError):
        load(spark, database, 0, 2, "b2", order_id="o2")
    monkeypatch.undo()
    before = held(spark, database)
    assert before[0] == ("o1", "a", 3, 1, 3) and len(before) == 2  # old rows or new ones, never both or none
    load(spark, database, 0, 2, "b2", order_id="o2")
    one, two = held(spark, database)
    assert one == ("o1", "a", 3, 1, 3) and two[:3] == ("o2", "b2", 2) and two[3] > 7
    assert layers.published_profile(spark, database).first().row_count == 5


def test_a_replacement_that_is_lost_leaves_the_old_table_or_the_new(spark, database, monkeypatch):
    load(spark, database, 0, 3, "a", order_id="o1")
    other = some_points(spark, 0, 2, "b").withColumn("more", F.lit(1))

    def replace():
        publish.publish_layer(other, "t", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, order_id="o1")

    finish, calls = publish._finish_swap, []
    monkeypatch.setattr(publish, "_swap_in", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        replace()
    assert held(spark, database) == [("o1", "a", 3, 1, 3)]
    monkeypatch.undo()

    def lost(*args):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("lost")
        return finish(*args)

    monkeypatch.setattr(publish, "_finish_swap", lost)
    with pytest.raises(RuntimeError):
        replace()
    monkeypatch.undo()
    assert not spark.catalog.tableExists(f"{database}.t")
    publish._finish_swap(spark, database, "t")  # what the next run begins with
    assert held(spark, database) == [("o1", "b", 2, 1, 2)] and "more" in spark.table(f"{database}.t").columns
    replace()
    assert sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary) == ["t"]


def test_folders_out_of_use_go_later(spark, database, monkeypatch):
    home = spark.catalog.getDatabase(database).locationUri + "/t"
    for label in "abc":
        load(spark, database, 0, 3, label, order_id="o1")
    there = [n for n in files.children(spark, home) if n.startswith("load-")]
    assert len(there) == 3
    monkeypatch.setattr(publish, "KEPT_SECONDS", -1)
    load(spark, database, 0, 3, "d", order_id="o1")
    left = [n for n in files.children(spark, home) if n.startswith(("load-", ".idle-load-"))]
    assert len([n for n in left if n.startswith("load-")]) <= 2 and held(spark, database)[0][:3] == ("o1", "d", 3)


def test_an_order_that_comes_again_is_not_loaded_twice(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    os.makedirs(root)
    archive(root, "o1", "a.zip", [("a.gpkg", "lay", rows(1, 3), COLUMNS)])
    archive(root, "o2", "a.zip", [("a.gpkg", "lay", rows(1, 2), COLUMNS), ("b.gpkg", "more", rows(20, 2), COLUMNS)])
    publisher = make(spark, root, tmp_path)

    def run():
        return report_rows(publisher.publish_orders(table_name="all", if_exists="append"))

    def there():
        return sorted((r["_source_order"], r.n) for r in spark.table(f"{publisher.database}.all").collect())

    # lost between the table and the ledger entry
    enter, lost = publisher.ledger.upsert, []

    def upsert(new):
        if not lost:
            lost.append(new.first().order_id)
            raise RuntimeError("lost")
        return enter(new)

    monkeypatch.setattr(publisher.ledger, "upsert", upsert)
    assert {r[3] for r in run()} == {"failed"}  # the three were published together
    monkeypatch.undo()
    assert {(r[0], r[1], r[3]) for r in run()} >= {(lost[0], "lay", "ok")}
    want = [("o1", 1), ("o1", 2), ("o1", 3), ("o2", 1), ("o2", 2), ("o2", 20), ("o2", 21)]
    assert there() == want
    assert {r[3] for r in run()} == {"skipped"} and there() == want

    archive(root, "o2", "a.zip", [("a.gpkg", "lay", rows(7, 1), COLUMNS), ("b.gpkg", "more", rows(20, 2), COLUMNS)])
    run()
    assert there() == [("o1", 1), ("o1", 2), ("o1", 3), ("o2", 7), ("o2", 20), ("o2", 21)]
    shutil.rmtree(os.path.join(root, "o1"))
    assert publisher.cleanup_stale() == ["all"]
    assert there() == [("o2", 7), ("o2", 20), ("o2", 21)]
    assert {r.order_id for r in publisher.ledger.read().collect()} == {"o2"}


def test_many_small_layers_need_a_handful_of_jobs(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    other = [("Word", "TEXT")]
    for k in range(12):
        archive(root, f"o{k:02d}", "a.zip", [("a.gpkg", f"layer {k}", rows(k, 2 + k), COLUMNS), ("b.gpkg", f"other {k}", [(1, blob(5e5, 6.5e6), f"w{k}")], other)])
    archive(root, "o00", "b.zip", [("c.gpkg", "nothing", [], COLUMNS)])
    publisher = make(spark, root, tmp_path)
    tracker = spark.sparkContext.statusTracker()

    def jobs_of(run):
        spark.sparkContext.setJobGroup("counted", "jobs")
        try:
            return run(), len(tracker.getJobIdsForGroup("counted"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    report, jobs = jobs_of(lambda: publisher.publish_orders().collect())
    assert len(report) == 25 and {r.status for r in report} == {"ok"}
    for k in range(12):
        found = spark.table(f"{publisher.database}.layer_{k}")
        assert sorted((r.fid, r.n, r["_source_order"]) for r in found.collect()) == [(i + 1, k + i, f"o{k:02d}") for i in range(2 + k)]
        assert layers.cell_system(found) == 4326
    facts = {r.table_name: r for r in layers.published_profile(spark, publisher.database).collect()}
    assert facts["layer_7"].row_count == 9 and facts["other_3"].geometry_type == "Point" and facts["nothing"].row_count == 0
    assert jobs < 3 * 25, jobs  # far from what a layer by itself needs
    ledger = {(r.order_id, r.layer_name): r for r in publisher.ledger.read().collect()}
    assert len(ledger) == 25 and ledger[("o05", "layer 5")].feature_count == 7 and ledger[("o05", "layer 5")].bbox.startswith("POLYGON((15")
    assert {r.status for r in publisher.publish_orders().collect()} == {"skipped"}


# --- the log ------------------------------------------------------------------------------


@pytest.fixture()
def log(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n bigint").schema
    return lambda **options: EntryLog(spark, str(tmp_path / "log"), schema, ["k"], **options)


def test_log_equals_a_dictionary(spark, log):
    rng, store, want = random.Random(2), log(fanout=3), {}
    for turn in range(40):
        if turn % 13 == 12:
            store = log(fanout=3)  # another writer
        if turn == 20:
            want = {"k1": 100, "k9": 9}
            store.replace(spark.createDataFrame(list(want.items()), "k string, n bigint"))
            continue
        picked = rng.sample(range(8), rng.randint(1, 3))
        keys = spark.createDataFrame([(f"k{i}", turn) for i in picked], "k string, n bigint")
        if rng.random() < 0.3:
            store.delete(keys)
            want = {k: n for k, n in want.items() if k not in {f"k{i}" for i in picked}}
        else:
            store.upsert(keys)
            want |= {f"k{i}": turn for i in picked}
        if turn % 5 == 4:
            assert dict(tuple(r) for r in store.read().collect()) == want
    assert dict(tuple(r) for r in log().read().collect()) == want


def rows_written(spark, path):
    return sum(spark.read.parquet(f"{path}/{name}").count() for name in files.children(spark, path))


def test_log_writes_entries_not_tables(spark, log):
    store, n = log(fanout=4), 32
    for i in range(n):
        store.upsert(spark.createDataFrame([(f"k{i}", i)], "k string, n bigint"))
    assert store.read().count() == n
    # an entry and a place in a run each, and the bases of 16 and 32 rows; whole tables would be 528 rows
    assert rows_written(spark, store.path) <= 2 * n + 16 + 32


def test_log_loses_nothing_when_a_fold_is_lost(spark, log, monkeypatch):
    store, want = log(fanout=3), {}
    newest = EntryLog._newest
    for i in range(9):
        if i in (2, 8):  # the fold is lost half way: a folder without a mark

            def lost(self, frame):
                os.makedirs(f"{self.path}/run-{0:020d}-{10**19:020d}", exist_ok=True)
                raise RuntimeError("lost")

            monkeypatch.setattr(EntryLog, "_newest", lost)
        want[f"k{i % 5}"] = i
        one = spark.createDataFrame([(f"k{i % 5}", i)], "k string, n bigint")
        try:
            store.upsert(one)
        except RuntimeError:
            store = log(fanout=3)
        monkeypatch.setattr(EntryLog, "_newest", newest)
        assert dict(tuple(r) for r in store.read().collect()) == want


def test_log_forgets_what_was_folded(spark, log):
    store = log(fanout=3, kept_seconds=-1)
    for i in range(12):
        store.upsert(spark.createDataFrame([("a", i)], "k string, n bigint"))
    assert [r.n for r in store.read().collect()] == [11]
    assert len(files.children(spark, store.path)) <= 3


# --- cells ----------------------------------------------------------------------------------


def envelopes(seed, srid, count=4000):
    rng = random.Random(seed)
    left, low, right, high = (-180, -90, 180, 90) if srid == 4326 else (-2e5, 5.9e6, 1.4e6, 8.1e6)
    out = []
    for i in range(count):
        w, h = (rng.choice([0, 0, 1e-4, 0.01, 0.2]) * (b - a) * rng.random() for a, b in ((left, right), (low, high)))
        x, y = rng.uniform(left, right), rng.uniform(low, high)
        out.append((i, x, y, x + w, y + h))
    out += [(count, left, low, right, high), (count + 1, right, high, right, high), (count + 2, 2 * right, high, 3 * right, 2 * high)]
    return [(i, *map(float, box)) for i, *box in out]


@pytest.mark.parametrize("srid", [4326, 3006])
def test_ranges_hold_every_feature_that_meets_a_box(spark, srid):
    rows_ = envelopes(srid, srid)
    df = cells.with_feature_cell(spark.createDataFrame(rows_, "id long, xmin double, ymin double, xmax double, ymax double"), srid)
    numbered = [tuple(r) for r in df.collect()]
    rng, shares = random.Random(1), []
    for k in range(60):
        a = rng.choice(rows_)
        size = rng.choice([0, 1e-3, 0.01, 0.3, 3])
        reach = size * (100 if srid == 4326 else 1e6)
        box = (a[1] - reach * rng.random(), a[2] - reach * rng.random(), a[1] + reach * rng.random(), a[2] + reach * rng.random())
        if k == 0:
            box = (5.0, 5.0, -5.0, -5.0)
        ranges = cells.box_ranges(box, srid)
        assert len(ranges) <= cells.MAX_RANGES + 4 and all(a <= b for a, b in ranges) and all(b[0] > a[1] for a, b in zip(ranges, ranges[1:]))
        inside = [r for r in numbered if any(a <= r[5] <= b for a, b in ranges)]
        meeting = [r for r in numbered if r[1] <= box[2] and r[3] >= box[0] and r[2] <= box[3] and r[4] >= box[1]]
        assert set(meeting) <= set(inside)
        if size <= 1e-3 and k:
            shares.append((len(inside) - len(meeting)) / len(numbered))
    assert sum(shares) / len(shares) < 0.15


def test_a_row_without_an_envelope_has_no_cell(spark):
    df = spark.sql("SELECT cast(NULL AS double) AS xmin, 1D AS ymin, 2D AS xmax, 3D AS ymax, 'x' AS cell")
    found = cells.with_feature_cell(df, 4326)
    assert found.columns == ["xmin", "ymin", "xmax", "ymax", "cell"] and found.first().cell is None


def test_box_filter_asks_parquet_for_cell_ranges(spark, database, monkeypatch):
    monkeypatch.setattr(publish, "ROWS_PER_FILE", 500)
    df = spark.range(4000).select(F.col("id").alias("source_fid"), G.point(F.expr("300000D + id % 64 * 8000D"), F.expr("6200000D + id div 64 * 20000D")).alias("geom"))
    publish.publish_layer(df, "grid", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF)
    box = (300000.0, 6200000.0, 320000.0, 6260000.0)
    near = layers.bbox_filter(spark.table(f"{database}.grid"), box)
    plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    assert "GreaterThanOrEqual(cell," in pushed and "LessThanOrEqual(xmin," in pushed
    assert near.count() == 12
    touched = near.select(F.input_file_name()).distinct().count()
    assert touched <= 2 < spark.table(f"{database}.grid").select(F.input_file_name()).distinct().count()
    # without a cell column, or with one that is no layout cell, only the envelope is compared
    for plain in (spark.table(f"{database}.grid").drop("cell"), spark.table(f"{database}.grid").withColumn("cell", F.lit(0))):
        assert layers.bbox_filter(plain, box).count() == 12


# --- answers from footers, point folders, hashes of files ----------------------------------------


def test_count_and_extent_come_from_footers(spark, database):
    shapes = [(5, 3.0, 4.0, 9.0, 8.0), (6, -2.0, 5.0, 1.0, 30.0)]
    df = spark.createDataFrame(shapes, "source_fid long, xmin double, ymin double, xmax double, ymax double")
    df = df.select("source_fid", F.array("xmin").alias("nested"), G.box(*[F.col(c) for c in layers.ENVELOPE]).alias("geom"), F.lit("x").alias("plain"))
    for order in ("o1", "o2"):
        publish.publish_layer(df, "t", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF, if_exists="append", order_id=order)
    table = f"{database}.t"
    counted, extent = layers.table_count(spark, table), layers.table_extent(spark, table)
    assert counted.first()[0] == 4 and tuple(extent.first()) == (-2.0, 4.0, 9.0, 30.0)
    for one, told in ((counted, "COUNT(*)"), (extent, "MIN(xmin)")):
        plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert re.search(rf"PushedAggregation: \[.*{re.escape(told)}", plan), plan
        assert "ReadSchema" not in plan or not re.search(r"ReadSchema: struct<.*geom", plan)
    stats = layers.published_stats(spark, database, "t").first()
    assert (stats.feature_count, stats.minx, stats.source_order) == (4, -2.0, "o1")
    assert tuple(layers.extent(layers.bbox_filter(spark.table(table), (-5, 0, 2, 40))).first()) == (-2.0, 5.0, 1.0, 30.0)
    publish.publish_layer(df.limit(0), "none", database, crs.SWEREF, ["source_fid"], target_srid=crs.SWEREF)
    assert layers.table_count(spark, f"{database}.none").first()[0] == 0
    assert tuple(layers.table_extent(spark, f"{database}.none").first()) == (None,) * 4


def test_points_are_read_from_the_folders_asked_for(spark, tmp_path):
    path = str(tmp_path / "points")
    made = spark.range(4000).selectExpr(
        "cast(id % 20 AS string) AS tile", "concat(id % 6, '-0-0-', id % 3) AS node_key", "id * 1D AS x", "1D AS y", "2D AS z",
        "cast(NULL AS int) AS red", "cast(NULL AS int) AS green", "cast(NULL AS int) AS blue", "cast(NULL AS int) AS intensity",
    )
    points.write_points(made, path)
    read = feed_readers.read_laid_out_points(spark, path)
    coarse = points.coarse_nodes(read)
    assert [tuple(r) for r in coarse.collect()] == [tuple(r) for r in points.coarse_nodes(made).collect()]
    plan = coarse._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*depth#\d+ <= 3", plan)
    chosen = spark.createDataFrame([("3",), ("17",), ("3",)], "tile string")
    few = points.of_tiles(read, chosen.filter("tile <> 'x'"))
    assert few.count() == 400
    files_read = few.select(F.input_file_name()).distinct().count()
    assert files_read < read.select(F.input_file_name()).distinct().count() / 4
    assert points.of_tiles(made, chosen).count() == 400


def test_file_hashes_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    os.makedirs(tmp_path / "in" / "o1")
    content = {"a.bin": bytes(range(256)) * 99_000, "b c.txt": b"y", "ä.txt": b"x"}
    for name, data in content.items():
        (tmp_path / "in" / "o1" / name).write_bytes(data)
    found = archives.file_hashes(readers.scan_orders(spark, str(tmp_path / "in"))).collect()
    assert {r.file_name: r.source_hash for r in found} == {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}
