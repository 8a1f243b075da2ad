"""Current tables as logs of batches, sliding horizons, and the set of sent updates."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cairngeo.operators.entrylog import LatestLog
from cairngeo.sources import files
from cairngeo.streaming import live

SCHEMA = "announcement_id bigint, AdvertisedTrainIdent string, LocationSignature string, Operator string, FromLocation array<struct<LocationName:string>>, ToLocation array<struct<LocationName:string>>, TimeAtLocation timestamp, AdvertisedTimeAtLocation timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture()
def latest(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, t timestamp, n bigint, v string").schema
    return lambda expiry=None, **options: LatestLog(spark, str(tmp_path / "t"), schema, "k", "t", "n", expiry, **options)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "k string, s bigint, n bigint, v string").select("k", F.timestamp_seconds("s").alias("t"), "n", "v")


def test_a_batch_entered_twice_or_late_changes_nothing(spark, latest):
    table = latest()
    step = live.enter(table)
    one = batch_of(spark, [("a", 1, 1, "x"), ("b", 2, 2, "y"), ("b", 2, 1, "first of equals")])
    two = batch_of(spark, [("a", 9, 3, "new"), ("c", 1, 4, "z")])
    for number, batch in enumerate([one, one, two, one]):  # the last one comes late
        step(batch, number)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [("a", "new"), ("b", "first of equals"), ("c", "z")]


def test_a_batch_writes_its_own_rows_and_old_keys_are_forgotten(spark, latest):
    table = latest("1 hour", fanout=4)
    step = live.enter(table)
    step(batch_of(spark, [(f"k{i}", i, i, "old") for i in range(40)]), 0)
    assert table.read().count() == 40
    before = set(files.children(spark, table.path))
    step(batch_of(spark, [("k1", 7200, 50, "new")]), 1)
    (added,) = set(files.children(spark, table.path)) - before
    assert spark.read.parquet(f"{table.path}/{added}").count() == 1
    assert [(r.k, r.v) for r in table.read().collect()] == [("k1", "new")]
    for turn in range(2, 20):  # folded away in the end
        step(batch_of(spark, [("k2", 7200 + turn, turn, "more")]), turn)
    bases = [n for n in files.children(spark, table.path) if n.startswith("base-")]
    assert bases and spark.read.parquet(f"{table.path}/{bases[-1]}").count() == 2


def announcements(seed, days, trains):
    """Per day and train some announcements, in order of time but for some minutes; trains stop running on the way."""
    rng, rows, number = random.Random(seed), [], 0
    for day in range(days):
        today = []
        for train in range(trains):
            if day * trains > 2 * days * train:  # the low numbers stop first
                continue
            for _ in range(rng.randint(0, 3)):
                today.append((START + timedelta(days=day, minutes=rng.randrange(1400)), f"t{train}"))
        for at, train in sorted(today):
            number += 1
            rows.append((day, number, train, at))
    return rows


def replay(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for day in sorted({r[0] for r in rows}):
        df = spark.createDataFrame([r[1:] for r in rows if r[0] == day], "announcement_id bigint, AdvertisedTrainIdent string, TimeAtLocation timestamp")
        df.withColumn("LocationSignature", F.lit("G")).coalesce(1).write.json(f"{path}/day={day:02d}")
        stamp = START.timestamp() + day * 86400
        for folder, _, names in os.walk(f"{path}/day={day:02d}"):
            for name in names:
                os.utime(os.path.join(folder, name), (stamp, stamp))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(path)


@pytest.fixture()
def stations(spark):
    return spark.createDataFrame([("G", "Town", 12.0, 57.0)], "signature string, name string, lon double, lat double")


def test_thirty_days_with_expiry_equal_the_batch_form(spark, tmp_path, stations):
    rows = announcements(3, 30, 40)
    started, table = live.live_trains(replay(spark, tmp_path, rows), stations, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    started.awaitTermination()
    newest = {}
    for _, number, train, at in rows:
        newest[train] = max(newest.get(train, (at, -number)), (at, -number))
    last = max(at for at, _ in newest.values())
    want = {train: -number for train, (at, number) in newest.items() if at > last - timedelta(days=7)}
    assert {r.train: r.announcement_id for r in table.read().collect()} == want
    assert 5 < len(want) < len(newest)
    # what the batches wrote is what they brought, once each, not the table once per batch
    entered = [spark.read.parquet(f"{table.path}/{n}").count() for n in files.children(spark, table.path) if n.startswith("entry-")]
    assert len(entered) >= 30 and sum(entered) <= len(rows)


def test_horizons_equal_the_batch_form(spark, tmp_path, stations):
    rows = announcements(4, 3, 30)
    out = str(tmp_path / "out")
    live.train_horizons(replay(spark, tmp_path, rows), stations, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    found = {(r.window_start.timestamp(), r.train): r.announcement_id for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(found)
    closed = max(at for *_, at in rows) - timedelta(minutes=15)
    want = {}
    for _, number, train, at in rows:
        first = at.timestamp() // 300 * 300
        for start in (first - 300 * k for k in range(4)):
            if start + 1200 <= closed.timestamp():
                key, row = (start, train), (at, -number)
                want[key] = max(want.get(key, row), row)
    assert found == {k: -number for k, (_, number) in want.items()}


UPDATES = "order_id string, title string, updated string, seen_at timestamp"


def updates(spark, rows):
    return spark.createDataFrame(rows, "order_id string, title string, updated string").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))


def test_sent_set_equals_a_set_and_its_folders_stay_few(spark, tmp_path):
    log = live.sent_log(spark, str(tmp_path / "sent"), updates(spark, []).schema, fanout=3, kept_seconds=-1)
    rng, sent = random.Random(1), set()
    for batch_id in range(24):
        rows = {(f"o{rng.randrange(6)}", f"f{rng.randrange(8)}", rng.choice([None, "1", "2"])) for _ in range(6)}
        log.add(updates(spark, sorted(rows, key=str)), batch_id)
        if batch_id % 7 == 3:
            log.add(updates(spark, sorted(rows, key=str)), batch_id)  # the batch is run again
        if batch_id == 12:
            log = live.sent_log(spark, log.path, log.schema, fanout=3, kept_seconds=-1)
        sent |= rows
        assert len(files.children(spark, log.path)) <= 8
    got = [(r.order_id, r.title, r.updated) for r in log.read().collect()]
    assert len(got) == len(set(got)) and set(got) == sent
    assert live.sent_updates(spark, log.path).count() == len(sent)


def test_a_batch_opens_only_folders_that_may_hold_its_orders(spark, tmp_path):
    log = live.sent_log(spark, str(tmp_path / "sent"), updates(spark, []).schema)
    for k in range(5):
        log.add(updates(spark, [(f"order{k}-{i}", "f", "1") for i in range(50)]), k)
    assert log.folders_for(updates(spark, [("order3-7", "f", "1")])) == [f"entry-{4:020d}-batch"]
    assert log.folders_for(updates(spark, [("new", "f", "1")])) == []
    other = live.sent_log(spark, log.path, log.schema)  # summaries are read from the folders
    assert len(other.folders_for(updates(spark, [("order0-1", "f", "1"), ("order4-1", "f", "2")]))) == 2
    os.remove(tmp_path / "sent" / f"entry-{1:020d}-batch" / "_summary")
    assert len(live.sent_log(spark, log.path, log.schema).folders_for(updates(spark, [("new", "f", "1")]))) == 1
