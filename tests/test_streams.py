"""Streaming jobs across batches, restarts and late rows, on streams small enough to follow by hand."""

import json

import pytest
from conftest import NOW, values
from pyspark.sql import functions as F

from fleetlens.plans import tables
from fleetlens.sources import feeds
from fleetlens.streaming import ingest, runner, stateful

SCHEMA = "vehicle_id string, ts bigint, route_id string, arrival bigint"
HOUR = NOW - NOW % 3600


@pytest.fixture()
def landed(spark, tmp_path):
    """Folders of rows (vehicle, ts, route, arrival), one per list."""
    def make(*batches, name="staged"):
        rows = [(i, *row) for i, batch in enumerate(batches) for row in batch]
        frame = spark.createDataFrame(rows, f"slice int, {SCHEMA}").repartition(4)
        return runner.land(frame, str(tmp_path / name), "slice"), frame.drop("slice").schema
    runner.use_rocksdb(spark)
    return make


def run(spark, tmp_path, landed, job, sink, name="cp", mode="append", drops=None):
    return runner.drain_folders(spark, landed[0], landed[1], job, sink, str(tmp_path / name), mode, drops)


def test_folders_are_batches_however_many_files(spark, tmp_path, landed):
    folders = landed([(f"v{i}", NOW, "r", i) for i in range(40)], [("v1", NOW + 5, "r", 99)])
    assert len(list((tmp_path / "staged" / "slice=0").glob("*.parquet"))) > 1
    seen = []
    run(spark, tmp_path, folders, lambda s: s, lambda frame, batch: seen.append((batch, frame.count())))
    assert seen == [(0, 40), (1, 1)]


def live(spark, root):
    stored = runner.newest_updates(spark, root, f"{SCHEMA}, expired boolean", "vehicle_id")
    return values(stored, "vehicle_id", "ts", "arrival", "expired")


def test_live_rows_expire_and_come_back(spark, tmp_path, landed):
    out = str(tmp_path / "out")
    folders = landed(
        [("a", NOW, "r", 1), ("a", NOW, "r", 2), ("b", NOW - 5, "r", 3), ("a", NOW - 9, "r", 4)],
        [("b", NOW + 2000, "r", 5)],                          # a is 900 s behind the watermark after this batch
        [("a", NOW + 2001, "r", 6), ("c", NOW + 100, "r", 7)])  # a comes back, c is behind the watermark
    run(spark, tmp_path, folders, lambda s: stateful.live_rows(s, SCHEMA, keep_s=900, lateness="60 seconds"), runner.update_sink(out), mode="update")
    assert live(spark, out) == [("a", NOW + 2001, 6, False), ("b", NOW + 2000, 5, False)]
    updates = tables.read_table(spark, out, f"{SCHEMA}, expired boolean, batch bigint")
    assert values(updates.filter("expired"), "vehicle_id", "ts") == [("a", NOW)]


def test_live_rows_start_from_stored_rows(spark, tmp_path, landed):
    """A job that lost its checkpoint and starts from what is stored ends like one that never stopped."""
    batches = ([("a", NOW, "r", 1), ("b", NOW, "r", 2), ("old", NOW - 5000, "r", 3)],  # old is behind the watermark by more than it is kept
               [("a", NOW - 1, "r", 4), ("b", NOW + 10, "r", 5), ("a", NOW, "r", 0)])
    job = lambda restored=None: lambda s: stateful.live_rows(s, SCHEMA, restored)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    run(spark, tmp_path, landed(*batches, name="one"), job(), runner.update_sink(whole), "cp1", "update")
    folders, kind = landed(*batches, name="two")
    run(spark, tmp_path, (folders[:1], kind), job(), runner.update_sink(parts), "cp2", "update")
    stored = runner.newest_updates(spark, parts, f"{SCHEMA}, expired boolean", "vehicle_id")
    first = 1 + max(map(int, tables.partition_values(spark, parts, "batch")))
    run(spark, tmp_path, (folders[1:], kind), job(stored.filter(f"NOT expired AND ts >= {NOW - 900}")), runner.update_sink(parts, first), "cp3", "update")
    assert live(spark, parts) == live(spark, whole) == [("a", NOW, 1, False), ("b", NOW + 10, 5, False), ("old", NOW - 5000, 3, True)]


def test_updates_are_folded_by_the_job(spark, tmp_path, landed):
    out = str(tmp_path / "out")
    folders = landed(*[[("a", NOW + i, "r", i), (f"v{i}", NOW, "r", 50 + i)] for i in range(4)])
    fold = lambda: runner.compact_updates(spark, out, f"{SCHEMA}, expired boolean", "vehicle_id")
    run(spark, tmp_path, folders, lambda s: stateful.live_rows(s, SCHEMA), runner.update_sink(out, fold=fold, every=2), mode="update")
    assert [r[:2] for r in live(spark, out)] == [("a", NOW + 3), *[(f"v{i}", NOW) for i in range(4)]]
    assert len(tables.partition_values(spark, out, "batch")) < 4


def test_copies_go_and_late_rows_are_counted(spark, tmp_path, landed):
    out, drops = str(tmp_path / "out"), str(tmp_path / "drops")
    folders = landed(
        [("a", NOW, "r", 1), ("a", NOW, "r", 2), ("b", NOW, "r", 3)],
        [("a", NOW, "r", 4), ("a", NOW - 59, "r", 5), ("a", NOW - 60, "r", 6), ("b", NOW - 7000, "r", 7), ("b", NOW + 100, "r", 8)],
        [("b", NOW + 100, "r", 9), ("b", NOW + 40, "r", 10), ("b", NOW + 41, "r", 11)])
    run(spark, tmp_path, folders, lambda s: stateful.unique_rows(s, lateness="60 seconds").select("vehicle_id", "ts"),
        runner.update_sink(out), drops=("copies", drops))
    assert values(spark.read.parquet(out), "vehicle_id", "ts") == [
        ("a", NOW - 59), ("a", NOW), ("b", NOW), ("b", NOW + 41), ("b", NOW + 100)]
    told = runner.watermark_drops(spark, drops).filter("rows > 0").orderBy("batch")
    assert [(r["rows"], r["dropped"]) for r in told.collect()] == [(3, 0), (5, 2), (3, 1)]


def test_hours_are_emitted_once_when_they_close(spark, tmp_path, landed):
    out = str(tmp_path / "out")
    at = lambda hours, seconds=0: HOUR + 3600 * hours + seconds
    folders = landed(
        [("a", at(0, 10), "r", 1), ("a", at(0, 10), "r", 2), ("a", at(0, 20), "r", 3), ("b", at(0, 30), "r", 4), ("a", at(1), "r", 5)],
        [("c", at(0, 40), "r", 6), ("a", at(2, 1), "r", 7)],         # hour 0 closes behind this batch
        [("d", at(0, 50), "r", 8), ("e", at(1, 3599), "r", 9), ("a", at(5), "r", 10)])
    place = lambda s: s.select("vehicle_id", "ts", "arrival", F.lit(28.6).alias("lat"), F.lit(77.2).alias("lon"), F.lit(3.0).alias("speed"))
    run(spark, tmp_path, folders, lambda s: stateful.hourly_cells(place(s)), runner.update_sink(out))
    cells = spark.read.parquet(out)
    assert values(cells, "hour_bucket", "observations", "vehicles", "moving", "speed_sum") == [
        (at(0), 4, 3, 4, 12.0), (at(1), 2, 2, 2, 6.0), (at(2), 1, 1, 1, 3.0)]


def feed(**vehicle):
    return json.dumps({"header": {"timestamp": NOW}, "entity": [{"id": "x", "vehicle": {"vehicle": {"id": "x"}, "timestamp": NOW, **vehicle}}]})


def test_fields_are_found_whatever_they_are_called(spark, data, tmp_path):
    named = lambda *bodies: feeds.message_fields(spark.createDataFrame([(b,) for b in bodies], "body string"))
    plain = ["entity.id", "entity.vehicle.timestamp", "entity.vehicle.vehicle.id", "header.timestamp"]
    assert named(feed()) == named(feed(), "no json", "", feed(stop_id=None)) == plain
    assert named() == named("no json") == named("[]") == named("{}") == []
    odd = named(feed(**{"OBJECT<a b": {"x.y": 1}, "tags": [{"k": 1}, {"l": [2]}]}), feed(tags=[{"k": "text"}]))
    assert set(odd) - set(plain) == {"entity.vehicle.OBJECT<a b.x.y", "entity.vehicle.tags.k", "entity.vehicle.tags.l"}
    store = ingest.IngestTables(spark, str(tmp_path / "out"))
    write = ingest.ingest_batch(store, data.routes)
    for i, body in enumerate((feed(), feed(), feed(battery=80))):
        write(spark.createDataFrame([(body, NOW + i)], "body string, ingested_at bigint"), i)
    changes = values(store.field_sets, "changed_at", "fields")
    assert [at for at, _ in changes] == [NOW, NOW + 2] and "entity.vehicle.battery" in changes[1][1].split(",")
