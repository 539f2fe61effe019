"""The fold job, stored tables and streaming jobs, including repeats after a failure."""

import json

import pytest
from conftest import NOW, values
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import continuity, merge, rollup
from fleetlens.plans import fold, tables
from fleetlens.streaming import ingest, runner, stateful
from test_continuity import COLUMNS, make_log

GRID = ["cell_y", "cell_x", "hour_bucket", "observations", "vehicles", "moving", "stopped"]


@pytest.fixture()
def store(spark, data, tmp_path):
    t = fold.FoldTables(spark, str(tmp_path))
    tables.append_log(data.positions, t.path("log"), 0)
    return t


def test_fold_job_is_repeatable(data, store):
    for _ in range(2):
        result = fold.run_once(store, data.trips, NOW)
        assert (result["watermark"], result["routes"]) == (NOW - 20, 7)
        assert values(store.grid_hours, *GRID) == values(rollup.grid_hour_rollup(data.positions), *GRID)
        gaps = continuity.gap_hour_counters(data.positions, 0, NOW)
        assert values(store.gap_hours, *COLUMNS) == values(gaps, *COLUMNS)
    assert store.watermarks() == {"rollup": NOW - 20, "continuity": NOW - 20, "trip_match": NOW - 20}


def test_full_rebuild_drops_emptied_hours(spark, data, store):
    fold.run_once(store, data.trips, NOW)
    tables.prune_log(spark, store.path("log"), fold.LOG_SCHEMA, NOW - 7200)
    assert store.log.count() == 5
    fold.fold_rollups(store, NOW - 20, full=True)
    assert values(store.grid_hours, *GRID) == values(rollup.grid_hour_rollup(store.log), *GRID)


def test_interrupted_continuity_step_starts_over(spark, tmp_path):
    _, log = make_log(spark, seed=9)
    rows = log.withColumn("arrival", F.lit(0).cast("bigint"))
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c)
                         for c, t in ((f.name, f.dataType) for f in schemas.POSITIONS)], "arrival")
    store = fold.FoldTables(spark, str(tmp_path))
    tables.append_log(full, store.path("log"), 0)
    newest = full.agg(F.max("ts")).first()[0]
    assert fold.fold_continuity(store, newest, chunk_s=3 * 3600)
    marks = store.watermarks()
    assert fold.fold_continuity(store, newest, chunk_s=3 * 3600)
    store.advance(**marks)                                   # as if the last watermark had been lost
    fold.catch_up(store, newest, chunk_s=3 * 3600)
    assert values(store.gap_hours, *COLUMNS) == values(continuity.gap_hour_counters(full, newest - 12 * 3600, newest), *COLUMNS)
    whole = continuity.trip_gap_state(full, newest - 12 * 3600, newest)
    assert values(store.trip_state, "vehicle_id", "trip_id", "last_ts", "has_gap") == values(whole, "vehicle_id", "trip_id", "last_ts", "has_gap")


def test_log_batch_written_twice_stays_once(spark, data, store):
    tables.append_log(data.positions, store.path("log"), 0)
    assert store.log.count() == 9
    assert tables.prune_log(spark, store.path("log"), fold.LOG_SCHEMA, NOW + 86_400 * 2) and store.log.count() == 0


def feed(*vehicles):
    return json.dumps({"header": {"timestamp": NOW}, "entity": [
        {"id": v, "vehicle": {"vehicle": {"id": v}, "timestamp": ts, "trip": {"route_id": route}, **({"position": {"speed": 1.0}} if speed else {})}}
        for v, ts, route, speed in vehicles]})


def test_ingest_batches(spark, data, tmp_path):
    store = ingest.IngestTables(spark, str(tmp_path / "out"))
    write = ingest.ingest_batch(store, data.routes)
    batch = lambda now, *bodies: spark.createDataFrame([(b, now) for b in bodies], "body string, ingested_at bigint")
    first = batch(NOW, feed(("A", NOW, "L10", False), ("B", NOW, "nowhere", False), ("A", NOW, "L20", False)))
    second = batch(NOW + 30, feed(("A", NOW, "L10", False), ("A", NOW + 30, "L10", True)))
    write(first, 0)
    write(second, 1)
    write(second, 1)                                         # replay of the last batch
    assert values(store.log, "vehicle_id", "ts", "route_id") == [("A", NOW, "L10"), ("A", NOW + 30, "L10")]
    assert values(store.dead, "vehicle_id", "reason") == [("B", "unknown_route_id")]
    assert values(store.polls, "polled_at", "entity_count", "new_rows", "feed_timestamp") == [(NOW, 3, 1, NOW), (NOW + 30, 2, 1, NOW)]
    assert values(store.latest, "vehicle_id", "ts") == [("A", NOW + 30)]
    assert values(store.late, "batch", "kept", "late") == [(0, 3, 0), (1, 2, 0)]
    changes = dict(values(store.field_sets, "changed_at", "fields"))
    assert "speed" not in changes[NOW] and "speed" in changes[NOW + 30]


def split_files(frame, folder, cuts):
    for low, high in zip([0, *cuts], [*cuts, 2**40]):
        frame.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("cuts", [[], [NOW + 1800, NOW + 20_000]])
def test_stateful_gaps_do_not_depend_on_batches(spark, tmp_path, cuts):
    _, log = make_log(spark, seed=4)
    log = log.withColumn("arrival", F.col("ts")).cache()
    split_files(log.unionByName(log.limit(50)), str(tmp_path / "in"), cuts)      # with copies
    runner.use_rocksdb(spark)
    stream = runner.file_stream(spark, str(tmp_path / "in"), log.schema, files_per_trigger=1)
    runner.drain(stateful.gap_events(stream), runner.update_sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    events = tables.read_table(spark, str(tmp_path / "out"), f"{stateful.GAP_SCHEMA}, batch bigint")
    assert values(stateful.gap_counters(events), *COLUMNS) == values(continuity.gap_hour_counters(log, 0, 2 * NOW), *COLUMNS)


class CountedState:
    """A value state that counts its calls, and the only state there is."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_gap_state_takes_two_calls_however_many_trips():
    state, processor = CountedState(), stateful.GapProcessor(90)
    processor.init(state)
    row = lambda trip, ts, arrival: {"trip_id": trip, "ts": ts, "arrival": arrival}
    told = lambda *rows: [tuple(r) for r in processor.handleInputRows(("V",), iter([row(*r) for r in rows]), None)]
    assert told(*[(f"T{i}", 10 * i, i) for i in range(50)])[-1] == ("trip", "V", "T49", 490, None, False) and state.calls == 2
    got = told(("T49", 700, 2), ("other", 700, 3), (None, 600, 1), ("late", 490, 0))
    assert got == [("gap", "V", None, 600, 490, None), ("gap", "V", None, 700, 600, None), ("trip", "V", "T49", 700, None, True)]
    assert state.calls == 4 and len(state.value[1]) == 50
    told(("T1", 10 * 86_400, 1))                      # days later only the trips of the retention are kept
    assert [t[0] for t in state.value[1]] == ["T1"] and told(("T1", 5, 9)) == []


def test_latest_stream_survives_a_restart(spark, data, tmp_path):
    columns = ["vehicle_id", "ts", "route_id", "arrival"]
    schema = "vehicle_id string, ts bigint, route_id string, arrival bigint"
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    def run():
        stream = runner.file_stream(spark, source, schema)
        runner.drain(stateful.latest_rows(stream, columns), runner.update_sink(sink), progress, "update")
        return values(runner.newest_updates(spark, sink, schema, "vehicle_id"), *columns)
    old, new = data.positions.filter(F.col("ts") < NOW - 100), data.positions.filter(F.col("ts") >= NOW - 100)
    old.select(*columns).write.parquet(source)
    assert run() == values(merge.latest_projection(old), *columns)
    new.select(*columns).write.mode("append").parquet(source)
    assert run() == values(data.latest, *columns)
    runner.compact_updates(spark, sink, schema, "vehicle_id")
    assert values(runner.newest_updates(spark, sink, schema, "vehicle_id"), *columns) == values(data.latest, *columns)


def test_versioned_table_keeps_two(spark, tmp_path):
    root = str(tmp_path / "t")
    for version in range(4):
        tables.write_version(spark.createDataFrame([(version,)], "v int"), root, version)
    assert tables.partition_values(spark, root, "version") == ["2", "3"]
    assert values(tables.read_version(spark, root, "v int"), "v") == [(3,)]


def test_a_cut_off_swap_is_undone(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(v,)], "v int")
    rows(1).write.parquet(f"{root}/day=1")
    rows(2).write.parquet(f"{root}/.new.day=1")
    assert values(tables.read_table(spark, root, "v int, day int"), "v") == [(1,)]
    (tmp_path / "t" / "day=1").rename(tmp_path / "t" / ".old.day=1")       # stopped between the renames
    tables.recover(spark, root)
    assert values(tables.read_table(spark, root, "v int, day int"), "v") == [(1,)]
    tables.swap_partition(spark, f"{root}/.new.day=1", f"{root}/day=1")
    assert values(tables.read_table(spark, root, "v int, day int"), "v") == [(2,)]


def test_compacted_days_survive_a_repeated_batch(spark, data, tmp_path):
    root = str(tmp_path / "log")
    shifted = data.positions.withColumn("ts", F.col("ts") - 86_400)
    parts = [shifted.filter("arrival % 2 = 0"), shifted.filter("arrival % 2 = 1").unionByName(data.positions)]
    for i, part in enumerate(parts):
        tables.append_log(part, root, i)
    before = values(tables.read_table(spark, root, fold.LOG_SCHEMA), "vehicle_id", "ts")
    assert len(tables.compact_log(spark, root, fold.LOG_SCHEMA)) == 1
    stored = tables.read_table(spark, root, fold.LOG_SCHEMA)
    assert values(stored, "vehicle_id", "ts") == before
    tables.append_log(merge.dedupe_append(stored.filter("batch <> 1"), parts[1]), root, 1)      # batch 1 once more
    assert values(tables.read_table(spark, root, fold.LOG_SCHEMA), "vehicle_id", "ts") == before


def test_steps_are_merged_without_counting_twice(spark, data, store):
    newest = NOW - 20
    while fold.fold_continuity(store, newest, chunk_s=3600):
        pass
    assert len(tables.partition_values(spark, store.path("continuity"), "step")) == 2
    assert values(store.gap_hours, *COLUMNS) == values(continuity.gap_hour_counters(data.positions, 0, NOW), *COLUMNS)


def test_arrival_numbers_never_collide(spark, data, tmp_path):
    """Two messages of one second with more entities than a thousand, then a repeated batch."""
    many = lambda base: feed(*[(f"{base}-{i}", NOW, "L10", False) for i in range(1500)])
    batch = spark.createDataFrame([(many("a"), NOW), (many("b"), NOW), ("{}", NOW), ("no json", NOW)], "body string, ingested_at bigint")
    store = ingest.IngestTables(spark, str(tmp_path / "out"))
    write = ingest.ingest_batch(store, data.routes)
    for _ in range(2):
        write(batch, 0)
    assert store.log.select("arrival").distinct().count() == 3000 == store.latest.count()
    assert values(store.polls.fillna(0), "ok", "entity_count", "new_rows", "feed_timestamp") == [(0, 0, 0, 0)] * 2 + [(1, 1500, 1500, NOW)] * 2
