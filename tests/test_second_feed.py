"""Jobs of the second feed: vehicles across empty batches, replays, retention."""

import json

from conftest import NOW, values
from pyspark.sql import functions as F

from fleetlens.constants import DELAY_FEED_CLOCK_OFFSET_S
from fleetlens.operators import merge
from fleetlens.plans import tables
from fleetlens.session import room_for
from fleetlens.sources import feeds
from fleetlens.streaming import second_feed

MESSAGES = "message_id bigint, ingested_at bigint, body string"


def poll(*vehicles):
    """vehicles: (id, label, seconds before NOW)"""
    entity = [{"id": v, "vehicle": {"vehicle": {"id": v, "label": label}, "timestamp": str(NOW - ago + DELAY_FEED_CLOCK_OFFSET_S),
                                    "position": {"latitude": "12.9", "longitude": "77.6", "bearing": "1"}}} for v, label, ago in vehicles]
    return json.dumps({"IsSuccess": True, "Data": {"header": {"timestamp": "1"}, "entity": entity}})


def messages(spark, *polls):
    return spark.createDataFrame([(i, at, body) for i, at, body in polls], MESSAGES)


def seconds(rows):
    return rows.select("vehicle_id", "label", F.unix_seconds("first_seen").alias("first"), F.unix_seconds("last_seen").alias("last"))


def test_vehicles_outlive_an_empty_batch_and_a_replay(spark, tmp_path):
    store = second_feed.SecondFeedTables(spark, str(tmp_path))
    write = second_feed.vehicle_batch(store, compact_every=3)
    batches = [messages(spark, (1, NOW, poll(("A", "a1", 50), ("B", None, 40)))), messages(spark), messages(spark, (2, NOW + 60, poll(("C", "c", 5)))),
               messages(spark, (3, NOW + 120, poll(("B", "b", 3), ("A", None, 2)))), messages(spark, (4, NOW + 180, "no json"))]
    want = [("A", "a1", NOW, NOW + 120), ("B", "b", NOW, NOW + 120), ("C", "c", NOW + 60, NOW + 60)]
    for i, batch in enumerate(batches):
        write(batch, i)
    write(batches[3], 3)
    assert values(seconds(store.vehicles), "vehicle_id", "label", "first", "last") == want
    assert values(store.polls, "message_id", "ok", "new_rows", "duplicates")[-1][:2] == (4, False)
    stored = spark.createDataFrame([], "vehicle_id string, label string, first_seen timestamp, last_seen timestamp")
    for at, rows in ((NOW, [("A", "a1", 1), ("B", None, 1)]), (NOW + 60, [("C", "c", 2)]), (NOW + 120, [("B", "b", 3), ("A", None, 4)])):
        batch = spark.createDataFrame(rows, "vehicle_id string, label string, ts bigint")
        stored = merge.seen_dimension_merge(stored, batch, F.timestamp_seconds(F.lit(at)))
    assert values(seconds(stored), "vehicle_id", "label", "first", "last") == want


def test_retention_drops_by_time_and_keeps_first_seen(spark, tmp_path):
    store = second_feed.SecondFeedTables(spark, str(tmp_path))
    write = second_feed.vehicle_batch(store, retention_s=100_000)
    for i, (at, rows) in enumerate([(NOW - 9000, [("A", "a", 9100), ("B", "b", 9100)]), (NOW - 8000, [("B", "b", 8100)]),
                                    (NOW, [("A", "a", 100), ("D", "d", 7300)])]):
        write(messages(spark, (i, at, poll(*rows))), i)
    for _ in range(2):                                       # a repeated run changes nothing
        second_feed.apply_retention(store, NOW, 7200)
        assert values(store.log, "vehicle_id", "ts") == [("A", NOW - 100)]
        assert values(store.latest, "vehicle_id", "ts") == [("A", NOW - 100)]
        assert values(seconds(store.vehicles), "vehicle_id", "first", "last") == [("A", NOW - 9000, NOW), ("D", NOW, NOW)]
    assert len(tables.partition_values(spark, store.path("latest"), "batch")) <= 2
    second_feed.apply_retention(second_feed.SecondFeedTables(spark, str(tmp_path / "none")), NOW)


def delays(trip, *stops):
    update = [{"stop_sequence": str(n), "arrival": {"delay": str(late)}, "stop_id": f"S{n}"} for n, late in stops]
    trips = [{"trip_update": {"trip": {"trip_id": trip, "start_date": "05012024"}, "stop_time_update": u}} for u in (update[:1], update)]
    return json.dumps({"IsSuccess": True, "Data": {"entity": trips}})


def test_delay_round_parses_a_message_once_and_is_replayed(spark, tmp_path):
    store = second_feed.SecondFeedTables(spark, str(tmp_path))
    write = second_feed.delay_round(store)
    batch = lambda at, *bodies: spark.createDataFrame([(i, 3, at, b) for i, b in enumerate(bodies)], "message_id bigint, zone_id int, ingested_at bigint, body string")
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    one = batch(NOW, delays("T1", (1, 30), (2, 60)), delays("T2", (1, 0)), "no json")
    assert parses(feeds.json_envelope_split(one)) == 1
    two = batch(NOW + 900, delays("T1", (1, 30), (2, 90)), delays("T1", (3, 5)))
    for i, rows in enumerate((one, two, two)):
        write(rows, min(i, 1))
        assert not tables.exists(spark, str(tmp_path / ".round"))
    assert values(store.stop_delay, "trip_id", "stop_sequence", "arrival_delay_s", "changes") == [
        ("T1", 1, 30, 0), ("T1", 2, 90, 1), ("T1", 3, 5, 0), ("T2", 1, 0, 0)]
    assert values(store.trip_status, "trip_id", "stops_total") == [("T1", 1), ("T2", 1)]
    assert values(store.rounds.filter("batch = 0"), "message_id", "ok", "trips", "stops") == [(0, True, 1, 2), (1, True, 1, 1), (2, False, 0, 0)]


def test_a_shuffle_has_room_for_its_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with room_for(spark, 25_000_001):
        assert int(spark.conf.get(name)) == 51
    with room_for(spark, 10):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before


def steps(node):
    """The text of every step of a plan; what is cached is a step without children."""
    yield node.simpleString(10_000)
    for i in range(node.children().size()):
        yield from steps(node.children().apply(i))


def test_rows_and_audit_of_a_batch_come_from_one_parse(spark, tmp_path, monkeypatch):
    """What a batch counts is read from cached entities; no plan behind the poll rows parses a message again."""
    store, plans = second_feed.SecondFeedTables(spark, str(tmp_path)), []
    counted = second_feed._counted

    def seen(entities, rows, fresh):
        plans.append(list(steps(counted(entities, rows, fresh)._jdf.queryExecution().withCachedData())))
        return counted(entities, rows, fresh)
    monkeypatch.setattr(second_feed, "_counted", seen)
    write = second_feed.vehicle_batch(store, retention_s=7200)
    write(messages(spark, (0, NOW, poll(("A", "a", 50), ("A", "a", 40), ("B", "b", 9000))), (1, NOW, poll(("A", "a", 40)))), 0)
    write(messages(spark, (2, NOW, poll()), (3, NOW, "no json"), (4, NOW, poll(("A", "a", 40), ("C", "c", 1)))), 1)
    got = [(r["message_id"], r["entities"], r["stale"], r["new_rows"], r["duplicates"]) for r in store.polls.orderBy("message_id").collect()]
    assert got == [(0, 3, 1, 1, 0), (1, 1, 0, 0, 1), (2, None, 0, 0, 0), (3, None, 0, 0, 0), (4, 2, 0, 1, 1)]
    assert len(plans) == 2 and not any("from_json" in step for plan in plans for step in plan)
