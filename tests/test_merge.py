from datetime import date, datetime, timedelta

import pytest
from conftest import NOW, one, values
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import merge


def report(data, vehicle, ts, arrival=100, route="L10"):
    row = data.positions.limit(1)
    return row.select([F.lit(v).cast(t).alias(c) if (v := {"vehicle_id": vehicle, "ts": ts, "route_id": route, "arrival": arrival}.get(c)) is not None
                       else F.col(c) for c, t in row.dtypes])


def test_dedupe_append_counts_only_new_rows(data):
    batch = report(data, "TRAM-7", NOW).unionByName(report(data, "NEW", NOW)).unionByName(report(data, "TRAM-7", NOW - 20))
    assert merge.dedupe_append(data.positions, batch).count() == 2
    assert merge.dedupe_append(data.positions, report(data, "TRAM-7", NOW - 20)).isEmpty()


def test_latest_never_rolls_back(data):
    newer = merge.latest_wins_merge(data.latest, report(data, "TRAM-7", NOW + 500))
    older = merge.latest_wins_merge(data.latest, report(data, "TRAM-7", NOW - 9999))
    equal = merge.latest_wins_merge(data.latest, report(data, "TRAM-7", NOW - 20, arrival=0, route="L20"))
    ts = lambda df: dict(values(df, "vehicle_id", "ts"))["TRAM-7"]
    assert ts(newer) == NOW + 500 and ts(older) == NOW - 20
    assert dict(values(equal, "vehicle_id", "route_id"))["TRAM-7"] == "L20"
    assert newer.count() == 4


def test_quarantine_keeps_good_rows(data):
    batch = report(data, "A", NOW).unionByName(report(data, "B", NOW, route="nowhere")).unionByName(
        report(data, "C", NOW).withColumn("route_id", F.lit(None).cast("string")))
    kept, dead = merge.quarantine_split(batch, data.routes, NOW)
    assert values(kept, "vehicle_id") == [("A",), ("C",)]
    assert values(dead, "vehicle_id", "reason", "quarantined_at") == [("B", "unknown_route_id", NOW)]
    assert one(merge.deadletter_count(dead, NOW + 1)) == {"n": 0}


def test_retention_and_purge(data):
    assert data.positions.count() - merge.retention_prune(data.positions, NOW - 7200).count() == 4
    assert one(merge.purge_count(data.latest)) == {"removed": 1}
    assert "SIM-9" not in dict(values(merge.prefix_purge(data.latest), "vehicle_id", "ts"))


def test_static_reload_last_row_wins(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v int, position int")
    assert values(merge.static_replace_dedupe(rows, "k"), "k", "v") == [("a", 3), ("b", 2)]


def test_keyed_refresh_report_and_foreign_keys(spark, data):
    new = data.routes.filter("route_id <> 'N90'").withColumn("route_desc", F.when(F.col("route_id") == "L10", "x").otherwise(F.col("route_desc")))
    new = new.unionByName(data.routes.limit(1).withColumn("route_id", F.lit("P1")))
    changes = merge.upsert_and_prune(data.routes, new, "route_id")
    assert dict(values(changes, "route_id", "change")) == {"L10": "updated", "L20": "unchanged", "F5": "unchanged", "N90": "deleted", "P1": "inserted"}
    merge.assert_droppable(changes.filter("change = 'deleted'"), data.positions, "route_id")
    with pytest.raises(ValueError, match="F5, L10, L20"):
        merge.assert_droppable(data.routes, data.positions, "route_id")


def test_matched_trip_is_cleared_but_kept(spark, data):
    matches = spark.createDataFrame([("L1", "V", "L10", "A1", "strict", 0.0, NOW), ("L2", "V", "R1", "gone", "strict", 0.0, NOW)], schemas.TRIP_MATCH)
    assert values(merge.fk_set_null(matches, data.trips).fillna("-"), "live_trip_id", "matched_trip_id", "match_type") == [
        ("L1", "A1", "strict"), ("L2", "-", "strict")]


def test_replace_rules(spark):
    current = spark.createDataFrame([("t", 1, "old", 9)], "trip_id string, stop_sequence int, stop_id string, zone_id int")
    pulled = spark.createDataFrame([("t", 1, "a", 1, 0), ("t", 1, "b", 2, 0), ("u", 1, "c", 2, 1)],
                                   "trip_id string, stop_sequence int, stop_id string, zone_id int, position int")
    assert values(merge.all_zones_or_nothing(current, pulled, [1, 2]), "trip_id", "stop_id") == [("t", "b"), ("u", "c")]
    assert values(merge.all_zones_or_nothing(current, pulled, [1, 2, 3]), "stop_id") == [("old",)]
    assert one(merge.zone_audit(pulled, [1, 2])) == {"pulled_rows": 3, "unique_rows": 2, "dropped_rows": 1, "complete": True}
    nothing = current.filter("false")
    assert values(merge.replace_if_nonempty(current, nothing), "stop_id") == [("old",)]
    assert values(merge.choose_replacement(current, nothing), "stop_id") == [("old",)]


DAY, T0 = date(2026, 10, 19), datetime(2026, 10, 19, 8)


def delay(spark, rows):
    names = "service_date date, trip_id string, stop_sequence bigint, stop_id string, arrival_delay_s int, departure_delay_s int, stop_status string, implausible boolean"
    return spark.createDataFrame(rows, names)


def test_stop_delay_rounds(spark):
    big = 2445505881
    first = delay(spark, [(DAY, "T", big, "S", 10, None, "SCHEDULED", False), (DAY, "T", 2, "S", None, None, None, False)])
    empty = spark.createDataFrame([], schemas.STOP_DELAY)
    stored = merge.stop_delay_merge(empty, first, T0)
    second = delay(spark, [(DAY, "T", big, "S", 20, None, "SCHEDULED", False), (DAY, "T", 2, "S", None, None, None, False), (DAY, "U", 1, "S", 0, 0, None, False)])
    assert one(merge.stop_delay_counts(stored, second)) == {"inserted": 1, "changed": 1}
    later = T0 + timedelta(minutes=15)
    merged = {(r["trip_id"], r["stop_sequence"]): r for r in merge.stop_delay_merge(stored, second, later).collect()}
    assert merged["T", big]["changes"] == 1 and merged["T", big]["first_seen"] == T0 and merged["T", big]["last_seen"] == later
    assert merged["T", 2]["changes"] == 0 and merged["T", 2]["last_seen"] == T0
    assert merged["U", 1]["first_seen"] == later
    full = stored.withColumn("changes", F.lit(32767).cast("smallint"))
    assert {r["changes"] for r in merge.stop_delay_merge(full, second, later).filter(f"stop_sequence = {big}").collect()} == {32767}


def test_trip_status_keeps_first_cancellation(spark):
    names = "service_date date, trip_id string, zone_id smallint, route_id string, start_time string, status string, stops_total int, stops_skipped int, stops_with_delay int, max_delay_s int"
    row = lambda trip, status: (DAY, trip, 1, "R", "08:00:00", status, 3, 0, 1, 5)
    frame = lambda rows: spark.createDataFrame(rows, names)
    table = spark.createDataFrame([], schemas.TRIP_STATUS)
    for i, rows in enumerate([[row("A", "SCHEDULED"), row("B", "CANCELED")], [row("A", "CANCELED"), row("B", "SCHEDULED")], [row("B", "CANCELED")]]):
        table = merge.trip_status_merge(table, frame(rows), T0 + timedelta(minutes=i), i)
    got = {r["trip_id"]: r for r in table.collect()}
    assert got["A"]["canceled_at"] == T0 + timedelta(minutes=1) and got["A"]["last_seen"] == T0 + timedelta(minutes=1)
    assert got["B"]["canceled_at"] == T0 and got["B"]["first_seen"] == T0 and got["B"]["poll_id"] == 2


def test_vehicle_dimension_keeps_known_label(spark):
    old = spark.createDataFrame([("V1", "bus 1", T0, T0), ("V2", None, T0, T0)], "vehicle_id string, label string, first_seen timestamp, last_seen timestamp")
    batch = spark.createDataFrame([("V1", None, 1), ("V2", "bus 2", 1), ("V3", None, 1)], "vehicle_id string, label string, ts bigint")
    later = T0 + timedelta(minutes=1)
    merged = {r["vehicle_id"]: (r["label"], r["first_seen"], r["last_seen"]) for r in merge.seen_dimension_merge(old, batch, later).collect()}
    assert merged == {"V1": ("bus 1", T0, later), "V2": ("bus 2", T0, later), "V3": (None, later, later)}


def test_pull_log_keeps_newest_success(spark):
    log = spark.createDataFrame([(100, 3, 5), (200, 3, 9), (300, 1, 1), (350, 3, 0)], "pulled_at bigint, check_no int, row_count int")
    assert values(merge.pull_log_retention(log, 1000), "pulled_at") == [(200,), (300,), (350,)]
    assert values(merge.pull_log_retention(log, 250), "pulled_at") == [(200,), (300,), (350,)]
    assert values(merge.pull_log_retention(log.filter("row_count = 0"), 1000), "pulled_at") == []
