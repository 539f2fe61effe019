import json
from datetime import date

import pytest
from conftest import NOW, one, values
from pyspark.sql import functions as F

from fleetlens.functions import clock, parse
from fleetlens.functions.measures import metric_class
from fleetlens.sources import csv_lines, feeds, scans, static_csv


def column(spark, texts, build):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(frame.select("i", build("t").alias("o")).collect())]


def test_scalars(spark):
    assert column(spark, ["08:00:30", "25:00:30", "8:00", "x:1:2", None, "999999999:0:0"], clock.schedule_seconds) == [28830, 90030, None, None, None, None]
    assert column(spark, ["19102026", "20261019", "000000", "00000000", "31022026", None, "N/A"], parse.service_date) == [
        date(2026, 10, 19), date(2026, 10, 19), None, None, None, None, None]
    assert column(spark, ["12", " 7 ", "3.0", "x", "", None], parse.to_int) == [12, 7, None, None, None, None]
    assert column(spark, ["12.9", "N/A", "", " 5 ", "x"], parse.clean_int) == [12, None, None, 5, None]
    odd = ["500D", "12f", "1e3", "-.5", "+7.", "0x1p3", "1_0", "NaN", "Infinity", " \t3 "]
    assert column(spark, odd, parse.clean_float) == [None, None, 1000.0, -0.5, 7.0, None, None, None, None, 3.0]
    assert column(spark, ["12f", "9L", "40"], parse.to_int) == [None, None, 40]
    assert column(spark, ["1", "0", "N/A", None], parse.clean_flag) == [True, False, None, None]
    assert column(spark, ["0", "-5", "100"], lambda c: parse.clean_epoch(c, 40)) == [None, None, 60]


def test_metric_class(spark):
    values_ = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 100.0, 500.0, None)], "v double")
    got = [r[0] for r in values_.select(metric_class("v", 0, 100)).collect()]
    assert got == [0, 0, 1, 6, 6, None]
    assert [r[0] for r in values_.select(metric_class("v", 0, 100, reverse=True)).collect()] == [6, 6, 5, 0, 0, None]


def test_static_csv(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes('﻿stop_id,extra,stop_name,stop_lat,stop_lon\nS1,x,"Gate ""A"", north",28.6,77.2\nS2,y,Plain,n/k,\n'.encode("utf-8"))
    rows = static_csv.static_csv_scan(spark, str(tmp_path), "stops")
    assert [tuple(r) for r in rows.orderBy("stop_id").collect()] == [("S1", None, 'Gate "A", north', 28.6, 77.2), ("S2", None, "Plain", None, None)]
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,24:10:00,24:10:30,S1,2445505881\n")
    row = one(static_csv.static_csv_scan(spark, str(tmp_path), "stop_times"))
    assert (row["arrival_s"], row["departure_s"], row["stop_sequence"]) == (87000, 87030, 2445505881)
    assert static_csv.static_csv_scan(spark, str(tmp_path), "shapes").isEmpty()


def messages(spark, payloads, **more):
    return spark.createDataFrame([(i, json.dumps(p), *more.values()) for i, p in enumerate(payloads)],
                                 "message_id bigint, data string" + "".join(f", {k} int" for k in more))


def test_position_feed(spark):
    vehicle = lambda vid, label=None, ts=5: {"vehicle": {"id": vid, "label": label}, "timestamp": ts, "trip": {"trip_id": ""}}
    feed = {"header": {"timestamp": 9}, "entity": [
        {"id": "e1", "vehicle": {**vehicle(" V1 "), "position": {"latitude": 1.5, "longitude": 2.5}}},
        {"id": "e2", "vehicle": vehicle("", "L2", 0)}, {"id": "e3", "vehicle": vehicle("", "")}, {"id": "", "vehicle": vehicle("")},
        {"id": "alert"}]}
    frame = messages(spark, [feed, {"header": {}, "entity": []}]).withColumnRenamed("data", "body")
    rows = feeds.position_feed_flatten(frame, NOW)
    assert values(rows, "vehicle_id", "ts") == [("L2", 9), ("V1", 5), ("e3", 5)]
    first = one(rows.filter("vehicle_id = 'V1'"))
    assert first["lat"] == 1.5 and first["trip_id"] is None and first["speed"] is None


def test_envelope(spark):
    bodies = [{"Data": {"a": 1}, "IsSuccess": True}, {"IsSuccess": False, "Message": "down"}, {"status": "Error", "errorMessage": "bad"}, [1], {"x": 1}, {"IsSuccess": None}]
    got = feeds.json_envelope_split(messages(spark, bodies).withColumnRenamed("data", "body")).orderBy("message_id").collect()
    assert [r["ok"] for r in got] == [True] + [False] * 5
    assert json.loads(got[0]["data"]) == {"a": 1}
    assert [r["error"] for r in got] == [None, "down", "bad", "response is not a JSON object", "unrecognised response shape", "IsSuccess=false"]


def test_vehicle_messages(spark):
    def entity(vid, ts, bearing="0", lat="12.9"):
        return {"vehicle": {"trip": {"trip_id": "N/A", "start_date": "20261019", "schedule_relationship": "SCHEDULED"},
                            "position": {"latitude": lat, "longitude": "77.5", "bearing": bearing}, "timestamp": str(ts + 19_800),
                            "vehicle": {"id": vid, "label": " "}}}
    payload = {"entity": [entity("1", NOW), entity("2", NOW - 10, "5"), entity("2", NOW - 5, "7"), entity("2", NOW - 5, "9"),
                          entity("3", NOW - 73 * 3600), entity("4", NOW, lat=None), entity("", NOW)]}
    rows, audit = feeds.vehicle_json_flatten(messages(spark, [payload]), NOW)
    assert values(rows, "vehicle_id", "ts") == [("1", NOW), ("2", NOW - 5)]
    got = {r["vehicle_id"]: r for r in rows.collect()}
    assert got["1"]["bearing"] is None and got["2"]["bearing"] == 7.0
    assert got["1"]["trip_id"] is None and got["1"]["label"] is None and got["1"]["scheduled"] and got["1"]["start_date"] == date(2026, 10, 19)
    assert one(audit) == {"message_id": 0, "entities": 7, "stale": 1}


def test_trip_messages(spark):
    update = lambda seq, arr, dep, status="SCHEDULED": {"stop_sequence": seq, "arrival": {"delay": arr}, "departure": {"delay": dep}, "stop_id": "S", "schedule_relationship": status}
    trip = lambda tid, day, ups: {"trip_update": {"trip": {"trip_id": tid, "start_date": day, "route_id": "R"}, "stop_time_update": ups}}
    ups = [update(2444805176, 120, 130), update(2, None, None, "SKIPPED"), update(3, 9000, 10), update(4, -60, -60), update(None, 1, 1)]
    payload = {"entity": [trip("T", "19102026", []), trip("T", "19102026", ups), trip("", "19102026", ups), trip("X", "000000", ups)]}
    trips, stops = feeds.trip_update_flatten(messages(spark, [payload], zone_id=3))
    row = one(trips)
    assert (row["stops_total"], row["stops_skipped"], row["stops_with_delay"], row["max_delay_s"]) == (4, 1, 3, 120)
    assert values(stops.filter("implausible"), "stop_sequence") == [(3,)]
    assert (2444805176,) in values(stops, "stop_sequence") and stops.count() == 4


def pulls(spark, *lines):
    return spark.createDataFrame([(1, list(lines))], "pull_id int, lines array<string>")


def test_csv_lines(spark):
    rows, audit = csv_lines.csv_lines_scan(pulls(spark, "stop_id,stop_name,stop_lat,stop_lon,zone", 'S1,"A, ""b""",1.5,2,z', "S2,short", " ", "S1,again,1,2,z", ",nokey,1,2,z"), "stops")
    assert values(rows, "stop_id", "stop_name", "stop_lat") == [("S1", 'A, "b"', 1.5)]
    assert one(audit) == {"pull_id": 1, "row_count": 1, "bad_rows": 3, "resplit": False, "unknown_columns": "zone"}
    long, stray = "x" * 100_000, 'six "o clock" stop'
    rows, audit = csv_lines.csv_lines_scan(pulls(
        spark, "zone,stop_id,stop_name,stop_lat,stop_lon", ",S1,,1.0,2.0", f'z,S2,"{long}, ""q""",1.5,', f"z,S3,{stray},3,4", 'z,S4,"",5,6',
        'z,S5,"' + '""' * 20_000 + '",5,6'), "stops")
    named = {r["stop_id"]: r["stop_name"] for r in rows.collect()}
    assert named == {"S1": None, "S2": long + ', "q"', "S3": stray, "S4": None, "S5": '"' * 20_000}
    assert one(audit)["bad_rows"] == 0
    rows, audit = csv_lines.csv_lines_scan(pulls(spark, "agency_id,agency_name,agency_url", "1,One,https://a.b/c2,Two,http://x.y/z31,Three,https://q"), "agency")
    assert values(rows, "agency_id", "agency_url") == [("1", "https://a.b/c"), ("2", "http://x.y/z"), ("31", "https://q")]
    assert one(audit)["resplit"]
    rows, _ = csv_lines.csv_lines_scan(pulls(spark, "service_id,monday,sunday,start_date,end_date", "W,1,0,20261018,000000"), "calendar")
    day = one(rows)
    assert (day["monday"], day["sunday"], day["tuesday"], day["start_date"], day["end_date"]) == (True, False, None, date(2026, 10, 18), None)
    rows, audit = csv_lines.csv_lines_scan(pulls(spark, "trip_id,stop_sequence"), "stop_times")
    assert rows.isEmpty() and one(audit)["row_count"] == 0


def test_scans(data):
    assert scans.time_window(data.positions, NOW - 5400, NOW - 45).filter("vehicle_id = 'TRAM-7'").count() == 2
    assert [r["polled_at"] for r in scans.rows_since(data.polls, NOW - 340, "polled_at").collect()] == [NOW - 340, NOW - 280, NOW - 220]
    assert [r["polled_at"] for r in scans.most_recent(data.polls, 1, "polled_at").collect()] == [NOW - 220]


def test_window_prunes_days(spark, data, tmp_path):
    from fleetlens.plans import fold, tables
    tables.append_log(data.positions, str(tmp_path / "log"), 0)
    log = tables.read_table(spark, str(tmp_path / "log"), fold.LOG_SCHEMA)
    plan = scans.time_window(log, NOW - 60, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("text,records", [
    ("", []), ("7,North,http://a/", ["7,North,http://a/"]),
    ("1,A,http://a/x2,B,https://b/y", ["1,A,http://a/x", "2,B,https://b/y"]),
    ("1,A,http://a/,zone,en12,B b,http://b/,zone,en", ["1,A,http://a/,zone,en", "12,B b,http://b/,zone,en"]),
    ("1,A,http://a/,080,B,http://b/", ["1,A,http://a/,080,B,http://b/"]),          # a number behind a comma is a field
    ("A,http://a/ 3,,http://c/", ["A,http://a/ ", "3,,http://c/"]), ("no address 4,x", ["no address 4,x"]),
    (",http://a/5http://b/", [",http://a/5http://b/"])])
def test_agency_records_are_cut_at_number_name_and_address(spark, text, records):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(csv_lines.regex_split_records(F.col("t"))).first()[0] == records


def test_values_of_an_update_are_made_once(spark):
    """Uses of a value inside a lambda multiply: the plan of the stops held 123 trims before values were bound."""
    _, stops = feeds.trip_update_flatten(messages(spark, [{"entity": []}], zone_id=3))
    assert stops._jdf.queryExecution().optimizedPlan().toString().count("trim(") < 60
