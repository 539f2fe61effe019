"""Sources: files and feed messages built from the driver tables, read back by the operators."""

from pyspark.sql import functions as F

from ...session import shared_dir
from ...sources import csv_lines, feeds, static_csv
from .. import static_load as static_load_job
from ..driver_tables import NOW_FAST
from .registry import query


@query("static_csv_scan", "SELECT stop_id, stop_code, CASE WHEN stop_id LIKE '%7' THEN stop_name || ', \"north\"' ELSE stop_name END AS stop_name, "
       "round(stop_lat, 6) AS stop_lat, CASE WHEN stop_id LIKE '%3' THEN NULL ELSE round(stop_lon, 6) END AS stop_lon FROM stops_v")
def static_csv_scan(t):
    folder = shared_dir(t.spark, "static")
    written = t.stops.select(
        F.lit("x").alias("zone_extra"), "stop_code", "stop_id",
        F.when(F.col("stop_id").endswith("7"), F.concat("stop_name", F.lit(', "north"'))).otherwise(F.col("stop_name")).alias("stop_name"),
        "stop_lat", F.when(F.col("stop_id").endswith("3"), "n/k").otherwise(F.col("stop_lon").cast("string")).alias("stop_lon"))
    written.write.csv(f"{folder}/stops.txt", header=True, quote='"', escape='"')
    scanned = static_csv.static_csv_scan(t.spark, folder, "stops")
    return scanned.withColumn("stop_lat", F.round("stop_lat", 6)).withColumn("stop_lon", F.round("stop_lon", 6))


def position_entity():
    """The entity of one event; some lack an id, some carry a label, some have no time of their own."""
    eid = F.col("arrival")
    vehicle = F.struct(
        F.struct(F.coalesce("trip_id", F.lit("")).alias("trip_id"), F.coalesce("route_id", F.lit("")).alias("route_id")).alias("trip"),
        F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "bearing", "speed")).alias("position"),
        F.when(eid % 9 == 0, F.lit(0)).otherwise(F.col("ts")).alias("timestamp"), F.lit("").alias("stop_id"), "current_status",
        F.struct(F.when(eid % 6 == 0, "").otherwise(F.col("vehicle_id")).alias("id"),
                 F.when(eid % 12 == 6, F.concat(F.lit(" L"), "vehicle_id")).alias("label")).alias("vehicle"))
    return F.struct(F.concat(F.lit("E"), eid).alias("id"), vehicle.alias("vehicle"))


def position_messages(t):
    """One message per event: an entity with a vehicle and one without."""
    eid = F.col("arrival")
    nothing = F.struct(F.lit("alert").alias("id"), F.lit(None).cast(vehicle_type(t)).alias("vehicle"))
    entities = F.array(position_entity(), nothing)
    body = F.to_json(F.struct(F.struct((F.col("ts") + 3).alias("timestamp")).alias("header"), entities.alias("entity")))
    return t.positions_fast.select(eid.alias("message_id"), body.alias("body"))


def vehicle_type(t) -> str:
    return ("struct<trip:struct<trip_id:string,route_id:string>,position:struct<latitude:double,longitude:double,bearing:double,"
            "speed:double>,timestamp:bigint,stop_id:string,current_status:int,vehicle:struct<id:string,label:string>>")


_FLAT = ("SELECT arrival AS message_id, CASE WHEN arrival % 12 = 0 THEN 'E' || arrival WHEN arrival % 12 = 6 THEN 'L' || vehicle_id ELSE vehicle_id END AS vehicle_id, "
         "CASE WHEN arrival % 9 = 0 THEN ts + 3 ELSE ts END AS ts, trip_id, route_id, lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon, "
         "CASE WHEN lat IS NOT NULL THEN bearing END AS bearing, CASE WHEN lat IS NOT NULL THEN speed END AS speed, current_status FROM positions_fast_v")


@query("position_feed_flatten", _FLAT)
def position_feed_flatten(t):
    rows = feeds.position_feed_flatten(position_messages(t), NOW_FAST)
    return rows.select("message_id", "vehicle_id", "ts", "trip_id", "route_id", "lat", "lon", "bearing", "speed", "current_status")


@query("json_envelope_split", "SELECT event_id, event_id % 7 = 0 AS ok, CASE WHEN event_id % 7 = 0 THEN '{\"n\":' || event_id || '}' END AS data, "
       "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no data ' || event_id WHEN 2 THEN 'boom' WHEN 3 THEN 'IsSuccess=false' WHEN 4 THEN 'denied' "
       "WHEN 5 THEN 'response is not a JSON object' ELSE 'unrecognised response shape' END AS error FROM events_v")
def json_envelope_split(t):
    eid = F.col("event_id")
    shapes = ['{"Data":{"n":%d},"IsSuccess":true}', '{"Data":null,"IsSuccess":false,"Message":"no data %d"}',
              '{"IsSuccess":false,"Message":"m%d","Exception":"boom"}', '{"IsSuccess":false,"Message":"","n":%d}',
              '{"status":"Error","errorMessage":"denied","n":%d}', "[%d]", '{"other":%d}']
    body = None
    for i, shape in enumerate(shapes):
        made = F.format_string(shape, eid)
        body = F.when(eid % 7 == i, made) if body is None else body.when(eid % 7 == i, made)
    return feeds.json_envelope_split(t.raw_events.select("event_id", body.alias("body"))).select("event_id", "ok", "data", "error")


def vehicle_messages(t):
    """Two reports of one vehicle per message (the later one newer or equal), stamped in local time."""
    eid, text = F.col("arrival"), lambda c: c.cast("string")
    def entity(stamp, bearing):
        return F.struct(F.struct(
            F.struct(F.coalesce("trip_id", F.lit("N/A")).alias("trip_id"), F.lit("20240105").alias("start_date"),
                     F.when(eid % 2 == 0, "SCHEDULED").otherwise("ADDED").alias("schedule_relationship"),
                     F.col("route_id")).alias("trip"),
            F.struct(text(F.col("lat")).alias("latitude"), text(F.col("lon")).alias("longitude"), text(bearing).alias("bearing")).alias("position"),
            text(stamp + 19_800).alias("timestamp"),
            F.struct(F.col("vehicle_id").alias("id"), F.lit(" ").alias("label")).alias("vehicle")).alias("vehicle"))
    both = F.array(entity(F.col("ts"), F.lit(0)), entity(F.col("ts") + eid % 3 - 1, F.lit(7)))
    return t.positions_fast.select(eid.alias("message_id"), F.to_json(F.struct(both.alias("entity"))).alias("data"))


_KEEP = NOW_FAST - 7200
_PLACED = "lat IS NOT NULL AND lon IS NOT NULL"


@query("vehicle_json_flatten", "SELECT arrival AS message_id, vehicle_id, CAST(NULL AS VARCHAR) AS label, "
       f"CASE WHEN arrival % 3 = 2 THEN ts + 1 ELSE ts END AS ts, lat, lon, CASE WHEN arrival % 3 = 2 THEN 7e0 END AS bearing, trip_id, route_id, "
       f"DATE '2024-01-05' AS start_date, arrival % 2 = 0 AS scheduled FROM positions_fast_v WHERE {_PLACED} AND "
       f"CASE WHEN arrival % 3 = 2 THEN ts + 1 ELSE ts END >= {_KEEP}")
def vehicle_json_flatten(t):
    rows, _ = feeds.vehicle_json_flatten(vehicle_messages(t), NOW_FAST, retention_s=7200)
    return rows.select("message_id", "vehicle_id", "label", "ts", "lat", "lon", "bearing", "trip_id", "route_id", "start_date", "scheduled")


@query("vehicle_json_audit", f"SELECT arrival AS message_id, CAST(2 AS BIGINT) AS entities, CAST(CASE WHEN {_PLACED} THEN (ts < {_KEEP})::INT + "
       f"(ts + arrival % 3 - 1 < {_KEEP})::INT ELSE 0 END AS BIGINT) AS stale FROM positions_fast_v")
def vehicle_json_audit(t):
    return feeds.vehicle_json_flatten(vehicle_messages(t), NOW_FAST, retention_s=7200)[1]


def trip_messages(t, delays=None):
    """One message per order: its trip (given twice) with at most one update per line number."""
    delays = t.delays if delays is None else delays
    update = F.struct(
        F.col("stop_sequence").cast("string").alias("stop_sequence"), F.struct(F.col("arrival_delay_s").cast("string").alias("delay")).alias("arrival"),
        F.struct(F.col("departure_delay_s").cast("string").alias("delay")).alias("departure"), "stop_id",
        F.col("stop_status").alias("schedule_relationship"))
    status = F.when(F.col("order_status") == "F", "CANCELED").otherwise("SCHEDULED")
    grouped = delays.groupBy("order_key", "trip_id", "service_date", status.alias("status")).agg(
        F.collect_list(update).alias("updates"))
    def entity(updates):
        trip = F.struct("trip_id", F.date_format("service_date", "ddMMyyyy").alias("start_date"),
                        F.col("status").alias("schedule_relationship"), F.concat(F.lit("R"), F.col("order_key") % 25).alias("route_id"))
        return F.struct(F.struct(trip.alias("trip"), updates.alias("stop_time_update")).alias("trip_update"))
    body = F.to_json(F.struct(F.array(entity(F.slice("updates", 1, 0)), entity(F.col("updates"))).alias("entity")))
    # The year 1992-1999 of an order is outside the feed's plausible years, so dates move ten years on.
    moved = grouped.withColumn("service_date", F.date_add("service_date", 3650))
    return moved.select(F.col("order_key").alias("message_id"), (F.col("order_key") % 7).cast("int").alias("zone_id"), body.alias("data"))


@query("trip_update_flatten", "SELECT service_date + 3650 AS service_date, trip_id, stop_sequence, stop_id, arrival_delay_s, arrival_delay_s + 15 AS departure_delay_s, "
       "stop_status, coalesce(abs(arrival_delay_s) > 7200 OR abs(arrival_delay_s + 15) > 7200, false) AS implausible FROM delays_v")
def trip_update_flatten(t):
    _, stops = feeds.trip_update_flatten(trip_messages(t))
    return stops.drop("message_id")


@query("trip_update_summary", "SELECT service_date + 3650 AS service_date, trip_id, CAST(order_key % 7 AS INT) AS zone_id, 'R' || (order_key % 25) AS route_id, "
       "CASE WHEN order_status = 'F' THEN 'CANCELED' ELSE 'SCHEDULED' END AS status, CAST(count(*) AS INT) AS stops_total, "
       "CAST(count(*) FILTER (WHERE stop_status = 'SKIPPED') AS INT) AS stops_skipped, CAST(count(arrival_delay_s) AS INT) AS stops_with_delay, "
       "max(arrival_delay_s) FILTER (WHERE abs(arrival_delay_s) <= 7200 AND abs(arrival_delay_s + 15) <= 7200) AS max_delay_s "
       "FROM delays_v GROUP BY 1, 2, 3, 4, 5")
def trip_update_summary(t):
    trips, _ = feeds.trip_update_flatten(trip_messages(t))
    return trips.drop("message_id", "start_time")


def stop_pulls(t):
    """Fifty stops per pull as CSV lines, with a short line, a repeated line and an unknown column."""
    stop = F.concat_ws(",", F.col("stop_id"), F.concat(F.lit('"'), "stop_name", F.lit(', old"')), F.lit("z"),
                       F.col("stop_lat").cast("string"), F.col("stop_lon").cast("string"))
    key = F.substring("stop_id", 2, 20).cast("bigint")
    groups = t.stops.withColumn("line", stop).groupBy(F.call_function("div", key, F.lit(50)).alias("pull_id")).agg(
        F.array_sort(F.collect_list("line")).alias("body"))
    header = F.array(F.lit("stop_id,stop_name,zone,stop_lat,stop_lon"))
    lines = F.concat(header, F.col("body"), F.array(F.lit("short,line"), F.lit(" ")), F.slice("body", 1, 1))
    return groups.select("pull_id", lines.alias("lines"))


@query("csv_lines_scan", "SELECT CAST(substr(stop_id, 2) AS BIGINT) // 50 AS pull_id, stop_id, stop_name || ', old' AS stop_name, round(stop_lat, 6) AS stop_lat, "
       "round(stop_lon, 6) AS stop_lon FROM stops_v")
def csv_lines_scan(t):
    rows, _ = csv_lines.csv_lines_scan(stop_pulls(t), "stops")
    return rows.withColumn("stop_lat", F.round("stop_lat", 6)).withColumn("stop_lon", F.round("stop_lon", 6))


@query("csv_lines_audit", "SELECT CAST(substr(stop_id, 2) AS BIGINT) // 50 AS pull_id, count(*) AS row_count, CAST(2 AS BIGINT) AS bad_rows, false AS resplit, "
       "'zone' AS unknown_columns FROM stops_v GROUP BY 1")
def csv_lines_audit(t):
    return csv_lines.csv_lines_scan(stop_pulls(t), "stops")[1]


@query("csv_lines_agency", "SELECT c_custkey // 5 AS pull_id, CAST(c_custkey AS VARCHAR) AS agency_id, c_name AS agency_name, 'https://a.example/x' AS agency_url FROM customer")
def csv_lines_agency(t):
    record = F.concat_ws(",", "c_custkey", "c_name", F.lit("https://a.example/x"))
    pulls = t.table("customer").groupBy(F.call_function("div", F.col("c_custkey"), F.lit(5)).alias("pull_id")).agg(
        F.array_join(F.array_sort(F.collect_list(record)), "").alias("line")).select(
        "pull_id", F.array(F.lit("agency_id,agency_name,agency_url"), F.col("line")).alias("lines"))
    rows, _ = csv_lines.csv_lines_scan(pulls, "agency")
    return rows.select("pull_id", "agency_id", "agency_name", "agency_url")


@query("static_load", "SELECT stop_id, CASE WHEN CAST(substr(stop_id, 2) AS BIGINT) % 10 = 0 THEN stop_name || ' again' ELSE stop_name END AS stop_name, round(stop_lat, 6) AS stop_lat, "
       f"CAST({NOW_FAST} AS BIGINT) AS loaded_at FROM stops_v")
def static_load(t):
    """One file where every tenth stop is given twice; the later row stays."""
    folder, root = shared_dir(t.spark, "static"), shared_dir(t.spark, "schedule")
    again = t.stops.filter(F.substring("stop_id", 2, 20).cast("bigint") % 10 == 0).withColumn("stop_name", F.concat("stop_name", F.lit(" again")))
    t.stops.unionByName(again).coalesce(1).write.csv(f"{folder}/stops.txt", header=True)
    static_load_job.load(t.spark, folder, root, NOW_FAST)
    loaded = static_load_job.read(t.spark, root, "stops")
    return loaded.select("stop_id", "stop_name", F.round("stop_lat", 6).alias("stop_lat"), F.lit(static_load_job.loaded_at(t.spark, root)).cast("bigint").alias("loaded_at"))
