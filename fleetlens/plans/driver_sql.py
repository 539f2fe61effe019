"""The transit views of ``driver_tables`` as SQL for an independent engine.

``compose`` prefixes a query with the views it names, in dependency order.
"""

import re

from ..constants import (EARTH_RADIUS_M, GRID_LAT_DEG, GRID_LON_DEG, METRES_PER_DEGREE)
from .driver_tables import BASE_TS, FAST_FACTOR, NOW, NOW_FAST

LAT_STEP, LON_STEP = f"{GRID_LAT_DEG!r}e0", f"{GRID_LON_DEG!r}e0"


def kmh(x):
    return f"round(({x})*3.6e0, 1)"


def pct(part, total):
    return f"CASE WHEN {total} > 0 THEN round(coalesce({part},0)*100e0/{total}, 1) END"


def planar(lat1, lon1, lat2, lon2):
    return (f"sqrt(power(radians({lat2}-{lat1})*{EARTH_RADIUS_M}e0, 2) + "
            f"power(radians({lon2}-{lon1})*{EARTH_RADIUS_M}e0*cos(radians(({lat1}+{lat2})/2e0)), 2))")


def tangent(lat, lon, plat, plon):
    return (f"sqrt(power(({lat}-{plat})*{METRES_PER_DEGREE}e0, 2) + "
            f"power(({lon}-{plon})*{METRES_PER_DEGREE}e0*greatest(cos(radians({plat})), 1e-9), 2))")


MOVING = "(speed > 0.5e0 AND speed < 20e0)"
_TRIP_ID = ("'R' || ({k} % 25) || '_' || lpad(CAST(({k} // 25) % 30 AS VARCHAR), 2, '0') || '_' || "
            "lpad(CAST(({k} // 750) % 60 AS VARCHAR), 2, '0') || '_' || {k}")
_DEPARTURE = "(({k} // 25) % 30) * 3600 + (({k} // 750) % 60) * 60"


def _hms(seconds):
    pad = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"{pad(f'({seconds}) // 3600')} || ':' || {pad(f'({seconds}) % 3600 // 60')} || ':' || {pad(f'({seconds}) % 60')}"


_POSITION_COLUMNS = """
    CASE WHEN event_type <> 'error' THEN trip END AS trip_id,
    CASE WHEN event_id % 97 = 0 THEN 'RX' WHEN event_id % 53 = 0 THEN NULL
         ELSE 'R' || (user_id % 20) END AS route_id,
    CASE WHEN event_id % 13 <> 0 THEN CASE WHEN event_id % 101 = 0 THEN 0e0
         ELSE 28.5e0 + 0.002e0*k + 0.00002e0*((event_id*7) % 100) END END AS lat,
    CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN CASE WHEN event_id % 101 = 0 THEN 0e0
         ELSE 77.1e0 + 0.002e0*((k*37) % 100) + 0.00002e0*((event_id*13) % 100) END END AS lon,
    CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS bearing,
    CASE WHEN event_id % 11 <> 0 THEN greatest(value/11.9371e0 - 1e0, 0e0) END AS speed,
    CAST(NULL AS VARCHAR) AS stop_id,
    CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS INT) END AS current_status,
    CAST(NULL AS INT) AS congestion_level, CAST(NULL AS INT) AS occupancy_status,
    ts + 5 + event_id % 20 AS ingested_at, event_id AS arrival"""

VIEWS = {
    "agency_v": "SELECT 'A' || r_regionkey AS agency_id, r_name AS agency_name FROM region",
    "routes_v": "SELECT 'R' || n_nationkey AS route_id, 'A' || n_regionkey AS agency_id, "
                "n_name AS route_short_name, 'Line ' || n_nationkey AS route_long_name, "
                "'Via ' || n_name AS route_desc, 3 AS route_type FROM nation",
    "stops_v": "SELECT 'S' || c_custkey AS stop_id, 'C' || c_custkey AS stop_code, c_name AS stop_name, "
               "28.5e0 + 0.0005e0*((c_custkey*37) % 400) AS stop_lat, "
               "77.1e0 + 0.0005e0*((c_custkey*91) % 400) AS stop_lon FROM customer",
    "trips_v": f"SELECT {_TRIP_ID.format(k='o_orderkey')} AS trip_id, 'R' || (o_orderkey % 25) AS route_id, "
               "'WD' AS service_id, o_orderpriority AS trip_headsign, CAST(o_orderkey % 2 AS INT) AS direction_id, "
               "CASE WHEN o_orderkey % 25 = 24 THEN NULL WHEN (o_orderkey // 25) % 5 = 0 "
               "THEN 'SH' || (o_orderkey % 25) || 's' ELSE 'SH' || (o_orderkey % 25) END AS shape_id FROM orders",
    "lines_v": "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate "
               "FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "stop_times_v": f"SELECT {_TRIP_ID.format(k='l_orderkey')} AS trip_id, 'S' || l_suppkey AS stop_id, "
                    "CAST(l_linenumber AS BIGINT) AS stop_sequence, "
                    f"{_hms(_DEPARTURE.format(k='l_orderkey') + ' + l_linenumber*300 - 30')} AS arrival_time, "
                    f"{_hms(_DEPARTURE.format(k='l_orderkey') + ' + l_linenumber*300')} AS departure_time, "
                    f"CAST({_DEPARTURE.format(k='l_orderkey')} + l_linenumber*300 - 30 AS INT) AS arrival_s, "
                    f"CAST({_DEPARTURE.format(k='l_orderkey')} + l_linenumber*300 AS INT) AS departure_s FROM lines_v",
    "shapes_v": "SELECT 'SH' || c_nationkey || tag AS shape_id, CAST(c_custkey AS INT) AS shape_pt_sequence, "
                "28.5e0 + 0.0005e0*((c_custkey*37) % 400) AS shape_pt_lat, "
                "77.1e0 + 0.0005e0*((c_custkey*91) % 400) AS shape_pt_lon "
                "FROM customer JOIN (VALUES (''), ('s')) AS tags(tag) ON tag = '' OR c_custkey % 2 = 0 "
                "WHERE c_nationkey <> 24",
    "events_v": "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, "
                "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS k FROM events",
    "positions_v": "SELECT 'V' || user_id AS vehicle_id, ts," + _POSITION_COLUMNS + " FROM ("
                   "SELECT *, epoch_s AS ts, CASE WHEN event_id % 31 = 0 THEN 'garbage-' || event_id "
                   f"WHEN event_id % 41 = 0 THEN {_TRIP_ID.format(k='event_id')} "
                   "ELSE 'R' || (user_id % 20) || '_' || lpad(CAST(epoch_s % 86400 // 3600 AS VARCHAR), 2, '0') "
                   "|| '_' || lpad(CAST(epoch_s % 3600 // 60 AS VARCHAR), 2, '0') || '_' || event_id END AS trip "
                   "FROM events_v)",
    "positions_fast_v": "SELECT 'V' || user_id AS vehicle_id, ts," + _POSITION_COLUMNS + " FROM ("
                        f"SELECT *, {BASE_TS} + off AS ts, 'R' || (user_id % 20) || '_' || "
                        "lpad(CAST(off // 1200 // 3 + 5 AS VARCHAR), 2, '0') || '_' || "
                        "lpad(CAST((off // 1200 % 3) * 20 AS VARCHAR), 2, '0') || '_' || user_id AS trip "
                        f"FROM (SELECT *, (epoch_s - {BASE_TS}) // {FAST_FACTOR} AS off FROM events_v))",
    "log_fast_v": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, ts "
                  "ORDER BY arrival) AS rn FROM positions_fast_v) WHERE rn = 1",
    "latest_fast_v": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id "
                     "ORDER BY ts DESC, arrival DESC) AS rn FROM positions_fast_v) WHERE rn = 1",
    "polls_v": f"SELECT {BASE_TS} + (slot + 1)*30 AS polled_at, CASE WHEN good THEN 1 ELSE 0 END AS ok, "
               "'feed' AS source, CASE WHEN good THEN 200 WHEN first % 5 = 0 THEN 503 WHEN first % 5 = 1 THEN 404 "
               "WHEN first % 5 = 2 THEN 200 END AS http_status, "
               "CAST(CASE WHEN good OR first % 5 = 4 THEN n ELSE 0 END AS INT) AS entity_count, "
               "CAST(CASE WHEN good AND first % 6 <> 0 THEN vehicles ELSE 0 END AS INT) AS new_rows, "
               "CASE WHEN good AND first % 10 <> 0 THEN newest END AS feed_timestamp, "
               "CASE WHEN first % 8 <> 0 THEN 200 + first % 400 END AS latency_ms, "
               "CASE WHEN NOT good THEN CASE WHEN first % 5 = 3 THEN 'Request TIMED OUT' ELSE 'failed' END END AS error "
               "FROM (SELECT *, first % 7 <> 0 AS good FROM ("
               f"SELECT (ts - {BASE_TS}) // 30 AS slot, count(*) AS n, count(DISTINCT vehicle_id) AS vehicles, "
               "max(ts) AS newest, min(arrival) AS first FROM positions_fast_v GROUP BY 1))",
    "delays_v": "SELECT CAST(o_orderdate AS DATE) AS service_date, "
                f"{_TRIP_ID.format(k='l_orderkey')} AS trip_id, CAST(l_linenumber AS BIGINT) AS stop_sequence, "
                "'S' || l_suppkey AS stop_id, "
                "CAST(CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN "
                "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))*60 END AS INT) AS arrival_delay_s, "
                "CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN 'SKIPPED' ELSE 'SCHEDULED' END AS stop_status, "
                "l_orderkey + l_linenumber AS code, l_orderkey AS order_key, o_orderstatus AS order_status "
                "FROM lines_v JOIN orders ON l_orderkey = o_orderkey",
    "delays_stored_v": "SELECT service_date, trip_id, stop_sequence, stop_id, arrival_delay_s, "
                       "arrival_delay_s + 15 AS departure_delay_s, stop_status, "
                       "coalesce(abs(arrival_delay_s) > 7200, false) AS implausible FROM delays_v WHERE code % 5 <> 0",
    "delays_incoming_v": "SELECT service_date, trip_id, stop_sequence, stop_id, arrival_delay_s, departure_delay_s, "
                         "stop_status, coalesce(abs(arrival_delay_s) > 7200, false) AS implausible FROM ("
                         "SELECT * REPLACE (arrival_delay_s + CASE WHEN order_key % 3 = 0 THEN 60 ELSE 0 END "
                         "AS arrival_delay_s), arrival_delay_s + 15 AS departure_delay_s FROM delays_v WHERE code % 5 <= 2)",
    # Results of operators, written out independently.
    "grid_v": f"SELECT CAST(floor(lat/{LAT_STEP}) AS INT) AS cell_y, CAST(floor(lon/{LON_STEP}) AS INT) AS cell_x, "
              "ts - ts % 3600 AS hour_bucket, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles, "
              f"count(*) FILTER (WHERE {MOVING}) AS moving, count(*) FILTER (WHERE speed <= 0.5e0) AS stopped, "
              f"coalesce(sum(speed) FILTER (WHERE {MOVING}), 0e0) AS speed_sum, "
              f"count(*) FILTER (WHERE {MOVING}) AS speed_n, min(speed) FILTER (WHERE {MOVING}) AS speed_min, "
              f"max(speed) FILTER (WHERE {MOVING}) AS speed_max FROM positions_v "
              "WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2, 3",
    "route_hours_v": "SELECT route_id, ts - ts % 3600 AS hour_bucket, count(*) AS observations, "
                     "count(DISTINCT vehicle_id) AS vehicles, "
                     f"count(*) FILTER (WHERE {MOVING}) AS moving, count(*) FILTER (WHERE speed <= 0.5e0) AS stopped, "
                     f"coalesce(sum(speed) FILTER (WHERE {MOVING}), 0e0) AS speed_sum, "
                     f"count(*) FILTER (WHERE {MOVING}) AS speed_n FROM positions_v "
                     "WHERE route_id IS NOT NULL GROUP BY 1, 2",
    "cells_v": "SELECT cell_y AS gy, cell_x AS gx, CAST(sum(observations) AS BIGINT) AS observations, "
               "max(vehicles) AS peak_vehicles, CAST(sum(moving) AS BIGINT) AS moving, "
               "CAST(sum(stopped) AS BIGINT) AS stopped, sum(speed_sum) AS speed_sum, "
               "CAST(sum(speed_n) AS BIGINT) AS speed_n, min(speed_min) AS speed_min, max(speed_max) AS speed_max "
               "FROM grid_v GROUP BY 1, 2",
    "window_v": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id "
                "ORDER BY ts DESC, arrival DESC) AS rn FROM positions_fast_v "
                f"WHERE ts BETWEEN {NOW_FAST - 3600} AND {NOW_FAST}) WHERE rn = 1",
    "bunched_v": "SELECT DISTINCT a.route_id, a.vehicle_id FROM latest_fast_v a JOIN latest_fast_v b "
                 "ON a.route_id = b.route_id AND a.vehicle_id <> b.vehicle_id "
                 f"WHERE {planar('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 300e0",
    "in_service_v": f"SELECT * FROM latest_fast_v WHERE {NOW_FAST} - ts <= 300 AND route_id IS NOT NULL",
    "bunched_live_v": "SELECT DISTINCT a.route_id, a.vehicle_id FROM in_service_v a JOIN in_service_v b "
                      "ON a.route_id = b.route_id AND a.vehicle_id <> b.vehicle_id "
                      f"WHERE {planar('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 300e0",
    "route_stats_v": "SELECT s.route_id, coalesce(route_short_name, s.route_id) AS route_name, route_desc, vehicles, "
                     "moving, avg_speed_kmh, moving_speed_kmh, coalesce(bunched, 0) AS bunched FROM ("
                     "SELECT route_id, count(*) AS vehicles, "
                     f"count(*) FILTER (WHERE {MOVING}) AS moving, "
                     f"{kmh('avg(speed) FILTER (WHERE speed < 20e0)')} AS avg_speed_kmh, "
                     f"{kmh(f'avg(speed) FILTER (WHERE {MOVING})')} AS moving_speed_kmh "
                     "FROM in_service_v GROUP BY route_id) s LEFT JOIN routes_v USING (route_id) LEFT JOIN "
                     "(SELECT route_id, count(*) AS bunched FROM bunched_live_v GROUP BY 1) b ON b.route_id = s.route_id",
    "gaps_v": "SELECT * FROM (SELECT vehicle_id, ts, lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts) AS prev_ts "
              "FROM log_fast_v) WHERE prev_ts IS NOT NULL",
    "gap_hours_v": "SELECT ts - ts % 3600 AS hour_bucket, count(*) AS gaps_total, "
                   "count(*) FILTER (WHERE ts - prev_ts > 90) AS gaps_over_threshold, "
                   "count(*) FILTER (WHERE ts - prev_ts > 0 AND ts - prev_ts <= 60) AS b_0_60, "
                   "count(*) FILTER (WHERE ts - prev_ts > 60 AND ts - prev_ts <= 180) AS b_60_180, "
                   "count(*) FILTER (WHERE ts - prev_ts > 180 AND ts - prev_ts <= 300) AS b_180_300, "
                   "count(*) FILTER (WHERE ts - prev_ts > 300 AND ts - prev_ts <= 600) AS b_300_600, "
                   "count(*) FILTER (WHERE ts - prev_ts > 600) AS b_600_plus FROM gaps_v GROUP BY 1",
    "trip_state_v": "SELECT vehicle_id, trip_id, max(ts) AS last_ts, coalesce(bool_or(ts - prev > 90), false) AS has_gap "
                    "FROM (SELECT *, lag(ts) OVER (PARTITION BY vehicle_id, trip_id ORDER BY ts) AS prev "
                    "FROM log_fast_v WHERE trip_id IS NOT NULL) GROUP BY 1, 2",
    "minutes_v": "SELECT trip_id, CASE WHEN len(p) >= 3 AND hh BETWEEN 0 AND 47 AND mm BETWEEN 0 AND 59 "
                 "THEN hh*60 + mm END AS minute FROM (SELECT trip_id, p, TRY_CAST(p[2] AS INT) AS hh, "
                 "TRY_CAST(p[3] AS INT) AS mm FROM (SELECT DISTINCT trip_id, string_split(trip_id, '_') AS p FROM "
                 "(SELECT trip_id FROM trips_v UNION ALL SELECT trip_id FROM positions_v WHERE trip_id IS NOT NULL)))",
    "live_keys_v": "SELECT route_id, trip_id, vehicle_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, "
                   "trip_id ORDER BY ts DESC, vehicle_id) AS rn FROM positions_v WHERE trip_id IS NOT NULL "
                   "AND route_id IS NOT NULL) WHERE rn = 1",
    "matches_v": "SELECT live_trip_id, vehicle_id, route_id, "
                 "CASE WHEN delta <= 15 THEN planned END AS matched_trip_id, "
                 "CASE WHEN delta = 0 THEN 'strict' WHEN delta <= 15 THEN 'relaxed' ELSE 'none' END AS match_type, "
                 f"CAST(delta AS DOUBLE) AS delta_minutes, CAST({NOW} AS BIGINT) AS matched_at FROM ("
                 "SELECT *, row_number() OVER (PARTITION BY route_id, live_trip_id ORDER BY delta NULLS LAST, "
                 "planned_minute, CASE WHEN planned_minute >= live_minute THEN planned END NULLS LAST, "
                 "planned DESC) AS rn FROM ("
                 "SELECT l.route_id, l.trip_id AS live_trip_id, l.vehicle_id, lm.minute AS live_minute, "
                 "t.trip_id AS planned, t.minute AS planned_minute, abs(t.minute - lm.minute) AS delta "
                 "FROM live_keys_v l LEFT JOIN minutes_v lm ON lm.trip_id = l.trip_id LEFT JOIN "
                 "(SELECT route_id, tm.trip_id, tm.minute FROM trips_v JOIN minutes_v tm USING (trip_id) "
                 "WHERE tm.minute IS NOT NULL) t ON t.route_id = l.route_id AND lm.minute IS NOT NULL)) WHERE rn = 1",
    "route_shape_v": "SELECT route_id, shape_id FROM (SELECT route_id, shape_id, row_number() OVER ("
                     "PARTITION BY route_id ORDER BY n DESC, shape_id) AS rn FROM "
                     "(SELECT DISTINCT route_id, shape_id FROM trips_v WHERE shape_id IS NOT NULL) JOIN "
                     "(SELECT shape_id, count(*) AS n FROM shapes_v GROUP BY 1) USING (shape_id)) WHERE rn = 1",
    "off_route_v": "SELECT vehicle_id, route_id, min(d) AS distance_m FROM (SELECT vehicle_id, route_id, "
                   "sqrt(power(ax + t*(bx-ax), 2) + power(ay + t*(by_-ay), 2)) AS d FROM (SELECT *, "
                   "CASE WHEN (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) <= 1e-9 THEN 0e0 ELSE greatest(0e0, least(1e0, "
                   "-(ax*(bx-ax) + ay*(by_-ay)) / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)))) END AS t FROM ("
                   "SELECT v.vehicle_id, v.route_id, "
                   "(g.lon-v.lon)*111320e0*greatest(cos(radians(v.lat)),1e-9) AS ax, (g.lat-v.lat)*111320e0 AS ay, "
                   "(g.lon2-v.lon)*111320e0*greatest(cos(radians(v.lat)),1e-9) AS bx, (g.lat2-v.lat)*111320e0 AS by_ "
                   "FROM (SELECT * FROM window_v WHERE lat IS NOT NULL AND lon IS NOT NULL) v JOIN ("
                   "SELECT route_id, shape_pt_lat AS lat, shape_pt_lon AS lon, "
                   "lead(shape_pt_lat) OVER w AS lat2, lead(shape_pt_lon) OVER w AS lon2 "
                   "FROM route_shape_v JOIN shapes_v USING (shape_id) "
                   "WINDOW w AS (PARTITION BY route_id ORDER BY shape_pt_sequence)) g "
                   "ON g.route_id = v.route_id AND g.lat2 IS NOT NULL))) GROUP BY 1, 2",
}


def compose(sql: str) -> str:
    """The query with a WITH clause of every view it needs, directly or through other views.

    A query that starts with a comma continues the clause with views of its own.
    """
    names = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    # A view used in several places is computed once.
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered)
    own = sql.lstrip()
    if not ordered:
        return f"WITH {own[1:]}" if own.startswith(",") else own
    return f"WITH {views}\n{own}"
