"""The live snapshot: filters, states, per-route figures, bunching, rankings."""

from pyspark.sql import functions as F

from ...operators import export, live, merge, spatial
from ..driver_sql import kmh, pct
from ..driver_tables import NOW_FAST
from .registry import query, rounded

BOX = (77.15, 28.55, 77.25, 28.65)
_IN_BOX = "lon BETWEEN 77.15e0 AND 77.25e0 AND lat BETWEEN 28.55e0 AND 28.65e0"
_ROW = "vehicle_id, ts, trip_id, route_id, lat, lon, speed"


@query("latest_filter", f"SELECT {_ROW} FROM latest_fast_v WHERE {_IN_BOX} AND ts >= {NOW_FAST} - 900")
def latest_filter(t):
    rows = live.latest_filter(t.latest_fast, NOW_FAST, bbox=BOX, max_age_s=900)
    return rows.select(*_ROW.split(", "))


@query("route_decorate", "SELECT vehicle_id, ts, arrival, p.route_id, route_short_name AS route_name, route_desc, "
       "agency_id FROM positions_v p LEFT JOIN routes_v USING (route_id)")
def route_decorate(t):
    return live.route_decorate(t.positions.select("vehicle_id", "ts", "arrival", "route_id"), t.routes)


@query("fleet_filter", f"SELECT vehicle_id, route_id, agency_id, ts FROM latest_fast_v LEFT JOIN routes_v USING (route_id) "
       f"WHERE agency_id = 'A1' AND {NOW_FAST} - ts > 60 - 60 AND coalesce(speed, 0) > 0.5e0 AND coalesce(speed, 0)*3.6e0 < 10e0 "
       f"AND NOT {NOW_FAST} - ts <= 300 UNION ALL "
       "SELECT vehicle_id, route_id, agency_id, ts FROM latest_fast_v LEFT JOIN routes_v USING (route_id) "
       f"WHERE {NOW_FAST} - ts <= 60 AND coalesce(speed, 0) <= 0.5e0 UNION ALL "
       "SELECT vehicle_id, route_id, agency_id, ts FROM latest_fast_v LEFT JOIN routes_v USING (route_id) "
       "WHERE vehicle_id IN (SELECT vehicle_id FROM bunched_v)")
def fleet_filter(t):
    fleet = live.route_decorate(t.latest_fast, t.routes)
    crawling = live.fleet_filter(fleet, NOW_FAST, agency_id="A1", freshness="stale", slow_only=True)
    resting = live.fleet_filter(fleet, NOW_FAST, freshness="fresh", motion="stopped")
    together = live.fleet_filter(fleet, NOW_FAST, bunched=spatial.bunched_vehicles(t.latest_fast))
    both = crawling.unionByName(resting).unionByName(together)
    return both.select("vehicle_id", "route_id", "agency_id", "ts")


_STATS = ("SELECT count(*) FILTER (WHERE ts >= {c}) AS active_vehicles, count(DISTINCT route_id) FILTER (WHERE ts >= {c}) "
          "AS active_routes, avg(speed) FILTER (WHERE ts >= {c}) AS avg_speed, max(ts) FILTER (WHERE ts >= {c}) AS newest_ts, "
          "min(ts) FILTER (WHERE ts >= {c}) AS oldest_ts, count(*) FILTER (WHERE ts >= {c} AND speed > 0.5e0) AS moving, "
          "count(*) FILTER (WHERE ts < {c}) AS stale_vehicles FROM latest_fast_v").format(c=NOW_FAST - 300)


@query("fleet_stats", f"SELECT * REPLACE (round(avg_speed, 4) AS avg_speed) FROM ({_STATS})")
def fleet_stats(t):
    return rounded(live.fleet_stats(t.latest_fast, NOW_FAST), "avg_speed")


@query("fleet_overview", f", last AS (SELECT * FROM polls_v ORDER BY polled_at DESC LIMIT 20) "
       f"SELECT active_vehicles, active_routes, moving, stale_vehicles, {kmh('avg_speed')} AS avg_speed_kmh, newest_ts, "
       "(SELECT round(count(*) FILTER (WHERE ok = 1)*1e0/count(*), 3) FROM last) AS poll_success_rate, "
       "(SELECT CAST(round(avg(coalesce(latency_ms, 0)) FILTER (WHERE ok = 1), 0) AS BIGINT) FROM last) AS avg_poll_latency_ms "
       f"FROM ({_STATS})")
def fleet_overview(t):
    return live.fleet_overview(t.latest_fast, t.polls, NOW_FAST)


@query("active_routes", "SELECT route_id, coalesce(route_short_name, route_id) AS route_name, route_desc, vehicles, avg_speed_kmh "
       f"FROM (SELECT route_id, count(*) AS vehicles, {kmh('avg(speed)')} AS avg_speed_kmh FROM latest_fast_v "
       "WHERE route_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) LEFT JOIN routes_v USING (route_id)")
def active_routes(t):
    return live.active_routes(t.latest_fast, t.routes, limit=12)


@query("live_vehicle_counts", f"SELECT route_id, count(*) AS vehicles FROM latest_fast_v WHERE {NOW_FAST} - ts <= 900 "
       "AND route_id IS NOT NULL GROUP BY 1")
def live_vehicle_counts(t):
    return live.live_vehicle_counts(live.latest_filter(t.latest_fast, NOW_FAST, max_age_s=900))


@query("fleet_states", f"SELECT count(*) AS total, count(*) FILTER (WHERE age <= 60) AS fresh, "
       "count(*) FILTER (WHERE age <= 300 AND speed > 0.5e0) AS moving, count(*) FILTER (WHERE age <= 300 AND speed <= 0.5e0) AS stopped, "
       "count(*) FILTER (WHERE age > 300) AS stale, count(*) FILTER (WHERE trip_id IS NULL) AS no_trip, "
       "count(*) FILTER (WHERE lat IS NULL OR lon IS NULL) AS no_position, count(*) FILTER (WHERE speed >= 20e0) AS implausible "
       f"FROM (SELECT *, {NOW_FAST} - ts AS age FROM latest_fast_v)")
def fleet_states(t):
    return live.fleet_states(t.latest_fast, NOW_FAST)


def _route_stats(t):
    bunched = spatial.bunched_per_route(spatial.bunched_vehicles(live.in_service(t.latest_fast, NOW_FAST)))
    return live.route_live_stats(t.latest_fast, t.routes, bunched, NOW_FAST)


@query("route_live_stats", "SELECT * FROM route_stats_v")
def route_live_stats(t):
    return _route_stats(t)


@query("busiest_routes", "SELECT * FROM route_stats_v ORDER BY vehicles DESC, route_id LIMIT 10")
def busiest_routes(t):
    return live.busiest_routes(_route_stats(t))


@query("slowest_routes", "SELECT * FROM route_stats_v WHERE moving >= 3 AND moving_speed_kmh IS NOT NULL "
       "ORDER BY moving_speed_kmh, route_id LIMIT 10")
def slowest_routes(t):
    return live.slowest_routes(_route_stats(t))


@query("most_bunched_routes", "SELECT * FROM route_stats_v WHERE bunched > 0 ORDER BY bunched DESC, route_id LIMIT 10")
def most_bunched_routes(t):
    return live.most_bunched_routes(_route_stats(t))


_DISPATCH = ("SELECT CAST(range AS INT) AS hour, coalesce(n, 0) AS vehicles FROM range(24) LEFT JOIN (SELECT hour, count(*) AS n "
             "FROM (SELECT TRY_CAST(p[2] AS INT) AS hour FROM (SELECT string_split(trip_id, '_') AS p FROM latest_fast_v) "
             "WHERE len(p) = 4 AND regexp_full_match(p[2], '[0-9]+')) WHERE hour BETWEEN 0 AND 23 GROUP BY 1) ON hour = range")


@query("dispatch_hours", _DISPATCH)
def dispatch_hours(t):
    return live.dispatch_hours(t.latest_fast)


@query("service_day_trim", f", d AS ({_DISPATCH}) SELECT * FROM d WHERE hour BETWEEN (SELECT min(hour) FROM d WHERE vehicles > 0) "
       "AND (SELECT max(hour) FROM d WHERE vehicles > 0)")
def service_day_trim(t):
    return live.service_day_trim(live.dispatch_hours(t.latest_fast))


@query("speed_percentiles", f"SELECT {kmh('avg(speed)')} AS avg_kmh, {kmh('quantile_cont(speed, 0.5)')} AS p50_kmh, "
       f"{kmh('quantile_cont(speed, 0.85)')} AS p85_kmh, count(*) AS sample FROM latest_fast_v "
       f"WHERE {NOW_FAST} - ts <= 300 AND speed < 20e0")
def speed_percentiles(t):
    return live.speed_percentiles(t.latest_fast, NOW_FAST)


@query("route_live_coverage", "SELECT r AS routes_scheduled, l AS routes_live, greatest(0, r - l) AS routes_dark, "
       f"{pct('l', 'r')} AS pct_live FROM (SELECT (SELECT count(*) FROM routes_v) AS r, "
       "(SELECT count(DISTINCT route_id) FROM in_service_v) AS l)")
def route_live_coverage(t):
    return live.route_live_coverage(t.latest_fast, t.routes, NOW_FAST)


@query("bunched_vehicles", "SELECT route_id, vehicle_id FROM bunched_v")
def bunched_vehicles(t):
    return spatial.bunched_vehicles(t.latest_fast)


@query("bunching_summary", "SELECT n AS bunched_vehicles, r AS routes, "
       f"{pct('n', '(SELECT count(*) FROM latest_fast_v)')} AS pct FROM (SELECT count(*) AS n, count(DISTINCT route_id) AS r FROM bunched_v)")
def bunching_summary(t):
    return live.bunching_summary(t.latest_fast, spatial.bunched_vehicles(t.latest_fast))


@query("wire_frame_normalise", "SELECT vehicle_id, ts, route_id, trip_id, round(lat, 5) AS lat, round(lon, 5) AS lon, "
       "round(bearing, 0) AS bearing, round(speed, 1) AS speed FROM positions_v")
def wire_frame_normalise(t):
    return export.wire_vehicles(t.positions)


@query("wire_frame_routes", "SELECT route_id, route_short_name AS name, route_desc AS \"desc\", agency_id AS agency FROM "
       "(SELECT DISTINCT route_id FROM positions_v WHERE route_id IS NOT NULL) LEFT JOIN routes_v USING (route_id)")
def wire_frame_routes(t):
    return export.wire_routes(t.positions, t.routes)


@query("prefix_purge", "SELECT vehicle_id, ts, arrival FROM positions_v WHERE NOT starts_with(vehicle_id, 'V1')")
def prefix_purge(t):
    return merge.prefix_purge(t.positions, "V1").select("vehicle_id", "ts", "arrival")


@query("rounding", "SELECT arrival, round(lat, 5) AS lat5, round(speed, 1) AS speed1, round(bearing, 0) AS bearing0 FROM positions_v")
def rounding(t):
    return t.positions.select("arrival", F.round("lat", 5).alias("lat5"), F.round("speed", 1).alias("speed1"),
                              F.round("bearing", 0).alias("bearing0"))
