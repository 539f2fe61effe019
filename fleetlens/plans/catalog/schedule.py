"""Schedule questions and lookups."""

from pyspark.sql import functions as F

from ...functions import geo, measures, parse
from ...operators import keyed, matching, schedule, spatial
from ..driver_sql import planar, tangent
from ..driver_tables import NOW
from .registry import query, rounded

PROBES = ((1, 28.6, 77.2), (2, 28.512, 77.131), (3, 10.0, 10.0))
_PROBES = "(VALUES " + ", ".join(f"({i}, {a}e0, {o}e0)" for i, a, o in PROBES) + ") AS p(probe_id, plat, plon)"


@query("trip_count_per_route", "SELECT r.route_id, count(t.trip_id) AS trip_count FROM routes_v r LEFT JOIN trips_v t USING (route_id) GROUP BY 1")
def trip_count_per_route(t):
    return schedule.trip_count_per_route(t.routes, t.trips).select("route_id", "trip_count")


@query("route_search", "SELECT route_id, route_short_name, route_desc, (SELECT count(*) FROM trips_v t WHERE t.route_id = r.route_id) AS trip_count, "
       "(SELECT count(*) FROM routes_v WHERE route_desc ILIKE '%nation_1%') AS total FROM routes_v r "
       "WHERE route_short_name ILIKE '%nation_1%' OR route_long_name ILIKE '%nation_1%' OR route_desc ILIKE '%nation_1%' "
       "ORDER BY route_short_name, route_id LIMIT 6 OFFSET 2")
def route_search(t):
    found = schedule.route_search(t.routes, t.trips, "nation_1", limit=6, offset=2)
    return found.select("route_id", "route_short_name", "route_desc", "trip_count", "total")


@query("page", "SELECT trip_id, route_id FROM trips_v ORDER BY route_id, trip_id LIMIT 100 OFFSET 250")
def page(t):
    return keyed.page(t.trips.select("trip_id", "route_id"), 100, 250, "route_id", "trip_id")


@query("like_ci", "SELECT stop_id, stop_name FROM stops_v WHERE stop_name ILIKE '%MER#0000007%'")
def like_ci(t):
    return t.stops.filter(measures.like_ci("stop_name", "MER#0000007")).select("stop_id", "stop_name")


@query("stop_search", "SELECT stop_id, stop_code, stop_name, stop_lat, stop_lon FROM stops_v WHERE (stop_name ILIKE '%r#00000%' OR stop_code ILIKE '%r#00000%') "
       "AND stop_lat BETWEEN 28.55e0 AND 28.65e0 AND stop_lon BETWEEN 77.15e0 AND 77.25e0")
def stop_search(t):
    return schedule.stop_search(t.stops, "R#00000", (77.15, 28.55, 77.25, 28.65), limit=None)


@query("stop_schedule", "SELECT st.trip_id, t.route_id, arrival_time, departure_time, departure_s, route_short_name, route_desc "
       "FROM stop_times_v st JOIN trips_v t USING (trip_id) LEFT JOIN routes_v r ON r.route_id = t.route_id "
       "WHERE st.stop_id = 'S7' AND departure_s BETWEEN 28800 AND 90000")
def stop_schedule(t):
    return schedule.stop_schedule(t.stop_times, t.trips, t.routes, "S7", 28_800, 90_000, limit=None).select(
        "trip_id", "route_id", "arrival_time", "departure_time", "departure_s", "route_short_name", "route_desc")


@query("route_stops", ", longest AS (SELECT route_id, trip_id FROM (SELECT route_id, trip_id, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, trip_id) AS rn "
       "FROM (SELECT trip_id, count(*) AS n FROM stop_times_v GROUP BY 1) JOIN trips_v USING (trip_id)) WHERE rn = 1) "
       "SELECT route_id, trip_id, stop_sequence, stop_id, stop_name, stop_lat, stop_lon, arrival_time, departure_time "
       "FROM longest JOIN stop_times_v USING (trip_id) JOIN stops_v USING (stop_id)")
def route_stops(t):
    return schedule.route_stops(t.stop_times, t.trips, t.stops)


@query("argmax_per_group", "SELECT stop_id, route_id, n FROM (SELECT stop_id, route_id, count(*) AS n, row_number() OVER "
       "(PARTITION BY stop_id ORDER BY count(*) DESC, route_id) AS rn FROM stop_times_v JOIN trips_v USING (trip_id) GROUP BY 1, 2) WHERE rn = 1")
def argmax_per_group(t):
    calls = t.stop_times.select("stop_id", "trip_id").join(t.trips.select("trip_id", "route_id"), "trip_id")
    return keyed.argmax_per_group(calls, "stop_id", "route_id")


@query("route_shape", "SELECT route_id, shape_id, shape_pt_sequence, shape_pt_lon AS lon, shape_pt_lat AS lat FROM route_shape_v JOIN shapes_v USING (shape_id)")
def route_shape(t):
    return schedule.route_shape(t.trips, t.shapes)


@query("dark_routes", "SELECT route_id, route_short_name, route_desc, (SELECT count(*) FROM trips_v t WHERE t.route_id = r.route_id) AS trip_count "
       "FROM routes_v r WHERE route_id NOT IN (SELECT route_id FROM latest_fast_v WHERE route_id IS NOT NULL) ")
def dark_routes(t):
    return schedule.dark_routes(t.routes, t.trips, t.latest_fast, limit=None)


@query("routes_nearby", f", near AS (SELECT probe_id, stop_id, stop_name, {tangent('stop_lat', 'stop_lon', 'plat', 'plon')} AS d FROM stops_v, {_PROBES} "
       "WHERE d <= 1500e0), found AS (SELECT probe_id, t.route_id, min(d) AS d, count(DISTINCT stop_name) AS stops, min(stop_name) AS first_stop FROM near "
       "JOIN stop_times_v USING (stop_id) JOIN trips_v t USING (trip_id) GROUP BY 1, 2) "
       "SELECT probe_id, route_id, short_name, long_name, agency_id, round(d, 1) AS distance_m, stops, first_stop FROM "
       "(SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, route_id) AS rn FROM found) LEFT JOIN "
       "(SELECT route_id, route_short_name AS short_name, route_long_name AS long_name, agency_id FROM routes_v) USING (route_id) WHERE rn <= 10")
def routes_nearby(t):
    probes = t.spark.createDataFrame(list(PROBES), "probe_id int, lat double, lon double")
    found = schedule.routes_nearby(probes, t.stops, t.stop_times, t.trips, t.routes, 1500.0, limit=10)
    return found.withColumn("first_stop", F.get("stops", F.lit(0))).withColumn("stops", F.size("stops").cast("bigint"))


@query("nearest_stop", ", best AS (SELECT arrival, stop_id, stop_name, d2 FROM (SELECT arrival, s.stop_id, stop_name, "
       "(stop_lat-lat)*(stop_lat-lat) + (stop_lon-lon)*(stop_lon-lon) AS d2, row_number() OVER (PARTITION BY arrival ORDER BY "
       "(stop_lat-lat)*(stop_lat-lat) + (stop_lon-lon)*(stop_lon-lon), s.stop_id) AS rn FROM positions_v JOIN stops_v s ON "
       "stop_lat BETWEEN lat - 0.002e0 AND lat + 0.002e0 AND stop_lon BETWEEN lon - 0.002e0 AND lon + 0.002e0) WHERE rn = 1) "
       "SELECT arrival AS point_id, best.stop_id, stop_name, round(d2*1e9, 4) AS d2 FROM positions_v LEFT JOIN best USING (arrival)")
def nearest_stop(t):
    points = t.positions.select(F.col("arrival").alias("point_id"), "lat", "lon")
    found = spatial.nearest_stop(points, t.stops, 0.002)
    return found.select("point_id", "stop_id", "stop_name", F.round(F.col("d2") * 1e9, 4).alias("d2"))


@query("point_lookup", "SELECT route_id, route_short_name, agency_id FROM routes_v WHERE route_id = 'R7'")
def point_lookup(t):
    return keyed.point_lookup(t.routes, "route_id", "R7").select("route_id", "route_short_name", "agency_id")


@query("key_list_lookup", "SELECT route_id, route_short_name, route_desc FROM routes_v WHERE route_id IN (SELECT route_id FROM positions_v)")
def key_list_lookup(t):
    return keyed.key_list_lookup(t.routes, t.positions, "route_id").select("route_id", "route_short_name", "route_desc")


@query("feed_counts", "SELECT (SELECT count(*) FROM agency_v) AS agencies, (SELECT count(*) FROM routes_v) AS routes, "
       "count(*) AS stops, (SELECT count(*) FROM trips_v) AS trips, (SELECT count(*) FROM stop_times_v) AS stop_times, "
       "(SELECT count(*) FROM shapes_v) AS shape_points, (SELECT count(*) FROM positions_v) AS history_rows, "
       "min(stop_lat) AS min_lat, min(stop_lon) AS min_lon, max(stop_lat) AS max_lat, max(stop_lon) AS max_lon FROM stops_v")
def feed_counts(t):
    return schedule.feed_counts(t.agency, t.routes, t.stops, t.trips, t.stop_times, t.shapes, t.positions)


@query("planar_distance_m", f"SELECT arrival, s.stop_id, round({planar('lat', 'lon', 'stop_lat', 'stop_lon')}, 4) AS metres FROM positions_v "
       "JOIN stops_v s ON s.stop_id = 'S' || arrival % (SELECT count(*) FROM stops_v)")
def planar_distance_m(t):
    pairs = keyed.lookup_join(
        t.positions.select("arrival", "lat", "lon", F.concat(F.lit("S"), F.col("arrival") % t.stops.agg(F.count("*")).scalar()).alias("stop_id")),
        t.stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "inner")
    metres = geo.planar_distance_m("lat", "lon", "stop_lat", "stop_lon")
    return rounded(pairs.select("arrival", "stop_id", metres.alias("metres")), "metres")


@query("radius_distance_m", f"SELECT arrival, s.stop_id, round({tangent('lat', 'lon', 'stop_lat', 'stop_lon')}, 4) AS metres FROM positions_v "
       "JOIN stops_v s ON s.stop_id = 'S' || arrival % (SELECT count(*) FROM stops_v)")
def radius_distance_m(t):
    pairs = keyed.lookup_join(
        t.positions.select("arrival", "lat", "lon", F.concat(F.lit("S"), F.col("arrival") % t.stops.agg(F.count("*")).scalar()).alias("stop_id")),
        t.stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "inner")
    metres = geo.radius_distance_m("lat", "lon", "stop_lat", "stop_lon")
    return rounded(pairs.select("arrival", "stop_id", metres.alias("metres")), "metres")


# ---- matching to the timetable --------------------------------------------
def _matches(t):
    return matching.match_window(t.positions, t.trips, 0, NOW, NOW)


@query("live_trip_keys", "SELECT * FROM live_keys_v")
def live_trip_keys(t):
    return keyed.live_trip_keys(t.positions, 0, NOW)


@query("trip_nearest_match", "SELECT * FROM matches_v")
def trip_nearest_match(t):
    return _matches(t)


@query("trip_match_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE match_type = 'strict') AS strict, "
       "count(*) FILTER (WHERE match_type = 'relaxed') AS relaxed, count(*) FILTER (WHERE match_type = 'none') AS \"none\", "
       "round(count(*) FILTER (WHERE match_type = 'strict')*100e0/count(*), 1) AS strict_pct, "
       "round(count(*) FILTER (WHERE match_type <> 'none')*100e0/count(*), 1) AS linked_pct FROM matches_v")
def trip_match_summary(t):
    return matching.trip_match_summary(_matches(t), NOW)


@query("dispatch_minute_parse", "SELECT trip_id, CAST(minute AS INT) AS minute FROM minutes_v")
def dispatch_minute_parse(t):
    ids = t.trips.select("trip_id").unionByName(t.positions.select("trip_id")).filter(F.col("trip_id").isNotNull()).distinct()
    return parse.with_dispatch_minute(ids)
