"""The quality layers, one query each."""

from pyspark.sql import functions as F

from ...operators import keyed, quality, rollup, spatial
from ..driver_sql import LAT_STEP, LON_STEP, pct
from ..driver_tables import BASE_TS, NOW, NOW_FAST
from .registry import query, rounded

SINCE = NOW_FAST - 3600
EXPECTED = 200


def _window(t):
    return keyed.latest_in_window(t.positions_fast, SINCE, NOW_FAST)


def _polls(t):
    return t.polls.filter(F.col("polled_at") >= SINCE)


_POLLS = f"(SELECT * FROM polls_v WHERE polled_at >= {SINCE})"


@query("fleet_coverage", f"SELECT n AS active, CAST({EXPECTED} AS BIGINT) AS expected, {pct('n', EXPECTED)} AS pct FROM "
       f"(SELECT count(*) AS n FROM latest_fast_v WHERE ts >= {NOW_FAST} - 300)")
def fleet_coverage(t):
    return quality.fleet_coverage(t.latest_fast, NOW_FAST, EXPECTED)


@query("route_coverage", "SELECT r AS routes_scheduled, l AS routes_live, greatest(0, r - l) AS routes_dark, "
       f"{pct('l', 'r')} AS pct_live FROM (SELECT (SELECT count(*) FROM routes_v) AS r, (SELECT count(DISTINCT route_id) FROM "
       f"(SELECT * FROM positions_fast_v WHERE ts BETWEEN {NOW_FAST} - 300 AND {NOW_FAST} "
       "QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, arrival DESC) = 1)) AS l)")
def route_coverage(t):
    return quality.route_coverage(t.positions_fast, t.routes, NOW_FAST)


@query("spatial_coverage", "SELECT cells AS cells_observed, total AS cells_total, "
       f"{pct('cells', 'total')} AS pct FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT cell_y, cell_x FROM grid_v "
       f"WHERE hour_bucket >= {NOW} - 259200)) AS cells, greatest(1, CAST(round_even("
       f"(max(stop_lat)-min(stop_lat))/{LAT_STEP}*((max(stop_lon)-min(stop_lon))/{LON_STEP}), 0) AS BIGINT)) AS total FROM stops_v)")
def spatial_coverage(t):
    observed = rollup.distinct_grid_cells(rollup.grid_hour_rollup(t.positions), NOW - 259_200)
    return quality.spatial_coverage(observed, t.stops)


@query("freshness_thresholds", f", w AS (SELECT {NOW_FAST} - ts AS age FROM window_v) SELECT s AS threshold_s, "
       f"count(*) FILTER (WHERE age <= s) AS vehicles, {pct('count(*) FILTER (WHERE age <= s)', 'count(*)')} AS pct "
       "FROM w, (VALUES (30), (60), (120), (300)) AS x(s) GROUP BY s")
def freshness_thresholds(t):
    return quality.freshness_thresholds(_window(t), NOW_FAST)


@query("staleness_buckets", f", w AS (SELECT {NOW_FAST} - ts AS age FROM window_v) SELECT bucket, count(age) AS vehicles FROM "
       "(VALUES ('b_0_60', -1000000, 60), ('b_60_180', 60, 180), ('b_180_300', 180, 300), ('b_300_600', 300, 600), "
       "('b_600_plus', 600, 1000000000)) AS x(bucket, lo, hi) LEFT JOIN w ON age > lo AND age <= hi GROUP BY 1")
def staleness_buckets(t):
    return quality.staleness_buckets(_window(t), NOW_FAST)


@query("feed_age_cadence", "SELECT round(avg(polled_at - feed_timestamp), 1) AS feed_age_at_source_s, "
       "round((max(feed_timestamp) - min(feed_timestamp))*1e0/nullif(count(DISTINCT feed_timestamp) - 1, 0), 1) AS native_publish_cadence_s, "
       f"CAST(round(avg(latency_ms), 0) AS BIGINT) AS ingest_ms FROM {_POLLS} WHERE ok = 1 AND feed_timestamp IS NOT NULL")
def feed_age_cadence(t):
    return quality.feed_age_cadence(_polls(t))


@query("implausible_speed", f"SELECT count(*) AS total, count(*) FILTER (WHERE speed >= 20e0) AS implausible_speed, "
       f"{pct('count(*) FILTER (WHERE speed >= 20e0)', 'count(*)')} AS pct FROM positions_v")
def implausible_speed(t):
    return quality.implausible_speed(t.positions)


@query("coordinate_validity", "SELECT count(*) AS total, count(*) FILTER (WHERE NOT (lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1) "
       "AND lat IS NOT NULL AND lon IS NOT NULL) AS out_of_bounds, count(*) FILTER (WHERE lat = 0 AND lon = 0) AS zero_coord "
       "FROM positions_v, (SELECT min(stop_lat) AS lat0, max(stop_lat) AS lat1, min(stop_lon) AS lon0, max(stop_lon) AS lon1 FROM stops_v)")
def coordinate_validity(t):
    return quality.coordinate_validity(t.positions, t.stops)


@query("referential_integrity", "SELECT count(*) AS total, "
       "count(*) FILTER (WHERE route_id IS NOT NULL AND route_id NOT IN (SELECT route_id FROM routes_v)) AS invalid_route_id, "
       "count(*) FILTER (WHERE trip_id IS NOT NULL AND trip_id NOT IN (SELECT trip_id FROM trips_v)) AS invalid_trip_id FROM positions_v")
def referential_integrity(t):
    return quality.referential_integrity(t.positions, t.routes, t.trips, 0)


@query("off_route_distance", "SELECT vehicle_id, route_id, round(distance_m, 4) AS distance_m FROM off_route_v")
def off_route_distance(t):
    return rounded(spatial.off_route_distance(_window(t), t.trips, t.shapes), "distance_m")


@query("off_route_summary", "SELECT count(*) AS sampled, count(*) FILTER (WHERE distance_m <= 50) AS within_50m, "
       f"{pct('count(*) FILTER (WHERE distance_m <= 50)', 'count(*)')} AS pct_within_50m, round(avg(distance_m), 1) AS avg_distance_m, "
       "(SELECT count(DISTINCT route_id) FROM window_v WHERE lat IS NOT NULL AND lon IS NOT NULL) AS routes_sampled FROM off_route_v")
def off_route_summary(t):
    window = _window(t)
    return spatial.off_route_summary(window, spatial.off_route_distance(window, t.trips, t.shapes))


@query("duplicate_snapshot_rate", "SELECT count(*) AS polls, count(*) FILTER (WHERE new_rows = 0) AS duplicates, "
       f"{pct('count(*) FILTER (WHERE new_rows = 0)', 'count(*)')} AS pct FROM polls_v WHERE ok = 1")
def duplicate_snapshot_rate(t):
    return quality.duplicate_snapshot_rate(t.polls)


_FIELDS = "stop_id occupancy_status congestion_level current_status bearing speed trip_id route_id lat".split()


@query("field_population", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS populated, count(*) AS total, {pct(f'count({f})', 'count(*)')} AS pct FROM positions_v"
    for f in _FIELDS))
def field_population(t):
    return quality.field_population(t.positions, 0)


@query("static_feed_age", "SELECT (SELECT count(*) FROM routes_v) AS routes, (SELECT count(*) FROM stops_v) AS stops, "
       "(SELECT count(*) FROM trips_v) AS trips, (SELECT count(*) FROM shapes_v) AS shape_points, "
       f"CAST({BASE_TS} AS BIGINT) AS static_loaded_at, round(({NOW} - {BASE_TS})/86400e0, 1) AS age_days")
def static_feed_age(t):
    return quality.static_feed_age(t.routes, t.stops, t.trips, t.shapes, BASE_TS, NOW)


@query("poll_success", f"SELECT count(*) AS polls, count(*) FILTER (WHERE ok = 1) AS ok, "
       f"{pct('count(*) FILTER (WHERE ok = 1)', 'count(*)')} AS pct FROM polls_v")
def poll_success(t):
    return quality.poll_success(t.polls)


@query("error_breakdown", "SELECT CASE WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout' "
       "WHEN http_status >= 500 THEN '5xx' WHEN http_status >= 400 THEN '4xx' WHEN coalesce(entity_count, 0) = 0 THEN 'empty_body' "
       "ELSE 'other' END AS kind, count(*) AS polls FROM polls_v WHERE ok <> 1 GROUP BY 1")
def error_breakdown(t):
    return quality.error_breakdown(t.polls)


@query("volume_stability", "SELECT round(avg(entity_count), 1) AS mean_entities, round(stddev_pop(entity_count), 1) AS stdev_entities, "
       "min(entity_count) AS min_entities, max(entity_count) AS max_entities, min(entity_count) < avg(entity_count)*0.5e0 AS unstable "
       "FROM polls_v WHERE ok = 1")
def volume_stability(t):
    return quality.volume_stability(t.polls)


_PRINT_FIELDS = ["vehicle_id", "trip_id", "route_id", "lat", "bearing", "speed", "stop_id", "current_status"]
_PRINT = "concat_ws(',', " + ", ".join(f"CASE WHEN count({f}) > 0 THEN '{f}' END" for f in sorted(_PRINT_FIELDS)) + ")"


@query("schema_fingerprint", f"SELECT changed_at, fields FROM (SELECT batch_ts AS changed_at, fields, lag(fields, 1, '') OVER (ORDER BY batch_ts) AS b "
       f"FROM (SELECT ts // 30 * 30 AS batch_ts, {_PRINT} AS fields FROM positions_fast_v GROUP BY 1)) WHERE fields <> b")
def schema_fingerprint(t):
    batches = t.positions_fast.withColumn("batch_ts", F.col("ts") - F.col("ts") % 30)
    return quality.schema_changes(batches, _PRINT_FIELDS)


@query("schema_fields", f"SELECT {_PRINT} AS fields FROM positions_v")
def schema_fields(t):
    return quality.schema_fingerprint(t.positions, _PRINT_FIELDS)
