"""The quality report and its metrics as SQL, for one common window of an hour."""

from .driver_sql import LAT_STEP, LON_STEP, VIEWS, pct
from .driver_tables import NOW_FAST
from ..constants import DAY_S, POPULATION_FIELDS
from ..schemas import POSITION_COLUMNS

SINCE = NOW_FAST - 3600
PREFIX = "gtfs_quality_"

VIEWS["rwin_v"] = (f"SELECT * FROM log_fast_v WHERE ts BETWEEN {SINCE} AND {NOW_FAST} "
                   "QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC) = 1")
VIEWS["off_route_log_v"] = VIEWS["off_route_v"].replace("window_v", "rwin_v")

_ONE = {
    "live": f"SELECT count(DISTINCT route_id) AS live, (SELECT count(*) FROM routes_v) AS planned FROM "
            f"(SELECT * FROM log_fast_v WHERE ts BETWEEN {NOW_FAST - 300} AND {NOW_FAST} "
            "QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC) = 1)",
    "fleet": f"SELECT count(*) AS active FROM latest_fast_v WHERE ts >= {NOW_FAST - 300}",
    "cells": f"SELECT count(DISTINCT floor(lat/{LAT_STEP}) || ':' || floor(lon/{LON_STEP})) AS seen FROM log_fast_v "
             f"WHERE lat IS NOT NULL AND lon IS NOT NULL AND ts - ts % 3600 >= {SINCE}",
    "box": f"SELECT greatest(1, CAST(round_even((max(stop_lat)-min(stop_lat))/{LAT_STEP}*((max(stop_lon)-min(stop_lon))/{LON_STEP}), 0) AS BIGINT)) AS total FROM stops_v",
    "per_vehicle": "SELECT count(*) AS vehicles, avg(span) AS span, avg(n) AS reports FROM (SELECT count(*) AS n, max(ts) - min(ts) AS span "
                   f"FROM log_fast_v WHERE ts BETWEEN {SINCE} AND {NOW_FAST} GROUP BY vehicle_id)",
    "gap_sums": f"SELECT coalesce(sum(gaps_total), 0) AS total, coalesce(sum(gaps_over_threshold), 0) AS over_90, coalesce(sum(b_0_60), 0) AS b_0_60, "
                "coalesce(sum(b_60_180), 0) AS b_60_180, coalesce(sum(b_180_300), 0) AS b_180_300, coalesce(sum(b_300_600), 0) AS b_300_600, "
                f"coalesce(sum(b_600_plus), 0) AS b_600_plus FROM gap_hours_v WHERE hour_bucket BETWEEN {SINCE} AND {NOW_FAST}",
    "done": "SELECT count(*) AS trips, count(*) FILTER (WHERE NOT has_gap) AS complete FROM trip_state_v "
            f"WHERE last_ts BETWEEN {SINCE} AND {NOW_FAST}",
    "fast": "SELECT count(*) AS total, count(*) FILTER (WHERE speed >= 20e0) AS n FROM rwin_v",
    "line": "SELECT count(*) AS sampled, count(*) FILTER (WHERE distance_m <= 50) AS near, round(avg(distance_m), 1) AS mean, "
            "(SELECT count(DISTINCT route_id) FROM rwin_v WHERE lat IS NOT NULL AND lon IS NOT NULL) AS routes FROM off_route_log_v",
    "coords": "SELECT count(*) FILTER (WHERE lat = 0 AND lon = 0) AS zero, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT "
              "(lat BETWEEN (SELECT min(stop_lat) FROM stops_v) AND (SELECT max(stop_lat) FROM stops_v) AND lon BETWEEN "
              "(SELECT min(stop_lon) FROM stops_v) AND (SELECT max(stop_lon) FROM stops_v))) AS outside FROM rwin_v",
    "refs": "SELECT count(*) FILTER (WHERE route_id IS NOT NULL AND route_id NOT IN (SELECT route_id FROM routes_v)) AS routes, "
            "count(*) FILTER (WHERE trip_id IS NOT NULL AND trip_id NOT IN (SELECT trip_id FROM trips_v)) AS trips "
            f"FROM log_fast_v WHERE ts >= {SINCE}",
    "p": f"SELECT * FROM polls_v WHERE polled_at >= {SINCE}",
    "ages": "SELECT round(avg(polled_at - feed_timestamp), 1) AS age, round((max(feed_timestamp) - min(feed_timestamp))*1e0/"
            "nullif(count(DISTINCT feed_timestamp) - 1, 0), 1) AS cadence, round(avg(latency_ms), 0) AS latency FROM p "
            "WHERE ok = 1 AND feed_timestamp IS NOT NULL",
    "vol": "SELECT round(avg(entity_count), 1) AS mean, round(stddev_pop(entity_count), 1) AS sd, min(entity_count) AS low, "
           "max(entity_count) AS high, min(entity_count) < avg(entity_count)*0.5e0 AS unstable FROM p WHERE ok = 1",
    "scores": f"SELECT (SELECT {pct('live', 'planned')} FROM live) AS route_coverage_pct, "
              f"(SELECT {pct(f'count(*) FILTER (WHERE {NOW_FAST} - ts <= 60)', 'count(*)')} FROM rwin_v) AS fresh_60_pct, "
              "(SELECT round(least(100e0, reports/(span/30 + 1)*100), 1) FROM per_vehicle) AS continuity_pct, "
              f"(SELECT 100 - coalesce({pct('n', 'total')}, 0e0) FROM fast) AS plausible_pct, "
              f"(SELECT {pct('count(*) FILTER (WHERE ok = 1)', 'count(*)')} FROM p) AS poll_success_pct",
    "report": "SELECT *, round((route_coverage_pct + fresh_60_pct + continuity_pct + plausible_pct + poll_success_pct)/5, 1) AS composite_score FROM scores",
}
_HEAD = "".join(f", {name} AS MATERIALIZED ({sql})\n" for name, sql in _ONE.items())

SUMMARY = _HEAD + "SELECT * FROM report"
COMPOSITE = _HEAD + "SELECT composite_score FROM report"


def _metric(name, value, source, labels="''"):
    return f"SELECT '{PREFIX}{name}' AS metric, {labels} AS labels, CAST({value} AS DOUBLE) AS value FROM {source}"


_STALE = ("(VALUES ('b_0_60', -1000000, 60), ('b_60_180', 60, 180), ('b_180_300', 180, 300), ('b_300_600', 300, 600), "
          "('b_600_plus', 600, 1000000000)) AS x(bucket, lo, hi)")
_FIELD_SETS = ("(SELECT hour, fields, lag(fields, 1, '') OVER (ORDER BY hour) AS before FROM (SELECT ts - ts % 3600 AS hour, concat_ws(',', "
               + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in sorted(POSITION_COLUMNS) if c != "ingested_at")
               + ") AS fields FROM log_fast_v GROUP BY 1)) WHERE fields <> before")
_METRICS = [
    _metric("composite_score", "composite_score", "report"),
    _metric("fleet_coverage_pct", pct("active", "200"), "fleet"), _metric("fleet_active_vehicles", "active", "fleet"),
    _metric("fleet_expected_vehicles", "200", "fleet"),
    _metric("route_coverage_pct", pct("live", "planned"), "live"), _metric("routes_scheduled", "planned", "live"),
    _metric("routes_live", "live", "live"), _metric("routes_dark", "greatest(0, planned - live)", "live"),
    _metric("dark_route_top_trip_count", "max(n)", "(SELECT r.route_id, count(t.trip_id) AS n FROM routes_v r LEFT JOIN trips_v t "
            "USING (route_id) WHERE r.route_id NOT IN (SELECT route_id FROM latest_fast_v WHERE route_id IS NOT NULL) GROUP BY 1)"),
    _metric("spatial_coverage_pct", pct("seen", "total"), "cells, box"), _metric("spatial_cells_observed", "seen", "cells"),
    _metric("spatial_cells_total", "total", "box"),
    _metric("temporal_coverage_pct", "round(avg(routes)*100e0/(SELECT count(*) FROM routes_v), 1)",
            "(SELECT hour_bucket, count(DISTINCT route_id) AS routes FROM (SELECT *, ts - ts % 3600 AS hour_bucket FROM log_fast_v "
            f"WHERE route_id IS NOT NULL) WHERE hour_bucket >= {SINCE} GROUP BY 1) GROUP BY hour_bucket % 86400 // 3600, (hour_bucket // 86400 + 4) % 7 IN (0, 6)",
            "'hour=' || (hour_bucket % 86400 // 3600) || ',weekend=' || CAST(((hour_bucket // 86400 + 4) % 7 IN (0, 6)) AS INT)"),
    _metric("fresh_within_pct", pct(f"count(*) FILTER (WHERE {NOW_FAST} - ts <= s)", "count(*)"),
            "rwin_v, (VALUES (30), (60), (120), (300)) AS x(s) GROUP BY s", "'threshold_s=' || s"),
    _metric("staleness_bucket_count", "count(ts)", f"{_STALE} LEFT JOIN rwin_v ON {NOW_FAST} - ts > lo AND {NOW_FAST} - ts <= hi GROUP BY bucket",
            "'bucket=' || bucket"),
    _metric("feed_age_at_source_seconds", "age", "ages"), _metric("native_publish_cadence_seconds", "cadence", "ages"),
    _metric("ingest_latency_ms", "latency", "ages"),
    _metric("report_continuity_pct", "continuity_pct", "report"), _metric("vehicles_in_window", "vehicles", "per_vehicle"),
    _metric("gaps_over_threshold", "over_90", "gap_sums"), _metric("gap_pct_of_gaps", pct("over_90", "total"), "gap_sums"),
    _metric("session_churn", "over_90", "gap_sums"),
    *[_metric("gap_duration_bucket_count", b, "gap_sums", f"'bucket={b}'")
      for b in ("b_0_60", "b_60_180", "b_180_300", "b_300_600", "b_600_plus")],
    _metric("trip_completeness_pct", pct("complete", "trips"), "done"), _metric("trips_total", "trips", "done"),
    _metric("trips_complete", "complete", "done"),
    _metric("implausible_speed_pct", pct("n", "total"), "fast"), _metric("implausible_speed_count", "n", "fast"),
    _metric("off_route_pct_within_50m", pct("near", "sampled"), "line"), _metric("off_route_avg_distance_m", "mean", "line"),
    _metric("off_route_routes_sampled", "routes", "line"),
    _metric("coordinate_out_of_bounds", "outside", "coords"), _metric("coordinate_zero", "zero", "coords"),
    _metric("referential_invalid_route_id", "routes", "refs"), _metric("referential_invalid_trip_id", "trips", "refs"),
    _metric("duplicate_snapshot_pct", pct("count(*) FILTER (WHERE new_rows = 0)", "count(*)"), "p WHERE ok = 1"),
    *[_metric("field_population_pct", pct(f"count({f})", "count(*)"), f"log_fast_v WHERE ts >= {SINCE}", f"'field={f}'")
      for f in POPULATION_FIELDS],
    _metric("static_feed_age_days", f"round({DAY_S}/86400e0, 1)", "(SELECT 1)"),
    _metric("static_routes", "count(*)", "routes_v"), _metric("static_stops", "count(*)", "stops_v"),
    _metric("static_trips", "count(*)", "trips_v"), _metric("static_shape_points", "count(*)", "shapes_v"),
    _metric("poll_success_pct", pct("count(*) FILTER (WHERE ok = 1)", "count(*)"), "p"),
    _metric("error_breakdown_count", "count(*)", "(SELECT CASE WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout' "
            "WHEN http_status >= 500 THEN '5xx' WHEN http_status >= 400 THEN '4xx' WHEN coalesce(entity_count, 0) = 0 THEN 'empty_body' "
            "ELSE 'other' END AS kind FROM p WHERE ok <> 1) GROUP BY kind", "'kind=' || kind"),
    _metric("feed_volume_mean", "mean", "vol"), _metric("feed_volume_stdev", "sd", "vol"), _metric("feed_volume_min", "low", "vol"),
    _metric("schema_fields_count", "len(string_split(max_by(fields, hour), ','))", _FIELD_SETS),
    _metric("schema_last_changed_timestamp", "max(hour)", _FIELD_SETS),
    _metric("feed_volume_max", "high", "vol"), _metric("feed_volume_unstable", "CAST(unstable AS INT)", "vol"),
]
METRICS = _HEAD + "SELECT metric, labels, value FROM (" + "\nUNION ALL ".join(_METRICS) + ") WHERE value IS NOT NULL"
