"""Gaps, continuity, windowed reads, set operations and the whole quality report."""

from pyspark.sql import functions as F

from ... import schemas
from ...constants import DAY_S
from ...operators import continuity, export, keyed, matching, merge, rollup, spatial
from ...session import shared_dir
from ...sources import scans
from .. import report
from .. import report_sql
from ..driver_sql import pct
from ..driver_tables import BASE_TS, NOW, NOW_FAST
from .registry import query, rounded

_ROW = "vehicle_id, ts, trip_id, route_id, lat, lon, speed, arrival"


@query("latest_in_window", f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, arrival DESC) AS rn "
       f"FROM positions_v WHERE ts BETWEEN {NOW} - 864000 AND {NOW}) WHERE rn = 1")
def latest_in_window(t):
    return keyed.latest_in_window(t.positions, NOW - 864_000, NOW).select(*_ROW.split(", "))


@query("distinct_on", "SELECT DISTINCT ON (trip_id) trip_id, vehicle_id, ts FROM positions_fast_v WHERE trip_id IS NOT NULL ORDER BY trip_id, ts DESC, vehicle_id, arrival")
def distinct_on(t):
    rows = t.positions_fast.filter(F.col("trip_id").isNotNull())
    return keyed.first_per_key(rows, "trip_id", F.desc("ts"), "vehicle_id", "arrival").select("trip_id", "vehicle_id", "ts")


@query("time_window_filter", f"SELECT {_ROW} FROM positions_v WHERE ts BETWEEN {NOW} - 864000 AND {NOW} - 432000")
def time_window_filter(t):
    return scans.time_window(t.positions, NOW - 864_000, NOW - 432_000).select(*_ROW.split(", "))


@query("trail_linestring", "SELECT vehicle_id, count(*) AS reports, count(lat + lon) AS points, "
       "string_agg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN CAST(CAST(round(lon*100000) AS BIGINT) AS VARCHAR) || ' ' || "
       "CAST(CAST(round(lat*100000) AS BIGINT) AS VARCHAR) END, ',' ORDER BY ts) AS line FROM log_fast_v GROUP BY 1")
def trail_linestring(t):
    trails = export.trail_linestring(t.log_fast, BASE_TS, NOW_FAST)
    scaled = lambda v: F.round(v * 100_000).cast("bigint").cast("string")
    text = F.array_join(F.transform("coordinates", lambda c: F.concat_ws(" ", scaled(c[0]), scaled(c[1]))), ",")
    return trails.select("vehicle_id", "reports", F.size("coordinates").cast("bigint").alias("points"), text.alias("line"))


@query("trail", f"SELECT ts, lat, lon, speed, bearing, route_id, trip_id FROM log_fast_v WHERE vehicle_id = 'V7'")
def trail(t):
    return export.trail(t.log_fast, "V7", BASE_TS, NOW_FAST)


@query("report_gaps", "SELECT vehicle_id, ts, prev_ts, ts - prev_ts AS gap_s FROM gaps_v")
def report_gaps(t):
    return continuity.report_gaps(t.log_fast, BASE_TS - 1, NOW_FAST)


@query("report_gaps_by_trip", "SELECT * FROM (SELECT vehicle_id, trip_id, ts, lag(ts) OVER w AS prev_ts, ts - lag(ts) OVER w AS gap_s "
       "FROM log_fast_v WHERE trip_id IS NOT NULL WINDOW w AS (PARTITION BY vehicle_id, trip_id ORDER BY ts)) WHERE prev_ts IS NOT NULL")
def report_gaps_by_trip(t):
    return continuity.report_gaps(t.log_fast, BASE_TS - 1, NOW_FAST, by_trip=True)


@query("gap_hour_counters", "SELECT * FROM gap_hours_v")
def gap_hour_counters(t):
    return continuity.gap_hour_counters(t.log_fast, BASE_TS - 1, NOW_FAST)


_MIDDLE = BASE_TS + 4000


# Two batches with carried state must add up to one fold over everything.
@query("gap_counters_in_two_batches", "SELECT * FROM gap_hours_v")
def gap_counters_in_two_batches(t):
    first = continuity.gap_hour_counters(t.log_fast, BASE_TS - 1, _MIDDLE)
    state = continuity.vehicle_gap_state(t.log_fast, BASE_TS - 1, _MIDDLE)
    return continuity.add_counters(first, continuity.gap_hour_counters(t.log_fast, _MIDDLE, NOW_FAST, state=state))


@query("trip_gap_state", "SELECT * FROM trip_state_v")
def trip_gap_state(t):
    state = continuity.trip_gap_state(t.log_fast, BASE_TS - 1, _MIDDLE)
    return continuity.trip_gap_state(t.log_fast, _MIDDLE, NOW_FAST, stored=state)


@query("gap_state_join", f", early AS (SELECT * FROM log_fast_v WHERE ts <= {_MIDDLE}) SELECT l.vehicle_id, l.trip_id, l.ts, v.last_ts AS vehicle_last_ts, "
       f"p.last_ts AS trip_last_ts FROM (SELECT * FROM log_fast_v WHERE ts > {_MIDDLE}) l LEFT JOIN (SELECT vehicle_id, max(ts) AS last_ts FROM early GROUP BY 1) v "
       "ON v.vehicle_id = l.vehicle_id LEFT JOIN (SELECT vehicle_id, trip_id, max(ts) AS last_ts FROM early WHERE trip_id IS NOT NULL GROUP BY 1, 2) p "
       "ON p.vehicle_id = l.vehicle_id AND p.trip_id = l.trip_id")
def gap_state_join(t):
    vehicles = continuity.vehicle_gap_state(t.log_fast, BASE_TS - 1, _MIDDLE)
    trips = continuity.trip_gap_state(t.log_fast, BASE_TS - 1, _MIDDLE)
    return continuity.gap_state_join(t.log_fast, _MIDDLE, NOW_FAST, vehicles, trips)


def _report(t):
    hours = continuity.gap_hour_counters(t.log_fast, BASE_TS - 1, NOW_FAST)
    return continuity.continuity_report(t.log_fast, hours, BASE_TS + 100, NOW_FAST)


_COUNTERS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in continuity.COUNTERS)
_REPORT = (f"SELECT * FROM (SELECT count(*) AS vehicles, CAST(sum(n) AS BIGINT) AS observations, avg(span) AS avg_span_s, "
           f"avg(n) AS avg_observations_per_vehicle FROM (SELECT count(*) AS n, max(ts) - min(ts) AS span FROM log_fast_v "
           f"WHERE ts BETWEEN {BASE_TS + 100} AND {NOW_FAST} GROUP BY vehicle_id)), (SELECT {_COUNTERS} FROM gap_hours_v "
           f"WHERE hour_bucket BETWEEN {BASE_TS + 100} AND {NOW_FAST})")


@query("continuity_report", f"SELECT * REPLACE (round(avg_span_s, 4) AS avg_span_s, "
       f"round(avg_observations_per_vehicle, 4) AS avg_observations_per_vehicle) FROM ({_REPORT})")
def continuity_report(t):
    return rounded(_report(t), "avg_span_s", "avg_observations_per_vehicle")


@query("report_continuity_pct", "SELECT vehicles, round(least(100e0, avg_observations_per_vehicle/(avg_span_s/30 + 1)*100), 1) AS report_continuity_pct, "
       f"{pct('gaps_over_threshold', 'gaps_total')} AS pct_of_gaps FROM ({_REPORT})")
def report_continuity_pct(t):
    return continuity.with_report_pct(_report(t)).select("vehicles", "report_continuity_pct", "pct_of_gaps")


@query("trip_completeness", f"SELECT count(*) AS trips, count(*) FILTER (WHERE NOT has_gap) AS complete_trips, "
       f"{pct('count(*) FILTER (WHERE NOT has_gap)', 'count(*)')} AS pct FROM trip_state_v WHERE last_ts BETWEEN {BASE_TS} AND {NOW_FAST - 2000}")
def trip_completeness(t):
    state = continuity.trip_gap_state(t.log_fast, BASE_TS - 1, NOW_FAST)
    return continuity.trip_completeness(state, BASE_TS, NOW_FAST - 2000)


@query("rows_since_scan", f"SELECT polled_at, ok, entity_count, new_rows, 'series' AS part FROM polls_v WHERE polled_at >= {NOW_FAST - 3600} UNION ALL "
       "(SELECT polled_at, ok, entity_count, new_rows, 'recent' FROM polls_v ORDER BY polled_at DESC LIMIT 40)")
def rows_since_scan(t):
    series = scans.rows_since(t.polls, NOW_FAST - 3600, "polled_at").withColumn("part", F.lit("series"))
    recent = scans.most_recent(t.polls, 40, "polled_at").withColumn("part", F.lit("recent"))
    return series.unionByName(recent).select("polled_at", "ok", "entity_count", "new_rows", "part")


@query("distinct_rows", "SELECT DISTINCT vehicle_id, route_id FROM positions_v")
def distinct_rows(t):
    return keyed.distinct_rows(t.positions, "vehicle_id", "route_id")


@query("unknown_keys", "SELECT DISTINCT route_id FROM positions_v WHERE route_id IS NOT NULL EXCEPT SELECT route_id FROM routes_v")
def unknown_keys(t):
    return keyed.unknown_keys(t.positions, t.routes, "route_id")


@query("new_key_count", "SELECT count(*) AS new_keys FROM delays_incoming_v i WHERE NOT EXISTS (SELECT 1 FROM delays_stored_v s "
       "WHERE s.service_date = i.service_date AND s.trip_id = i.trip_id AND s.stop_sequence = i.stop_sequence)")
def new_key_count(t):
    stored, incoming = t.delay_rounds
    return keyed.new_key_count(incoming, stored, merge.DELAY_KEY)


@query("concat_zones", "SELECT trip_id, stop_sequence, stop_id, CAST(zone AS INT) AS zone_id FROM (SELECT *, CAST(stop_sequence % 3 AS INT) AS zone FROM stop_times_v)")
def concat_zones(t):
    zone = lambda z: t.stop_times.filter(F.col("stop_sequence") % 3 == z).select(
        "trip_id", "stop_sequence", "stop_id", F.lit(z).alias("zone_id"))
    return merge.concat_zones([zone(z) for z in range(3)])


@query("busiest_k_routes", "SELECT route_id, count(*) AS vehicles FROM positions_v WHERE route_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def busiest_k_routes(t):
    return spatial.busiest_k_routes(t.positions, 15)


# ---- the whole report -----------------------------------------------------
def _report_tables(t) -> report.ReportTables:
    """The report reads stored tables; here they are written once to the shared folder."""
    def stored(frame, name):
        path = shared_dir(t.spark, name)
        frame.write.parquet(path)
        return t.spark.read.schema(frame.schema).parquet(path)

    log = stored(t.log_fast, "log")
    return report.ReportTables(
        positions=log, latest=stored(t.latest_fast, "latest"), polls=stored(t.polls, "polls"),
        grid_hours=rollup.grid_hour_rollup(log), route_hours=rollup.route_hour_rollup(log),
        gap_hours=stored(continuity.gap_hour_counters(log, BASE_TS - 1, NOW_FAST), "gaps"),
        trip_state=continuity.trip_gap_state(log, BASE_TS - 1, NOW_FAST),
        matches=matching.match_window(log, t.trips, 0, NOW_FAST, NOW_FAST),
        routes=t.routes, trips=t.trips, stops=t.stops, shapes=t.shapes,
        static_loaded_at=NOW_FAST - DAY_S, expected_fleet=200)


@query("quality_summary", report_sql.SUMMARY)
def quality_summary(t):
    return report.quality_summary(report.layers(_report_tables(t), NOW_FAST, minutes=60))


@query("composite_score", report_sql.COMPOSITE)
def composite_score(t):
    return report.quality_summary(report.layers(_report_tables(t), NOW_FAST, minutes=60)).select("composite_score")


@query("metrics_long", report_sql.METRICS)
def metrics_long(t):
    stored = _report_tables(t)
    hours = stored.positions.withColumn("batch_ts", F.col("ts") - F.col("ts") % 3600)
    schema = report.schema_layer(hours, [c for c in schemas.POSITION_COLUMNS if c != "ingested_at"])
    rows = report.metrics_long(report.layers(stored, NOW_FAST, minutes=60), schema)
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("metric", labels.alias("labels"), "value")
