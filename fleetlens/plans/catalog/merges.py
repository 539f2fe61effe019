"""The write side: dedupe, merges, refreshes, retention, layouts."""

from pyspark.sql import functions as F

from ...operators import matching, merge
from ...session import shared_dir
from .. import fold, tables
from ..driver_tables import BASE_TS, NOW, NOW_FAST
from .registry import query

_HALF = BASE_TS + 5400


def _old(t):
    return t.positions_fast.filter(F.col("ts") < _HALF)


def _new(t):
    """A batch that overlaps the stored half by ten minutes and adds the rest."""
    return t.positions_fast.filter(F.col("ts") >= _HALF - 600)


@query("dedupe_append", f"SELECT vehicle_id, ts, arrival FROM log_fast_v WHERE ts >= {_HALF}")
def dedupe_append(t):
    return merge.dedupe_append(merge.unique_observations(_old(t)), _new(t)).select("vehicle_id", "ts", "arrival")


@query("latest_wins_merge", "SELECT vehicle_id, ts, arrival, route_id FROM latest_fast_v")
def latest_wins_merge(t):
    merged = merge.latest_wins_merge(merge.latest_projection(_old(t)), _new(t))
    return merged.select("vehicle_id", "ts", "arrival", "route_id")


@query("quarantine_split", "SELECT vehicle_id, ts, arrival, p.route_id, CASE WHEN p.route_id IS NOT NULL AND r.route_id IS NULL THEN 'unknown_route_id' END AS reason "
       "FROM positions_v p LEFT JOIN routes_v r ON r.route_id = p.route_id")
def quarantine_split(t):
    kept, dead = merge.quarantine_split(t.positions, t.routes, NOW)
    columns = ["vehicle_id", "ts", "arrival", "route_id"]
    return kept.select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(dead.select(*columns, "reason"))


@query("deadletter_count", "SELECT count(*) AS n FROM positions_v WHERE route_id NOT IN (SELECT route_id FROM routes_v)")
def deadletter_count(t):
    return merge.deadletter_count(merge.quarantine_split(t.positions, t.routes, NOW)[1], NOW)


@query("static_replace_dedupe", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
       "ORDER BY l_suppkey*100000 + l_partkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def static_replace_dedupe(t):
    position = F.struct(F.col("l_suppkey") * 100_000 + F.col("l_partkey"), "l_quantity")
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", position.alias("position"))
    return merge.static_replace_dedupe(rows, ["l_orderkey", "l_linenumber"])


def _new_trips(t):
    """The next timetable: every seventh trip gone, every fifth renamed, copies of every ninth added."""
    key = F.element_at(F.split("trip_id", "_"), -1).cast("bigint")
    changed = t.trips.filter(key % 7 != 0).withColumn(
        "trip_headsign", F.when(key % 5 == 0, F.concat("trip_headsign", F.lit("*"))).otherwise(F.col("trip_headsign")))
    added = t.trips.filter(key % 9 == 0).withColumn("trip_id", F.concat(F.lit("X"), "trip_id"))
    return changed.unionByName(added)


@query("upsert_and_prune", "SELECT trip_id, CASE WHEN k % 7 = 0 THEN 'deleted' WHEN k % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM "
       "(SELECT trip_id, CAST(split_part(trip_id, '_', 4) AS BIGINT) AS k FROM trips_v) UNION ALL SELECT 'X' || trip_id, 'inserted' FROM trips_v "
       "WHERE CAST(split_part(trip_id, '_', 4) AS BIGINT) % 9 = 0")
def upsert_and_prune(t):
    return merge.upsert_and_prune(t.trips, _new_trips(t), "trip_id")


@query("fk_restrict_check", "SELECT DISTINCT route_id FROM routes_v WHERE route_id LIKE '%1%' AND route_id IN (SELECT route_id FROM positions_v)")
def fk_restrict_check(t):
    return merge.fk_restrict_check(t.routes.filter(F.col("route_id").contains("1")), t.positions, "route_id")


def _matches(t):
    return matching.match_window(t.positions, t.trips, 0, NOW, NOW)


@query("fk_set_null", "SELECT live_trip_id, route_id, match_type, CASE WHEN CAST(split_part(matched_trip_id, '_', 4) AS BIGINT) % 7 <> 0 THEN matched_trip_id END AS matched_trip_id FROM matches_v")
def fk_set_null(t):
    left = merge.fk_set_null(_matches(t), _new_trips(t))
    return left.select("live_trip_id", "route_id", "match_type", "matched_trip_id")


@query("trip_match_upsert", f"SELECT live_trip_id, route_id, matched_trip_id, match_type, CASE WHEN route_id IN ('R1', 'R2') THEN CAST({NOW + 60} AS BIGINT) ELSE matched_at END AS matched_at "
       "FROM matches_v QUALIFY row_number() OVER (PARTITION BY live_trip_id ORDER BY CASE WHEN route_id IN ('R1', 'R2') THEN 0 ELSE 1 END, route_id, vehicle_id) = 1")
def trip_match_upsert(t):
    stored = _matches(t)
    again = stored.filter(F.col("route_id").isin("R1", "R2")).withColumn("matched_at", F.lit(NOW + 60).cast("bigint"))
    merged = merge.trip_match_upsert(stored, again)
    return merged.select("live_trip_id", "route_id", "matched_trip_id", "match_type", "matched_at")


# ---- delay feed -----------------------------------------------------------
_T0, _T1 = "timestamp_seconds(0)", "timestamp_seconds(60)"


@query("stop_delay_merge", ", both_sides AS (SELECT coalesce(i.service_date, s.service_date) AS service_date, coalesce(i.trip_id, s.trip_id) AS trip_id, "
       "coalesce(i.stop_sequence, s.stop_sequence) AS stop_sequence, CASE WHEN i.trip_id IS NOT NULL THEN i.arrival_delay_s ELSE s.arrival_delay_s END AS arrival_delay_s, "
       "s.trip_id IS NULL AS fresh, i.trip_id IS NOT NULL AND s.trip_id IS NOT NULL AND (i.stop_id, i.arrival_delay_s, i.departure_delay_s, i.stop_status, i.implausible) "
       "IS DISTINCT FROM (s.stop_id, s.arrival_delay_s, s.departure_delay_s, s.stop_status, s.implausible) AS changed FROM delays_stored_v s FULL JOIN delays_incoming_v i "
       "ON s.service_date = i.service_date AND s.trip_id = i.trip_id AND s.stop_sequence = i.stop_sequence) SELECT service_date, trip_id, stop_sequence, arrival_delay_s, "
       "CAST(changed AS SMALLINT) AS changes, CAST(CASE WHEN fresh THEN 60 ELSE 0 END AS BIGINT) AS first_seen_s, CAST(CASE WHEN fresh OR changed THEN 60 ELSE 0 END AS BIGINT) AS last_seen_s FROM both_sides")
def stop_delay_merge(t):
    stored, incoming = t.delay_rounds
    seen = stored.withColumn("changes", F.lit(0).cast("smallint")).withColumn("first_seen", F.expr(_T0)).withColumn("last_seen", F.expr(_T0))
    merged = merge.stop_delay_merge(seen, incoming, F.expr(_T1))
    return merged.select("service_date", "trip_id", "stop_sequence", "arrival_delay_s", "changes",
                         F.unix_seconds("first_seen").alias("first_seen_s"), F.unix_seconds("last_seen").alias("last_seen_s"))


@query("stop_delay_counts", "SELECT count(*) FILTER (WHERE s.trip_id IS NULL) AS inserted, count(*) FILTER (WHERE s.trip_id IS NOT NULL AND (i.stop_id, i.arrival_delay_s, i.departure_delay_s, "
       "i.stop_status, i.implausible) IS DISTINCT FROM (s.stop_id, s.arrival_delay_s, s.departure_delay_s, s.stop_status, s.implausible)) AS changed FROM delays_incoming_v i LEFT JOIN delays_stored_v s "
       "ON s.service_date = i.service_date AND s.trip_id = i.trip_id AND s.stop_sequence = i.stop_sequence")
def stop_delay_counts(t):
    return merge.stop_delay_counts(*t.delay_rounds)


def _status(t, parity: int):
    status = F.when(F.col("order_status") == ("F" if parity else "P"), "CANCELED").otherwise("SCHEDULED")
    rows = t.delays.filter(F.col("order_key") % 3 != parity)
    return rows.groupBy("service_date", "trip_id", "order_key", status.alias("status")).agg(F.count("*").cast("int").alias("stops_total")).select(
        "service_date", "trip_id", F.lit(1).cast("smallint").alias("zone_id"), F.concat(F.lit("R"), F.col("order_key") % 25).alias("route_id"),
        F.lit(None).cast("string").alias("start_time"), "status", "stops_total", F.lit(0).alias("stops_skipped"),
        F.lit(0).alias("stops_with_delay"), F.lit(None).cast("int").alias("max_delay_s"))


@query("trip_status_merge", ", trips_of AS (SELECT DISTINCT service_date, trip_id, order_key, order_status FROM delays_v) SELECT service_date, trip_id, "
       "CASE WHEN order_key % 3 <> 1 THEN CASE WHEN order_status = 'F' THEN 'CANCELED' ELSE 'SCHEDULED' END ELSE CASE WHEN order_status = 'P' THEN 'CANCELED' ELSE 'SCHEDULED' END END AS status, "
       "CAST(CASE WHEN order_key % 3 <> 0 THEN 0 ELSE 60 END AS BIGINT) AS first_seen_s, CAST(CASE WHEN order_key % 3 <> 1 THEN 60 ELSE 0 END AS BIGINT) AS last_seen_s, "
       "CAST(CASE WHEN order_key % 3 <> 0 AND order_status = 'P' THEN 0 WHEN order_key % 3 <> 1 AND order_status = 'F' THEN 60 END AS BIGINT) AS canceled_s, "
       "CAST(CASE WHEN order_key % 3 <> 1 THEN 2 ELSE 1 END AS BIGINT) AS poll_id FROM trips_of")
def trip_status_merge(t):
    stored = _status(t, 0).withColumn("first_seen", F.expr(_T0)).withColumn("last_seen", F.expr(_T0)).withColumn(
        "canceled_at", F.when(F.col("status") == "CANCELED", F.expr(_T0))).withColumn("poll_id", F.lit(1).cast("bigint"))
    merged = merge.trip_status_merge(stored, _status(t, 1), F.expr(_T1), 2)
    return merged.select("service_date", "trip_id", "status", F.unix_seconds("first_seen").alias("first_seen_s"),
                         F.unix_seconds("last_seen").alias("last_seen_s"), F.unix_seconds("canceled_at").alias("canceled_s"), "poll_id")


def _labelled(df):
    return df.withColumn("label", F.when(F.col("arrival") % 4 == 0, F.concat(F.lit("bus "), F.col("arrival"))))


@query("seen_dimension_merge", f", old AS (SELECT * FROM positions_fast_v WHERE ts < {_HALF} AND vehicle_id NOT LIKE 'V%7'), new AS (SELECT * FROM positions_fast_v WHERE ts >= {_HALF} - 600 AND vehicle_id NOT LIKE 'V%3'), "
       "lo AS (SELECT vehicle_id, 'bus ' || max(arrival) FILTER (WHERE arrival % 4 = 0) AS label FROM old GROUP BY 1), ln AS (SELECT vehicle_id, 'bus ' || max(arrival) FILTER (WHERE arrival % 4 = 0) AS label FROM new GROUP BY 1) "
       "SELECT coalesce(ln.vehicle_id, lo.vehicle_id) AS vehicle_id, coalesce(ln.label, lo.label) AS label, CAST(CASE WHEN lo.vehicle_id IS NOT NULL THEN 0 ELSE 60 END AS BIGINT) AS first_seen_s, "
       "CAST(CASE WHEN ln.vehicle_id IS NOT NULL THEN 60 ELSE 0 END AS BIGINT) AS last_seen_s FROM lo FULL JOIN ln ON lo.vehicle_id = ln.vehicle_id")
def seen_dimension_merge(t):
    # Two reports of one second are ordered by arrival, as in the latest projection.
    timed = lambda df: _labelled(df).withColumn("ts", F.struct("ts", "arrival"))
    schema = "vehicle_id string, label string, first_seen timestamp, last_seen timestamp"
    nobody = t.spark.createDataFrame([], schema)
    old = merge.seen_dimension_merge(nobody, timed(_old(t)).filter(~F.col("vehicle_id").endswith("7")), F.expr(_T0))
    merged = merge.seen_dimension_merge(old, timed(_new(t)).filter(~F.col("vehicle_id").endswith("3")), F.expr(_T1))
    return merged.select("vehicle_id", "label", F.unix_seconds("first_seen").alias("first_seen_s"), F.unix_seconds("last_seen").alias("last_seen_s"))


# ---- replace rules --------------------------------------------------------
@query("replace_if_nonempty", "SELECT 'kept' AS case_name, route_id FROM routes_v UNION ALL SELECT 'replaced', route_id FROM routes_v WHERE route_id LIKE 'R1%'")
def replace_if_nonempty(t):
    routes = t.routes.select("route_id")
    kept = merge.replace_if_nonempty(routes, routes.filter(F.col("route_id") == "none"))
    replaced = merge.replace_if_nonempty(routes, routes.filter(F.col("route_id").startswith("R1")))
    return kept.select(F.lit("kept").alias("case_name"), "route_id").unionByName(replaced.select(F.lit("replaced").alias("case_name"), "route_id"))


def _zones(t):
    """Stop times by zone of the line number; zone 1 repeats some keys of zone 0."""
    rows = t.stop_times.select("trip_id", "stop_sequence", "stop_id", F.col("departure_s").alias("position"))
    own = rows.withColumn("zone_id", (F.col("stop_sequence") % 3).cast("int"))
    copies = own.filter((F.col("zone_id") == 0) & (F.col("position") % 7 == 0)).withColumn(
        "zone_id", F.lit(1)).withColumn("stop_id", F.concat(F.lit("copy "), "stop_id"))
    return own.unionByName(copies)


@query("all_zones_or_nothing", "SELECT 'complete' AS case_name, trip_id, stop_sequence, CASE WHEN stop_sequence % 3 = 0 AND departure_s % 7 = 0 THEN 'copy ' || stop_id ELSE stop_id END AS stop_id, "
       "CAST(CASE WHEN stop_sequence % 3 = 0 AND departure_s % 7 = 0 THEN 1 ELSE stop_sequence % 3 END AS INT) AS zone_id FROM stop_times_v "
       "UNION ALL SELECT 'partial', trip_id, stop_sequence, stop_id, CAST(9 AS INT) FROM stop_times_v WHERE stop_sequence = 1")
def all_zones_or_nothing(t):
    current = t.stop_times.filter(F.col("stop_sequence") == 1).select("trip_id", "stop_sequence", "stop_id", F.lit(9).alias("zone_id"))
    pulled = _zones(t)
    complete = merge.all_zones_or_nothing(current, pulled, [0, 1, 2])
    partial = merge.all_zones_or_nothing(current, pulled, [0, 1, 2, 3])
    return complete.withColumn("case_name", F.lit("complete")).unionByName(partial.withColumn("case_name", F.lit("partial")))


@query("zone_audit", ", copies AS (SELECT count(*) AS n FROM stop_times_v WHERE stop_sequence % 3 = 0 AND departure_s % 7 = 0) SELECT (SELECT count(*) FROM stop_times_v) + n AS pulled_rows, "
       "(SELECT count(*) FROM stop_times_v) AS unique_rows, n AS dropped_rows, true AS complete FROM copies")
def zone_audit(t):
    return merge.zone_audit(_zones(t), [0, 1, 2])


# ---- retention and layout -------------------------------------------------
@query("retention_prune", f"SELECT vehicle_id, ts, arrival FROM positions_v WHERE ts >= {NOW - 1_000_000}")
def retention_prune(t):
    return merge.retention_prune(t.positions, NOW - 1_000_000).select("vehicle_id", "ts", "arrival")


@query("retention_report", f"SELECT CAST(DATE '1970-01-01' + CAST(ts // 86400 AS INT) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (WHERE ts < {NOW - 1_000_000}) AS removed, "
       f"bool_and(ts < {NOW - 1_000_000}) AS drop_day FROM positions_v GROUP BY 1")
def retention_report(t):
    return merge.retention_report(t.positions, NOW - 1_000_000)


@query("pull_log_retention", f", pulls AS (SELECT polled_at AS pulled_at, polled_at // 30 % 6 AS check_no, CASE WHEN polled_at < {_HALF} THEN entity_count ELSE 0 END AS row_count FROM polls_v) "
       f"SELECT pulled_at, CAST(check_no AS INT) AS check_no FROM pulls WHERE pulled_at >= {NOW_FAST - 600} OR pulled_at >= (SELECT coalesce(max(pulled_at), {NOW_FAST - 600}) FROM pulls WHERE check_no = 3 AND row_count > 0)")
def pull_log_retention(t):
    polled = F.col("polled_at")
    pulls = t.polls.select(polled.alias("pulled_at"), (F.call_function("div", polled, F.lit(30)) % 6).cast("int").alias("check_no"),
                           F.when(polled < _HALF, F.col("entity_count")).otherwise(0).alias("row_count"))
    return merge.pull_log_retention(pulls, NOW_FAST - 600).select("pulled_at", "check_no")


# Written by day and hour, read back with the partition columns the directories carry.
@query("time_partition_layout", "SELECT DATE '1970-01-01' + CAST(ts // 86400 AS INT) AS day, CAST(ts % 86400 // 3600 AS INT) AS hour, count(*) AS n FROM positions_fast_v GROUP BY 1, 2")
def time_partition_layout(t):
    root = shared_dir(t.spark, "layout")
    placed = tables.time_partition_layout(t.positions_fast.select("vehicle_id", "ts", "speed"), hourly=True)
    tables.replace_partitions(placed, root, "day", "hour")
    back = t.spark.read.schema("vehicle_id string, ts bigint, speed double, day date, hour int").parquet(root)
    return back.groupBy("day", "hour").agg(F.count("*").alias("n"))


@query("audit_append", f"SELECT CAST({NOW_FAST} AS BIGINT) AS polled_at, CAST(1 AS INT) AS ok, count(*) AS entities, (SELECT count(*) FROM log_fast_v WHERE ts >= {_HALF}) AS fresh_rows, max(ts) AS feed_timestamp "
       f"FROM positions_fast_v WHERE ts >= {_HALF} - 600")
def audit_append(t):
    batch = _new(t).withColumn("feed_timestamp", F.col("ts"))
    fresh = merge.dedupe_append(merge.unique_observations(_old(t)), _new(t))
    row = merge.audit_row(batch, fresh, NOW_FAST)
    return row.select("polled_at", "ok", F.col("entity_count").cast("bigint").alias("entities"),
                      F.col("new_rows").cast("bigint").alias("fresh_rows"), "feed_timestamp")


# One pass of the fold job over a stored log: watermarks, then the rollups it wrote.
def _folded(t):
    store = fold.FoldTables(t.spark, shared_dir(t.spark, "fold"))
    tables.append_log(t.log_fast, store.path("log"), 0)
    fold.run_once(store, t.trips, NOW_FAST)
    return store


@query("watermark_state", "SELECT x.key AS key, (SELECT max(ts) FROM log_fast_v) AS value FROM (VALUES ('rollup'), ('continuity'), ('trip_match')) AS x(key)")
def watermark_state(t):
    return _folded(t).state("watermarks", fold.WATERMARKS)


@query("stored_route_hours", "SELECT route_id, ts - ts % 3600 AS hour_bucket, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles FROM log_fast_v WHERE route_id IS NOT NULL GROUP BY 1, 2")
def stored_route_hours(t):
    return _folded(t).route_hours.select("route_id", "hour_bucket", "observations", "vehicles")


# The first step starts after the retention edge, which lies before every row of this log.
@query("stored_gap_hours", "SELECT * FROM gap_hours_v")
def stored_gap_hours(t):
    return _folded(t).gap_hours
