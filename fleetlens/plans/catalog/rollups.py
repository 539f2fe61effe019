"""Rollups, time series and what is read from them."""

from pyspark.sql import functions as F

from ...operators import export, quality, rollup, spatial
from ...session import shared_dir
from ..driver_sql import LAT_STEP, LON_STEP, MOVING, kmh, pct
from ..driver_tables import NOW
from .registry import query, rounded

SINCE_DAY = NOW - 86_400 * 10
BOX = (77.15, 28.55, 77.25, 28.65)
_GRID = ("cell_y, cell_x, hour_bucket, observations, vehicles, moving, stopped, round(speed_sum, 4) AS speed_sum, "
         "speed_n, speed_min, speed_max")
_CELL = ("gy, gx, observations, peak_vehicles, moving, stopped, round(speed_sum, 4) AS speed_sum, speed_n, "
         "speed_min, speed_max")
_SPEED = kmh("speed_sum/speed_n")


@query("grid_hour_rollup", f"SELECT {_GRID} FROM grid_v")
def grid_hour_rollup(t):
    return rounded(rollup.grid_hour_rollup(t.positions), "speed_sum")


@query("route_hour_rollup", "SELECT route_id, hour_bucket, observations, vehicles, moving, stopped, "
       "round(speed_sum, 4) AS speed_sum, speed_n FROM route_hours_v")
def route_hour_rollup(t):
    return rounded(rollup.route_hour_rollup(t.positions), "speed_sum")


# Stored buckets come from the first half of arrivals; the refold of everything from two hours
# before their newest row must equal a fold of the whole log from there on.
@query("rollup_refold", f"""
    , mark AS (SELECT (max(ts) - 3600) // 3600 * 3600 AS since FROM positions_v WHERE arrival % 2 = 0 AND ts < {SINCE_DAY})
    , early AS (SELECT CAST(floor(lat/{LAT_STEP}) AS INT) AS cell_y, CAST(floor(lon/{LON_STEP}) AS INT) AS cell_x,
        ts - ts % 3600 AS hour_bucket, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles
        FROM positions_v WHERE lat IS NOT NULL AND lon IS NOT NULL AND arrival % 2 = 0 AND ts < {SINCE_DAY} GROUP BY 1, 2, 3)
    SELECT cell_y, cell_x, hour_bucket, observations, vehicles FROM early WHERE hour_bucket < (SELECT since FROM mark)
    UNION ALL SELECT cell_y, cell_x, hour_bucket, observations, vehicles FROM grid_v
    WHERE hour_bucket >= (SELECT since FROM mark)""")
def rollup_refold(t):
    early = t.positions.filter((F.col("arrival") % 2 == 0) & (F.col("ts") < SINCE_DAY))
    watermark = early.agg(F.max("ts")).first()[0]
    stored = rollup.grid_hour_rollup(early)
    folded = rollup.rollup_refold(stored, rollup.grid_hour_rollup, t.positions, rollup.refold_since(watermark))
    return folded.select("cell_y", "cell_x", "hour_bucket", "observations", "vehicles")


def _merged_sets(t):
    """Two halves of the log, folded and stored apart; the second brings vehicles and hours the first may not have."""
    even, odd = (t.positions.filter(F.col("arrival") % 2 == i) for i in (0, 1))
    root = shared_dir(t.spark, "sets")
    known = t.spark.createDataFrame([], "vehicle_id string, number bigint")
    sets = []
    for i, half in enumerate((even, odd)):
        rollup.vehicle_numbers(known, half).write.parquet(f"{root}/numbers={i}")
        known = t.spark.read.parquet(f"{root}/numbers={i}")
        rollup.grid_hour_sets(half, known).write.parquet(f"{root}/sets={i}")
        sets.append(t.spark.read.parquet(f"{root}/sets={i}"))
    return rollup.grid_hour_rollup(even), rollup.grid_hour_rollup(odd), rollup.merge_sets(*sets)


@query("rollup_merge_late", f"SELECT {_GRID} FROM grid_v")
def rollup_merge_late(t):
    return rounded(rollup.merge_grid_hours(*_merged_sets(t)), "speed_sum")


@query("rollup_coarse_vehicles", f"SELECT CAST(floor(floor(lat/{LAT_STEP}) / 4) AS INT) AS cell_y, CAST(floor(floor(lon/{LON_STEP}) / 4) AS INT) AS cell_x, ts - ts % 3600 AS hour_bucket, "
       "count(DISTINCT vehicle_id) AS vehicles FROM positions_v WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2, 3")
def rollup_coarse_vehicles(t):
    return rollup.set_counts(_merged_sets(t)[2], factor=4)


@query("grid_cells", f"SELECT {_CELL} FROM (SELECT cell_y // 2 AS gy, cell_x // 2 AS gx, "
       "CAST(sum(observations) AS BIGINT) AS observations, max(vehicles) AS peak_vehicles, "
       "CAST(sum(moving) AS BIGINT) AS moving, CAST(sum(stopped) AS BIGINT) AS stopped, sum(speed_sum) AS speed_sum, "
       "CAST(sum(speed_n) AS BIGINT) AS speed_n, min(speed_min) AS speed_min, max(speed_max) AS speed_max "
       "FROM grid_v GROUP BY 1, 2) WHERE observations >= 8")
def grid_cells(t):
    return rounded(rollup.grid_cells(rollup.grid_hour_rollup(t.positions), 0, factor=2), "speed_sum")


@query("grid_bounds", f"SELECT {_CELL} FROM (SELECT cell_y AS gy, cell_x AS gx, "
       "CAST(sum(observations) AS BIGINT) AS observations, max(vehicles) AS peak_vehicles, "
       "CAST(sum(moving) AS BIGINT) AS moving, CAST(sum(stopped) AS BIGINT) AS stopped, sum(speed_sum) AS speed_sum, "
       "CAST(sum(speed_n) AS BIGINT) AS speed_n, min(speed_min) AS speed_min, max(speed_max) AS speed_max FROM grid_v "
       f"WHERE cell_y BETWEEN CAST(trunc(28.55e0/{LAT_STEP}) AS INT) - 1 AND CAST(trunc(28.65e0/{LAT_STEP}) AS INT) + 1 "
       f"AND cell_x BETWEEN CAST(trunc(77.15e0/{LON_STEP}) AS INT) - 1 AND CAST(trunc(77.25e0/{LON_STEP}) AS INT) + 1 "
       "GROUP BY 1, 2) WHERE observations >= 8")
def grid_bounds(t):
    return rounded(rollup.grid_cells(rollup.grid_hour_rollup(t.positions), 0, bbox=BOX), "speed_sum")


@query("grid_extent", f"SELECT max(observations) AS max_obs, round(min(speed_sum/nullif(speed_n, 0)), 4) AS min_speed, "
       "round(max(speed_sum/nullif(speed_n, 0)), 4) AS max_speed, count(*) AS cell_hours, "
       f"min(hour_bucket) AS first_hour, max(hour_bucket) AS last_hour FROM grid_v WHERE hour_bucket >= {SINCE_DAY}")
def grid_extent(t):
    return rounded(rollup.grid_extent(rollup.grid_hour_rollup(t.positions), SINCE_DAY), "min_speed", "max_speed")


@query("rollup_counts", "SELECT (SELECT count(*) FROM grid_v) AS cells, (SELECT count(*) FROM route_hours_v) AS routes")
def rollup_counts(t):
    counts = rollup.rollup_counts(rollup.grid_hour_rollup(t.positions), rollup.route_hour_rollup(t.positions))
    return counts.select("cells", "routes")


@query("distinct_grid_cells", "SELECT count(*) AS cells FROM (SELECT DISTINCT cell_y, cell_x FROM grid_v "
       f"WHERE hour_bucket >= {SINCE_DAY})")
def distinct_grid_cells(t):
    return rollup.distinct_grid_cells(rollup.grid_hour_rollup(t.positions), SINCE_DAY)


@query("hourly_series", "SELECT hour_bucket, observations, vehicle_hours, routes, moving, stopped, "
       f"CASE WHEN speed_n > 0 THEN {_SPEED} END AS avg_speed_kmh, {pct('stopped', 'observations')} AS dwell_pct FROM ("
       "SELECT hour_bucket, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(vehicles) AS BIGINT) AS vehicle_hours, "
       "count(DISTINCT route_id) AS routes, CAST(sum(moving) AS BIGINT) AS moving, CAST(sum(stopped) AS BIGINT) AS stopped, "
       f"sum(speed_sum) AS speed_sum, sum(speed_n) AS speed_n FROM route_hours_v WHERE hour_bucket >= {SINCE_DAY} GROUP BY 1)")
def hourly_series(t):
    return rollup.hourly_series(rollup.route_hour_rollup(t.positions), SINCE_DAY)


_BY_HOUR = ("SELECT hour, weekend, avg(routes) AS avg_routes_live, count(*) AS samples FROM (SELECT hour_bucket, "
            "CAST(hour_bucket % 86400 // 3600 AS INT) AS hour, (hour_bucket // 86400 + 4) % 7 IN (0, 6) AS weekend, "
            "count(DISTINCT route_id) AS routes FROM route_hours_v GROUP BY 1, 2, 3) GROUP BY 1, 2")


@query("route_coverage_by_hour", f"SELECT hour, weekend, round(avg_routes_live, 4) AS avg_routes_live, samples FROM ({_BY_HOUR})")
def route_coverage_by_hour(t):
    return rounded(rollup.route_coverage_by_hour(rollup.route_hour_rollup(t.positions), 0), "avg_routes_live")


def _temporal(t):
    by_hour = rollup.route_coverage_by_hour(rollup.route_hour_rollup(t.positions), 0)
    return rollup.temporal_coverage(by_hour, t.routes.agg(F.count("*").alias("routes")))


@query("temporal_extremes", f"""
    , slots AS (SELECT hour, weekend, round(avg_routes_live*100e0/(SELECT count(*) FROM routes_v), 1) AS pct_live FROM ({_BY_HOUR}))
    , best AS (SELECT * FROM slots ORDER BY pct_live DESC, hour, weekend LIMIT 1)
    , worst AS (SELECT * FROM slots ORDER BY pct_live, hour, weekend LIMIT 1)
    SELECT best.hour AS best_hour, best.weekend AS best_weekend, best.pct_live AS best_pct_live,
           worst.hour AS worst_hour, worst.weekend AS worst_weekend, worst.pct_live AS worst_pct_live FROM best, worst""")
def temporal_extremes(t):
    return rollup.temporal_extremes(_temporal(t))


@query("ingest_timeseries", "SELECT ts // 900 * 900 AS bucket, count(*) AS observations, "
       f"count(DISTINCT vehicle_id) AS vehicles, {kmh('avg(speed)')} AS avg_speed_kmh FROM positions_v "
       f"WHERE ts >= {SINCE_DAY} GROUP BY 1")
def ingest_timeseries(t):
    return rollup.ingest_timeseries(t.positions, 900, SINCE_DAY)


_EDGE = lambda i: f"CAST(CAST(round({i}*2*3.6e0) AS INT) AS VARCHAR)"


@query("speed_histogram", f"SELECT bin, CASE WHEN bin = 11 THEN {_EDGE('bin')} || '+' ELSE {_EDGE('bin')} || '-' || {_EDGE('(bin+1)')} "
       "END AS label, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(12)) LEFT JOIN "
       "(SELECT least(CAST(trunc(speed/2) AS INT), 11) AS bin, count(*) AS n FROM positions_v "
       f"WHERE ts >= {SINCE_DAY} AND speed IS NOT NULL GROUP BY 1) USING (bin)")
def speed_histogram(t):
    return rollup.speed_histogram(t.positions, SINCE_DAY)


_CORRIDOR = (f"SELECT route_id, CAST(floor(lat/{LAT_STEP}) AS INT) AS gy, CAST(floor(lon/{LON_STEP}) AS INT) AS gx, "
             f"count(*) AS observations, avg(lat) AS lat, avg(lon) AS lon, sum(speed) FILTER (WHERE {MOVING}) AS speed_sum, "
             f"count(*) FILTER (WHERE {MOVING}) AS speed_n, count(*) FILTER (WHERE speed <= 0.5e0) AS stopped "
             "FROM positions_v WHERE lat IS NOT NULL AND route_id IS NOT NULL GROUP BY 1, 2, 3")
_CORRIDOR_POINTS = (f"SELECT route_id, gy, gx, round(lat, 5) AS lat, round(lon, 5) AS lon, observations, "
                    f"CASE WHEN speed_n > 0 THEN {_SPEED} END AS speed_kmh, "
                    f"{pct('stopped', 'observations')} AS dwell_pct FROM ({_CORRIDOR})")


@query("route_corridor", f"SELECT route_id, gy, gx, round(lat, 9) AS lat, round(lon, 9) AS lon, observations, "
       f"round(coalesce(speed_sum, 0e0), 4) AS speed_sum, speed_n, stopped FROM ({_CORRIDOR})")
def route_corridor(t):
    cells = rollup.route_corridor(t.positions, 0).drop("speed_kmh", "dwell_pct")
    return rounded(rounded(cells, "speed_sum"), "lat", "lon", digits=9)


@query("corridor_summary", "SELECT route_id, count(*) AS cells, CAST(sum(observations) AS BIGINT) AS observations, "
       "round(avg(speed_kmh), 1) AS avg_speed_kmh, min(speed_kmh) AS slowest_kmh, max(speed_kmh) AS fastest_kmh "
       f"FROM ({_CORRIDOR_POINTS}) GROUP BY 1")
def corridor_summary(t):
    return rollup.corridor_summary(rollup.route_corridor(t.positions, 0))


@query("log_extent", "SELECT max(ts) AS newest_ts, min(ts) AS oldest_ts, "
       f"count(*) FILTER (WHERE ts >= {SINCE_DAY}) AS observations_since FROM positions_v")
def log_extent(t):
    return rollup.log_extent(t.positions, SINCE_DAY)


_PULLS = ("SELECT polled_at, CASE WHEN polled_at % 60 = 0 THEN 'vehicle' ELSE 'trip_update' END AS endpoint, "
          "CASE WHEN polled_at % 60 <> 0 THEN CAST(polled_at // 30 % 7 AS INT) END AS zone_id, ok = 1 AS is_success, "
          "new_rows, entity_count - new_rows AS changed_rows, "
          "CAST(to_timestamp(polled_at + 19800 + polled_at % 97 * 900) AT TIME ZONE 'UTC' AS DATE) AS day FROM polls_v")


@query("coverage_calendar", "SELECT day, endpoint, zone_id, count(*) AS calls, count(*) FILTER (WHERE is_success) AS ok_calls, "
       "min(moment) AS first_call, max(moment) AS last_call, CAST(sum(new_rows) AS BIGINT) AS new_rows, "
       "CAST(sum(changed_rows) AS BIGINT) AS changed_rows FROM (SELECT *, polled_at + polled_at % 97 * 900 AS moment FROM "
       f"({_PULLS})) GROUP BY 1, 2, 3")
def coverage_calendar(t):
    polled = F.col("polled_at")
    vehicle = polled % 60 == 0
    pulls = t.polls.select(
        (polled + polled % 97 * 900).alias("polled_at"),
        F.when(vehicle, "vehicle").otherwise("trip_update").alias("endpoint"),
        F.when(~vehicle, F.call_function("div", polled, F.lit(30)) % 7).cast("int").alias("zone_id"),
        (F.col("ok") == 1).alias("is_success"), "new_rows",
        (F.col("entity_count") - F.col("new_rows")).alias("changed_rows"))
    return quality.coverage_calendar(pulls)


_KNOWN_CELLS = ("SELECT *, (gy + 0.5e0)*{lat} AS lat, (gx + 0.5e0)*{lon} AS lon, {speed} AS speed_kmh, "
                "{dwell} AS dwell_pct FROM cells_v WHERE observations >= 40 AND speed_n > 0").format(
    lat=LAT_STEP, lon=LON_STEP, speed=_SPEED, dwell=pct("stopped", "observations"))


@query("hotspots", f"""
    , known AS ({_KNOWN_CELLS})
    , listed AS (
      SELECT 'congestion' AS ranking, CAST(row_number() OVER (ORDER BY speed_kmh, gy, gx) AS INT) AS rank, * FROM known
        WHERE dwell_pct <= 35 AND speed_kmh <= 15 QUALIFY rank <= 12
      UNION ALL SELECT 'dwell', CAST(row_number() OVER (ORDER BY dwell_pct DESC, gy, gx) AS INT) AS rank, * FROM known QUALIFY rank <= 12
      UNION ALL SELECT 'busiest', CAST(row_number() OVER (ORDER BY observations DESC, gy, gx) AS INT) AS rank, * FROM known QUALIFY rank <= 12)
    , labelled AS (SELECT l.*, s.stop_id, s.stop_name AS place, row_number() OVER (PARTITION BY ranking, rank ORDER BY
        (s.stop_lat-l.lat)*(s.stop_lat-l.lat) + (s.stop_lon-l.lon)*(s.stop_lon-l.lon), s.stop_id) AS nearest
      FROM listed l LEFT JOIN stops_v s ON s.stop_lat BETWEEN l.lat - 0.01e0 AND l.lat + 0.01e0
        AND s.stop_lon BETWEEN l.lon - 0.01e0 AND l.lon + 0.01e0)
    SELECT ranking, rank, gy, gx, lat, lon, observations, peak_vehicles, speed_kmh, dwell_pct, stop_id, place
    FROM labelled WHERE nearest = 1""")
def hotspots(t):
    cells = rollup.grid_cells(rollup.grid_hour_rollup(t.positions), 0, min_observations=40)
    return spatial.hotspots(cells, t.stops)


_EXPORT = ("SELECT gy, gx, observations AS obs, peak_vehicles, moving, stopped, "
           f"CASE WHEN speed_n > 0 THEN {_SPEED} END AS speed_kmh, {pct('stopped', 'observations')} AS dwell_pct "
           "FROM cells_v WHERE observations >= 8")


def _export(t):
    return export.grid_compact_export(rollup.grid_cells(rollup.grid_hour_rollup(t.positions), 0))


@query("grid_compact_export", _EXPORT)
def grid_compact_export(t):
    return _export(t)


_FLOOR_RANK = ("(SELECT max({c}) FILTER (WHERE rn = least(n, CAST(floor(n*{p}e0) AS BIGINT) + 1)) FROM (SELECT {c}, "
               "row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM cells WHERE {c} IS NOT NULL))")


@query("nearest_rank_percentile", f", cells AS ({_EXPORT}) SELECT count(*) AS count, false AS truncated, "
       "min(speed_kmh) AS speed_min, max(speed_kmh) AS speed_max, min(obs) AS obs_min, max(obs) AS obs_max, "
       f"{_FLOOR_RANK.format(c='speed_kmh', p='0.1')} AS speed_p10, {_FLOOR_RANK.format(c='speed_kmh', p='0.9')} AS speed_p90, "
       f"{_FLOOR_RANK.format(c='obs', p='0.9')} AS obs_p90 FROM cells")
def nearest_rank_percentile(t):
    return export.grid_scales(_export(t))
