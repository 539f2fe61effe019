"""Column builders, each over a whole driver table."""

from pyspark.sql import functions as F

from ...constants import GRID_LAT_DEG, GRID_LON_DEG
from ...functions import clock, geo, measures, parse
from ...sources import csv_lines
from ...operators import rollup
from ..driver_sql import LAT_STEP, LON_STEP, kmh, pct
from .registry import query, rounded


@query("cell_index", f"SELECT arrival, CAST(floor(lat/{LAT_STEP}) AS INT) AS cell_y, CAST(floor(lon/{LON_STEP}) AS INT) AS cell_x FROM positions_v")
def cell_index(t):
    return t.positions.select("arrival", geo.cell_y().alias("cell_y"), geo.cell_x().alias("cell_x"))


@query("cell_center", f"SELECT gy, gx, round((gy + 0.5e0)*{LAT_STEP}, 8) AS lat, round((gx + 0.5e0)*{LON_STEP}, 8) AS lon FROM cells_v")
def cell_center(t):
    cells = rollup.grid_cells(rollup.grid_hour_rollup(t.positions), 0, min_observations=0)
    return rounded(cells.select("gy", "gx", geo.cell_center("gy", GRID_LAT_DEG).alias("lat"),
                                geo.cell_center("gx", GRID_LON_DEG).alias("lon")), "lat", "lon", digits=8)


@query("point_segment_distance_m", ", s AS (SELECT arrival, (77.15e0-lon)*111320e0*c AS ax, (28.55e0-lat)*111320e0 AS ay, "
       "0.1e0*111320e0*c AS dx, 0.1e0*111320e0 AS dy FROM (SELECT *, greatest(cos(radians(lat)), 1e-9) AS c FROM positions_v)), "
       "u AS (SELECT *, greatest(0e0, least(1e0, -(ax*dx + ay*dy)/(dx*dx + dy*dy))) AS k FROM s) "
       "SELECT arrival, round(sqrt(power(ax + k*dx, 2) + power(ay + k*dy, 2)), 3) AS metres FROM u WHERE ax IS NOT NULL AND ay IS NOT NULL")
def point_segment_distance_m(t):
    placed = t.positions.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    metres = geo.point_segment_distance_m("lat", "lon", 28.55, 77.15, 28.65, 77.25)
    return rounded(placed.select("arrival", metres.alias("metres")), "metres", digits=3)


@query("hour_bucket", "SELECT arrival, ts // 3600 * 3600 AS bucket FROM positions_v")
def hour_bucket(t):
    return t.positions.select("arrival", clock.hour_bucket().alias("bucket"))


@query("time_bucket", "SELECT arrival, ts // 900 * 900 AS bucket FROM positions_v")
def time_bucket(t):
    return t.positions.select("arrival", clock.time_bucket("ts", 900).alias("bucket"))


@query("mps_to_kmh", f"SELECT arrival, {kmh('speed')} AS kmh FROM positions_v")
def mps_to_kmh(t):
    return t.positions.select("arrival", measures.kmh("speed").alias("kmh"))


@query("safe_pct", f"SELECT cell_y, cell_x, hour_bucket, {pct('stopped', 'speed_n')} AS pct FROM grid_v")
def safe_pct(t):
    grid = rollup.grid_hour_rollup(t.positions)
    return grid.select("cell_y", "cell_x", "hour_bucket", measures.safe_pct("stopped", "speed_n").alias("pct"))


@query("hour_of_day", "SELECT arrival, CAST(ts % 86400 // 3600 AS INT) AS hour_utc, CAST((ts + 19800) % 86400 // 3600 AS INT) AS hour_local FROM positions_v")
def hour_of_day(t):
    return t.positions.select("arrival", clock.hour_of_day().alias("hour_utc"),
                              clock.hour_of_day("ts", "Asia/Kolkata").alias("hour_local"))


@query("is_weekend", "SELECT arrival, dayofweek(make_timestamp(ts*1000000)) IN (0, 6) AS weekend FROM positions_v")
def is_weekend(t):
    return t.positions.select("arrival", clock.is_weekend().alias("weekend"))


_EDGE = lambda i: f"CAST(CAST(round({i}*2*3.6e0) AS INT) AS VARCHAR)"


@query("label_range", f"SELECT arrival, CASE WHEN bin = 11 THEN {_EDGE('bin')} || '+' ELSE {_EDGE('bin')} || '-' || {_EDGE('(bin+1)')} END AS label "
       "FROM (SELECT arrival, least(CAST(trunc(speed/2) AS INT), 11) AS bin FROM positions_v)")
def label_range(t):
    bins = t.positions.select("arrival", F.least(F.floor(F.col("speed") / 2).cast("int"), F.lit(11)).alias("bin"))
    return bins.select("arrival", measures.label_range("bin", 2.0, 12).alias("label"))


def _breaks(value, low, high):
    steps = " ".join(f"WHEN {value} <= {low} + ({high}-{low})*{i}e0/6 THEN {i}" for i in range(6))
    return f"CASE WHEN {value} IS NULL THEN NULL {steps} ELSE 6 END"


@query("metric_class", f"SELECT arrival, CAST(6 - ({_breaks('kmh', '8e0', '45e0')}) AS INT) AS congestion, CAST({_breaks('share', '0e0', '100e0')} AS INT) AS dwell "
       f"FROM (SELECT arrival, speed*3.6e0 AS kmh, CAST(arrival % 101 AS DOUBLE) AS share FROM positions_v)")
def metric_class(t):
    rows = t.positions.select("arrival", (F.col("speed") * 3.6).alias("kmh"),
                              (F.col("arrival") % 101).cast("double").alias("share"))
    return rows.select("arrival", measures.metric_class("kmh", 8, 45, reverse=True).alias("congestion"),
                       measures.metric_class("share", 0, 100).alias("dwell"))


@query("null_safe_diff", "SELECT i.trip_id, i.stop_sequence, (s.stop_id, s.arrival_delay_s, s.departure_delay_s, s.stop_status) IS DISTINCT FROM "
       "(i.stop_id, i.arrival_delay_s, i.departure_delay_s, i.stop_status) AS differs FROM delays_incoming_v i JOIN delays_stored_v s "
       "USING (service_date, trip_id, stop_sequence)")
def null_safe_diff(t):
    stored, incoming = t.delay_rounds
    values = ["stop_id", "arrival_delay_s", "departure_delay_s", "stop_status"]
    keys = ["service_date", "trip_id", "stop_sequence"]
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values])
    differs = measures.any_differs([f"old_{c}" for c in values], values)
    return incoming.join(old, keys).select("trip_id", "stop_sequence", differs.alias("differs"))


_CODE = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_id || '.0' WHEN 3 THEN 'x' || event_id WHEN 4 THEN 'N/A' ELSE CAST(value AS VARCHAR) END"


def _codes(t):
    eid = F.col("event_id")
    text = (F.when(eid % 7 == 0, "").when(eid % 7 == 1, F.concat(F.lit(" "), eid, F.lit(" ")))
            .when(eid % 7 == 2, F.concat(eid, F.lit(".0"))).when(eid % 7 == 3, F.concat(F.lit("x"), eid))
            .when(eid % 7 == 4, "N/A").otherwise(F.col("value").cast("string")))
    return t.raw_events.select("event_id", "value", text.alias("code"))


@query("tolerant_cast", "SELECT event_id, CASE WHEN event_id % 7 = 1 THEN CAST(event_id AS INT) END AS as_int, "
       "CASE WHEN event_id % 7 IN (1, 2) THEN CAST(event_id AS DOUBLE) WHEN event_id % 7 > 4 THEN value END AS as_float FROM events_v")
def tolerant_cast(t):
    return _codes(t).select("event_id", parse.to_int("code").alias("as_int"), parse.to_float("code").alias("as_float"))


@query("placeholder_clean", "SELECT event_id, CASE WHEN event_id % 7 IN (0, 4) THEN NULL WHEN event_id % 7 = 1 THEN CAST(event_id AS VARCHAR) "
       "WHEN event_id % 7 = 2 THEN event_id || '.0' WHEN event_id % 7 = 3 THEN 'x' || event_id ELSE 'number' END AS text, "
       "CASE WHEN event_id % 7 IN (1, 2) THEN event_id WHEN event_id % 7 > 4 THEN CAST(trunc(value) AS BIGINT) END AS whole, "
       "CASE WHEN event_id % 7 IN (1, 2) THEN CAST(event_id AS DOUBLE) WHEN event_id % 7 > 4 THEN value END AS real, "
       "CASE WHEN event_id % 7 IN (1, 2) AND event_id > 0 THEN event_id - 19800 WHEN event_id % 7 > 4 AND trunc(value) > 0 "
       "THEN CAST(trunc(value) AS BIGINT) - 19800 END AS epoch_s, "
       "CASE WHEN event_id % 7 NOT IN (0, 4) THEN event_id = 1 END AS flag FROM events_v")
def placeholder_clean(t):
    # The text of a double differs between engines in notation only, so it is compared as a number.
    shown = F.when(F.col("event_id") % 7 > 4, F.when(parse.clean_text("code").isNotNull(), "number")).otherwise(
        parse.clean_text("code"))
    flag = F.when(F.col("event_id") % 7 > 4, F.lit(False)).otherwise(parse.clean_flag("code"))
    return _codes(t).select("event_id", shown.alias("text"), parse.clean_int("code").alias("whole"),
                            parse.clean_float("code").alias("real"), parse.clean_epoch("code", 19_800).alias("epoch_s"),
                            flag.alias("flag"))


@query("service_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) + 3650 END AS day FROM orders")
def service_date_parse(t):
    key, day = F.col("o_orderkey"), F.date_add(F.col("o_orderdate").cast("date"), 3650)
    text = (F.when(key % 5 < 2, F.date_format(day, "ddMMyyyy")).when(key % 5 < 4, F.date_format(day, "yyyyMMdd"))
            .otherwise(F.when(key % 10 == 4, "000000").otherwise("31022026")))
    return t.table("orders").select("o_orderkey", text.alias("text")).select("o_orderkey", parse.service_date("text").alias("day"))


@query("gtfs_time_to_seconds", "SELECT trip_id, stop_sequence, arrival_s AS seconds, CAST(NULL AS INT) AS malformed FROM stop_times_v")
def gtfs_time_to_seconds(t):
    short = clock.schedule_seconds(F.substring("arrival_time", 1, 5))
    return t.stop_times.select("trip_id", "stop_sequence", clock.schedule_seconds("arrival_time").alias("seconds"),
                               short.alias("malformed"))


@query("regex_split_records", "SELECT c_custkey, CAST(3 AS INT) AS records, c_custkey || ',' || c_name || ',https://a.example/x' AS second FROM customer")
def regex_split_records(t):
    key = F.col("c_custkey")
    record = lambda k: F.concat(k, F.lit(","), F.col("c_name"), F.lit(",https://a.example/x"))
    line = F.concat(record(F.lit(7)), record(key), record(F.lit(9)))
    parts = t.table("customer").select("c_custkey", csv_lines.regex_split_records(line).alias("p"))
    return parts.select("c_custkey", F.size("p").alias("records"), F.get("p", F.lit(1)).alias("second"))
