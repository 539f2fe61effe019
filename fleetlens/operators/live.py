"""The fleet as it is now: filters, states, per-route figures and rankings over the latest rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (FRESH_S, IMPLAUSIBLE_MPS, MOVING_MPS, MPS_TO_KMH, SLOW_KMH, STALE_S)
from ..functions import geo, parse
from ..functions.measures import count_if, kmh, safe_pct
from .keyed import lookup_join
from .quantiles import linear_percentiles


# ---- filters --------------------------------------------------------------
def latest_filter(latest: DataFrame, now: int, route_id: str | None = None, bbox=None,
                  max_age_s: int | None = None) -> DataFrame:
    rows = latest
    if route_id:
        rows = rows.filter(F.col("route_id") == route_id)
    if bbox is not None:
        rows = rows.filter(geo.in_box(bbox))
    if max_age_s:
        rows = rows.filter(F.col("ts") >= now - max_age_s)
    return rows


def route_decorate(rows: DataFrame, routes: DataFrame) -> DataFrame:
    names = routes.select("route_id", F.col("route_short_name").alias("route_name"), "route_desc", "agency_id")
    return lookup_join(rows, names, "route_id")


def fleet_filter(vehicles: DataFrame, now: int, route_id: str | None = None, agency_id: str | None = None,
                 freshness: str = "all", motion: str = "all", slow_only: bool = False,
                 bunched: DataFrame | None = None) -> DataFrame:
    """The dashboard's conjunction of filters; a missing speed counts as standing still."""
    age, speed = F.lit(now) - F.col("ts"), F.coalesce("speed", F.lit(0.0))
    moving = speed > MOVING_MPS
    tests = {
        "fresh": age <= FRESH_S, "stale": age > STALE_S,
        "moving": moving, "stopped": ~moving,
    }
    rows = vehicles
    for wanted in (freshness, motion):
        if wanted != "all":
            rows = rows.filter(tests[wanted])
    if route_id:
        rows = rows.filter(F.col("route_id") == route_id)
    if agency_id:
        rows = rows.filter(F.col("agency_id") == agency_id)
    if slow_only:
        rows = rows.filter(moving & (speed * MPS_TO_KMH < SLOW_KMH))
    if bunched is not None:
        rows = rows.join(bunched.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    return rows


# ---- fleet figures --------------------------------------------------------
def fleet_stats(latest: DataFrame, now: int, window_s: int = STALE_S) -> DataFrame:
    """Active means seen inside the window; moving here has no upper speed limit."""
    active = F.col("ts") >= now - window_s
    when = lambda name: F.when(active, F.col(name))
    return latest.agg(
        count_if(active).alias("active_vehicles"), F.count_distinct(when("route_id")).alias("active_routes"),
        F.avg(when("speed")).alias("avg_speed"), F.max(when("ts")).alias("newest_ts"),
        F.min(when("ts")).alias("oldest_ts"),
        count_if(active & (F.col("speed") > MOVING_MPS)).alias("moving"),
        count_if(~active).alias("stale_vehicles"))


def fleet_overview(latest: DataFrame, polls: DataFrame, now: int, window_s: int = STALE_S,
                   recent: int = 20) -> DataFrame:
    """Fleet figures with success rate and mean latency of the most recent polls."""
    last = polls.orderBy(F.desc("polled_at")).limit(recent)
    ok = F.col("ok") == 1
    success = last.agg(F.round(count_if(ok) / F.nullif(F.count("*"), F.lit(0)), 3))
    latency = last.agg(F.round(F.avg(F.when(ok, F.coalesce("latency_ms", F.lit(0)))), 0).cast("bigint"))
    return fleet_stats(latest, now, window_s).select(
        "active_vehicles", "active_routes", "moving", "stale_vehicles",
        F.when(F.col("avg_speed") != 0, kmh("avg_speed")).alias("avg_speed_kmh"), "newest_ts",
        success.scalar().alias("poll_success_rate"), latency.scalar().alias("avg_poll_latency_ms"))


def active_routes(latest: DataFrame, routes: DataFrame, *, limit: int) -> DataFrame:
    busiest = (latest.filter(F.col("route_id").isNotNull()).groupBy("route_id")
               .agg(F.count("*").alias("vehicles"), kmh(F.avg("speed")).alias("avg_speed_kmh"))
               .orderBy(F.desc("vehicles"), "route_id").limit(limit))
    named = lookup_join(busiest, routes.select("route_id", "route_short_name", "route_desc"), "route_id")
    return named.select("route_id", F.coalesce("route_short_name", "route_id").alias("route_name"),
                        "route_desc", "vehicles", "avg_speed_kmh")


def live_vehicle_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("route_id").isNotNull()).groupBy("route_id").agg(F.count("*").alias("vehicles"))


def _age(now: int):
    return F.lit(now) - F.col("ts")


def fleet_states(latest: DataFrame, now: int) -> DataFrame:
    """Overlapping states in one pass over the snapshot."""
    age, speed = _age(now), F.col("speed")
    stale = age > STALE_S
    blank = F.coalesce("trip_id", F.lit("")) == ""
    nowhere = F.col("lat").isNull() | F.col("lon").isNull()
    return latest.agg(
        F.count("*").alias("total"), count_if(age <= FRESH_S).alias("fresh"),
        count_if(~stale & (speed > MOVING_MPS)).alias("moving"),
        count_if(~stale & (speed <= MOVING_MPS)).alias("stopped"),
        count_if(stale).alias("stale"), count_if(blank).alias("no_trip"),
        count_if(nowhere).alias("no_position"), count_if(speed >= IMPLAUSIBLE_MPS).alias("implausible"))


def in_service(latest: DataFrame, now: int) -> DataFrame:
    """Rows that are not stale and name a route."""
    return latest.filter((_age(now) <= STALE_S) & F.col("route_id").isNotNull() & (F.col("route_id") != ""))


def route_live_stats(latest: DataFrame, routes: DataFrame, bunched_per_route: DataFrame, now: int) -> DataFrame:
    """Per route: vehicles, mean speed, moving vehicles with their mean speed, bunched vehicles."""
    plausible = F.col("speed") < IMPLAUSIBLE_MPS
    moving = plausible & (F.col("speed") > MOVING_MPS)
    stats = in_service(latest, now).groupBy("route_id").agg(
        F.count("*").alias("vehicles"), count_if(moving).alias("moving"),
        kmh(F.avg(F.when(plausible, F.col("speed")))).alias("avg_speed_kmh"),
        kmh(F.avg(F.when(moving, F.col("speed")))).alias("moving_speed_kmh"))
    named = lookup_join(stats, routes.select("route_id", "route_short_name", "route_desc"), "route_id")
    return named.join(bunched_per_route, "route_id", "left").select(
        "route_id", F.coalesce("route_short_name", "route_id").alias("route_name"), "route_desc", "vehicles",
        "moving", "avg_speed_kmh", "moving_speed_kmh", F.coalesce("bunched", F.lit(0)).alias("bunched"))


def busiest_routes(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("vehicles"), "route_id").limit(limit)


def slowest_routes(stats: DataFrame, limit: int = 10, min_moving: int = 3) -> DataFrame:
    pool = stats.filter((F.col("moving") >= min_moving) & F.col("moving_speed_kmh").isNotNull())
    return pool.orderBy("moving_speed_kmh", "route_id").limit(limit)


def most_bunched_routes(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.filter(F.col("bunched") > 0).orderBy(F.desc("bunched"), "route_id").limit(limit)


def dispatch_hours(latest: DataFrame) -> DataFrame:
    """Vehicles by dispatch hour of their trip id, 0-23, every hour present; stale rows count."""
    counts = latest.select(parse.dispatch_hour("trip_id").alias("hour")).filter(
        F.col("hour").isNotNull()).groupBy("hour").agg(F.count("*").alias("n"))
    axis = latest.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return axis.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("vehicles"))


def service_day_trim(hours: DataFrame) -> DataFrame:
    """Without the empty hours before the first and after the last busy one."""
    busy = hours.filter(F.col("vehicles") > 0)
    first, last = busy.agg(F.min("hour")).scalar(), busy.agg(F.max("hour")).scalar()
    return hours.filter((F.col("hour") >= first) & (F.col("hour") <= last))


def fleet_speeds(latest: DataFrame, now: int) -> DataFrame:
    return latest.filter((_age(now) <= STALE_S) & (F.col("speed") < IMPLAUSIBLE_MPS)).select("speed")


def speed_percentiles(latest: DataFrame, now: int) -> DataFrame:
    """Mean, median and 85th percentile of plausible fresh speeds, linear between ranks."""
    speeds = fleet_speeds(latest, now)
    ranks = linear_percentiles(speeds, "speed", {"p50": 0.50, "p85": 0.85}, 0.0, IMPLAUSIBLE_MPS)
    mean = speeds.agg(kmh(F.avg("speed")).alias("avg_kmh"), F.count("*").alias("sample"))
    return mean.select("avg_kmh", *[kmh(ranks.select(p).scalar()).alias(f"{p}_kmh") for p in ("p50", "p85")],
                       "sample")


def route_live_coverage(latest: DataFrame, routes: DataFrame, now: int) -> DataFrame:
    """Live routes against scheduled ones; a live route need not be scheduled."""
    live = in_service(latest, now).agg(F.count_distinct("route_id").alias("routes_live"))
    return coverage_against(live, routes)


def coverage_against(live: DataFrame, routes: DataFrame) -> DataFrame:
    scheduled = routes.agg(F.count("*").alias("n")).scalar()
    return live.select(
        scheduled.alias("routes_scheduled"), "routes_live",
        F.greatest(F.lit(0), scheduled - F.col("routes_live")).alias("routes_dark"),
        safe_pct("routes_live", scheduled).alias("pct_live"))


def bunching_summary(latest: DataFrame, bunched: DataFrame) -> DataFrame:
    total = latest.agg(F.count("*").alias("n")).scalar()
    return bunched.agg(F.count("*").alias("bunched_vehicles"),
                       F.count_distinct("route_id").alias("routes")).select(
        "bunched_vehicles", "routes", safe_pct("bunched_vehicles", total).alias("pct"))
