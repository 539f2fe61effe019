"""Result shapes for clients: compact grid rows, map frames, trails, long-form metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import display_round
from ..sources.scans import time_window
from .keyed import lookup_join
from .quantiles import floor_ranks
from .rollup import with_speed_and_dwell

# The seven fields of a trail point.
TRAIL_COLUMNS = ["ts", "lat", "lon", "speed", "bearing", "route_id", "trip_id"]


def grid_compact_export(cells: DataFrame) -> DataFrame:
    """Cell rows in the fixed column order of the map client."""
    return with_speed_and_dwell(cells).select(
        "gy", "gx", F.col("observations").alias("obs"), "peak_vehicles", "moving", "stopped",
        "speed_kmh", "dwell_pct")


def grid_scales(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Legend ranges of the exported rows, their count, and whether the limit, if any, was reached."""
    reached = F.lit(False) if limit is None else F.count("*") >= limit
    totals = rows.agg(F.count("*").alias("count"), reached.alias("truncated"),
                      F.min("speed_kmh").alias("speed_min"), F.max("speed_kmh").alias("speed_max"),
                      F.min("obs").alias("obs_min"), F.max("obs").alias("obs_max"))
    speeds = floor_ranks(rows, "speed_kmh", {"speed_p10": 0.10, "speed_p90": 0.90}, 0.0, 100.0)
    volumes = floor_ranks(rows, "obs", {"obs_p90": 0.90}, 0.0, 100_000.0)
    kind = rows.schema["obs"].dataType
    return totals.select(
        "count", "truncated", "speed_min", "speed_max", speeds.select("speed_p10").scalar().alias("speed_p10"),
        speeds.select("speed_p90").scalar().alias("speed_p90"), "obs_min", "obs_max",
        volumes.select("obs_p90").scalar().cast(kind).alias("obs_p90"))


def wire_vehicles(batch: DataFrame) -> DataFrame:
    """Thin vehicle rows with display rounding."""
    return batch.select("vehicle_id", "ts", "route_id", "trip_id", display_round("lat", 5).alias("lat"),
                        display_round("lon", 5).alias("lon"), display_round("bearing", 0).alias("bearing"),
                        display_round("speed", 1).alias("speed"))


def wire_routes(batch: DataFrame, routes: DataFrame) -> DataFrame:
    """Each route of the batch once, with its names."""
    used = batch.select("route_id").filter((F.col("route_id") != "")).distinct()
    return lookup_join(used, routes.select("route_id", F.col("route_short_name").alias("name"),
                                           F.col("route_desc").alias("desc"), F.col("agency_id").alias("agency")),
                       "route_id")


def trail(positions: DataFrame, vehicle_id: str, since: int, until: int) -> DataFrame:
    """One vehicle's reports in a closed window, oldest first."""
    return time_window(positions, since, until).filter(F.col("vehicle_id") == vehicle_id).select(
        *TRAIL_COLUMNS).orderBy("ts")


def trail_linestring(positions: DataFrame, since: int, until: int) -> DataFrame:
    """Per vehicle: number of reports and the line through those with both coordinates.

    (vehicle, ts) is unique, so a line has at most one point per second of the window.
    """
    window = time_window(positions, since, until)
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("ts", "lon", "lat"))
    return window.groupBy("vehicle_id").agg(
        F.count("*").alias("reports"), F.sort_array(F.collect_list(point)).alias("p")).select(
        "vehicle_id", "reports", F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
