"""Hourly rollups on the 250 m grid and per route, and everything read from them."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (GRID_LAT_DEG, GRID_LON_DEG, HOUR_S, MIN_OBS_DEFAULT, ROLLUP_REWIND_S)
from ..functions import clock, geo
from ..functions.measures import (count_if, is_plausible_moving, is_stopped, kmh, label_range, mean_kmh,
                                  safe_pct)
from ..sources.scans import time_window


def _speed_measures(extremes: bool) -> list:
    moving = is_plausible_moving()
    measures = [
        F.count("*").alias("observations"),
        F.count_distinct("vehicle_id").alias("vehicles"),
        count_if(moving).alias("moving"),
        count_if(is_stopped()).alias("stopped"),
        F.coalesce(F.sum(F.when(moving, F.col("speed"))), F.lit(0.0)).alias("speed_sum"),
        count_if(moving).alias("speed_n"),
    ]
    if extremes:
        measures += [F.min(F.when(moving, F.col("speed"))).alias("speed_min"),
                     F.max(F.when(moving, F.col("speed"))).alias("speed_max")]
    return measures


def grid_hour_rollup(positions: DataFrame, since: int = 0) -> DataFrame:
    """Counts and speeds per cell and hour, over rows that carry both coordinates.

    The distinct count is planned as a partial aggregate on (cell, hour, vehicle), so a terminal
    cell with a large share of all rows is spread by vehicle before it is merged.
    """
    located = time_window(positions, since).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.groupBy(geo.cell_y().alias("cell_y"), geo.cell_x().alias("cell_x"),
                           clock.hour_bucket().alias("hour_bucket")).agg(*_speed_measures(True))


def route_hour_rollup(positions: DataFrame, since: int = 0) -> DataFrame:
    """The same per route and hour; rows without a position count too."""
    routed = time_window(positions, since).filter(F.col("route_id").isNotNull())
    return routed.groupBy("route_id", clock.hour_bucket().alias("hour_bucket")).agg(*_speed_measures(False))


def refold_since(watermark: int | None, full: bool = False) -> int:
    """First hour to recompute: one hour before the watermark, aligned down; 0 rebuilds all."""
    if full or watermark is None:
        return 0
    start = max(0, watermark - ROLLUP_REWIND_S)
    return start - start % HOUR_S


def rollup_refold(stored: DataFrame, fold, positions: DataFrame, since: int) -> DataFrame:
    """Stored buckets before ``since`` plus a fresh fold of the rest."""
    kept = stored.filter(F.col("hour_bucket") < since)
    return kept.unionByName(fold(positions, since))


# ---- mergeable rollups ------------------------------------------------------
GRID_HOUR_KEY = ("cell_y", "cell_x", "hour_bucket")
_DEAL = 256


def vehicle_numbers(known: DataFrame, positions: DataFrame) -> DataFrame:
    """``vehicle_id``, ``number``: those ``known``, and a number without gaps for each vehicle not numbered yet.

    New vehicles are numbered inside slices by hash, behind the totals of the slices before: one row per slice is ordered
    in one place, never the vehicles.
    """
    fresh = positions.select("vehicle_id").filter(F.col("vehicle_id").isNotNull()).distinct().join(known, "vehicle_id", "left_anti")
    dealt = fresh.withColumn("slice", F.pmod(F.hash("vehicle_id"), F.lit(_DEAL)))
    start = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("slice").agg(F.count("*").alias("n")).select("slice", start.alias("start"))  # _DEAL rows at most
    base = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("base")).scalar()
    place = F.row_number().over(Window.partitionBy("slice").orderBy("vehicle_id")) - 1
    numbered = dealt.withColumn("place", place).join(F.broadcast(offsets), "slice")
    return known.select("vehicle_id", "number").unionByName(numbered.select(
        "vehicle_id", (base + F.col("start") + F.col("place")).cast("bigint").alias("number")))


def grid_hour_sets(positions: DataFrame, numbers: DataFrame) -> DataFrame:
    """``block``, ``bits`` per cell and hour: the exact set of vehicles there, as bitmaps over their numbers.

    One bitmap covers 32,768 numbers and is built inside the tasks before it moves.
    """
    located = positions.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "vehicle_id", geo.cell_y().alias("cell_y"), geo.cell_x().alias("cell_x"), clock.hour_bucket().alias("hour_bucket"))
    seen = located.distinct().join(numbers, "vehicle_id")
    return seen.groupBy(*GRID_HOUR_KEY, F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merge_sets(*sets: DataFrame) -> DataFrame:
    """One set per cell and hour of several, whichever rows they came from."""
    return reduce(DataFrame.unionByName, sets).groupBy(*GRID_HOUR_KEY, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_counts(sets: DataFrame, factor: int = 1) -> DataFrame:
    """Exact distinct vehicles per hour and cell, ``factor`` cells wide, from stored sets alone."""
    wide = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    whole = sets.groupBy(wide("cell_y"), wide("cell_x"), "hour_bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*GRID_HOUR_KEY).agg(F.sum(F.bitmap_count("bits")).alias("vehicles"))


def merge_grid_hours(stored: DataFrame, late: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored hourly cells and those of rows that came late, without the log: counts and sums are added, extremes
    compared, and the vehicles counted in the merged ``sets``. Neither side may hold a row of the other."""
    sums = ("observations", "moving", "stopped", "speed_sum", "speed_n")
    both = stored.drop("vehicles").unionByName(late.drop("vehicles")).groupBy(*GRID_HOUR_KEY).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("speed_min").alias("speed_min"), F.max("speed_max").alias("speed_max"))
    return both.join(set_counts(sets), list(GRID_HOUR_KEY)).select(*stored.columns)


def grid_cells(grid: DataFrame, since: int, factor: int = 1, bbox=None,
               min_observations: int = MIN_OBS_DEFAULT, limit: int | None = None) -> DataFrame:
    """Coarser cells by integer division: sums of counts, peak of hourly vehicles; a limit keeps the busiest."""
    hours = grid.filter(F.col("hour_bucket") >= since)
    if bbox is not None:
        rows, columns = geo.grid_bounds(bbox)
        hours = hours.filter(F.col("cell_y").between(*rows) & F.col("cell_x").between(*columns))
    cells = hours.groupBy(
        geo.coarse_index("cell_y", factor).alias("gy"), geo.coarse_index("cell_x", factor).alias("gx"),
    ).agg(
        F.sum("observations").alias("observations"), F.max("vehicles").alias("peak_vehicles"),
        F.sum("moving").alias("moving"), F.sum("stopped").alias("stopped"),
        F.sum("speed_sum").alias("speed_sum"), F.sum("speed_n").alias("speed_n"),
        F.min("speed_min").alias("speed_min"), F.max("speed_max").alias("speed_max"))
    cells = cells.filter(F.col("observations") >= min_observations)
    return cells if limit is None else cells.orderBy(F.desc("observations"), "gy", "gx").limit(limit)


def with_speed_and_dwell(cells: DataFrame) -> DataFrame:
    return cells.withColumn("speed_kmh", mean_kmh("speed_sum", "speed_n")).withColumn(
        "dwell_pct", safe_pct("stopped", "observations"))


def grid_extent(grid: DataFrame, since: int) -> DataFrame:
    speed = F.when(F.col("speed_n") > 0, F.col("speed_sum") / F.col("speed_n"))
    return grid.filter(F.col("hour_bucket") >= since).agg(
        F.max("observations").alias("max_obs"), F.min(speed).alias("min_speed"),
        F.max(speed).alias("max_speed"), F.count("*").alias("cell_hours"),
        F.min("hour_bucket").alias("first_hour"), F.max("hour_bucket").alias("last_hour"))


def rollup_counts(grid: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows of both rollups: cell-hours and route-hours."""
    tagged = grid.select(F.lit(1).alias("c"), F.lit(0).alias("r")).unionAll(
        routes.select(F.lit(0).alias("c"), F.lit(1).alias("r")))
    return tagged.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("cells"),
                      F.coalesce(F.sum("r"), F.lit(0)).alias("routes"))


def distinct_grid_cells(grid: DataFrame, since: int) -> DataFrame:
    cells = grid.filter(F.col("hour_bucket") >= since).select("cell_y", "cell_x").distinct()
    return cells.agg(F.count("*").alias("cells"))


def hourly_series(route_hours: DataFrame, since: int) -> DataFrame:
    summed = route_hours.filter(F.col("hour_bucket") >= since).groupBy("hour_bucket").agg(
        F.sum("observations").alias("observations"), F.sum("vehicles").alias("vehicle_hours"),
        F.count_distinct("route_id").alias("routes"), F.sum("moving").alias("moving"),
        F.sum("stopped").alias("stopped"), F.sum("speed_sum").alias("speed_sum"),
        F.sum("speed_n").alias("speed_n"))
    return summed.select(
        "hour_bucket", "observations", "vehicle_hours", "routes", "moving", "stopped",
        mean_kmh("speed_sum", "speed_n").alias("avg_speed_kmh"),
        safe_pct("stopped", "observations").alias("dwell_pct")).orderBy("hour_bucket")


def route_coverage_by_hour(route_hours: DataFrame, since: int, zone: str = "UTC") -> DataFrame:
    """Distinct routes per hour, then the mean per hour of day and weekend flag."""
    per_hour = route_hours.filter(F.col("hour_bucket") >= since).groupBy("hour_bucket").agg(
        F.count_distinct("route_id").alias("routes"))
    return per_hour.groupBy(
        clock.hour_of_day("hour_bucket", zone).alias("hour"),
        clock.is_weekend("hour_bucket", zone).alias("weekend"),
    ).agg(F.avg("routes").alias("avg_routes_live"), F.count("*").alias("samples"))


def temporal_coverage(by_hour: DataFrame, route_count: DataFrame) -> DataFrame:
    """Slot means against the number of scheduled routes (a one-row frame with ``routes``)."""
    scheduled = route_count.select("routes").scalar()
    return by_hour.select(
        "hour", "weekend", F.round("avg_routes_live", 1).alias("avg_routes_live"),
        safe_pct("avg_routes_live", scheduled).alias("pct_live"), "samples")


def temporal_extremes(temporal: DataFrame) -> DataFrame:
    """Best and worst slot by share of live routes; ties go to the earliest weekday slot."""
    high = F.struct(F.coalesce("pct_live", F.lit(-1.0)), -F.col("hour"), ~F.col("weekend"))
    low = F.struct(F.coalesce("pct_live", F.lit(101.0)), F.col("hour"), F.col("weekend"))
    picked = temporal.agg(F.max_by(F.struct("hour", "weekend", "pct_live"), high).alias("best"),
                          F.min_by(F.struct("hour", "weekend", "pct_live"), low).alias("worst"))
    return picked.select(*(
        F.col(f"{end}.{field}").alias(f"{end}_{field}")
        for end in ("best", "worst") for field in ("hour", "weekend", "pct_live")))


def ingest_timeseries(positions: DataFrame, bucket_s: int, since: int) -> DataFrame:
    return (time_window(positions, since)
            .groupBy(clock.time_bucket("ts", bucket_s).alias("bucket"))
            .agg(F.count("*").alias("observations"), F.count_distinct("vehicle_id").alias("vehicles"),
                 kmh(F.avg("speed")).alias("avg_speed_kmh"))
            .orderBy("bucket"))


def speed_histogram(positions: DataFrame, since: int, bins: int = 12, width: float = 2.0) -> DataFrame:
    """Counts in bins of ``width`` m/s, the last one open-ended; every bin is present."""
    bin_of = F.least(F.floor(F.col("speed") / width).cast("int"), F.lit(bins - 1))
    counts = (time_window(positions, since).filter(F.col("speed").isNotNull())
              .groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")))
    axis = positions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counts, "bin", "left").select(
        "bin", label_range("bin", width, bins).alias("label"), F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy("bin")


def route_corridor(positions: DataFrame, since: int, route_id: str | None = None) -> DataFrame:
    """Cells along a route with mean position, speed and dwell; all routes when none is named."""
    rows = time_window(positions, since).filter(F.col("lat").isNotNull() & F.col("route_id").isNotNull())
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    moving = is_plausible_moving()
    cells = rows.groupBy("route_id", geo.cell_y().alias("gy"), geo.cell_x().alias("gx")).agg(
        F.count("*").alias("observations"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.coalesce(F.sum(F.when(moving, F.col("speed"))), F.lit(0.0)).alias("speed_sum"),
        count_if(moving).alias("speed_n"), count_if(is_stopped()).alias("stopped"))
    return with_speed_and_dwell(cells)


def corridor_points(cells: DataFrame) -> DataFrame:
    return cells.select("route_id", "gy", "gx", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"),
                        "observations", "speed_kmh", "dwell_pct")


def corridor_summary(cells: DataFrame) -> DataFrame:
    """Per route: mean of the cell means, and the slowest and fastest cell."""
    return cells.groupBy("route_id").agg(
        F.count("*").alias("cells"), F.sum("observations").alias("observations"),
        F.round(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        F.min("speed_kmh").alias("slowest_kmh"), F.max("speed_kmh").alias("fastest_kmh"))


def log_extent(positions: DataFrame, since: int) -> DataFrame:
    return positions.agg(F.max("ts").alias("newest_ts"), F.min("ts").alias("oldest_ts"),
                         count_if(F.col("ts") >= since).alias("observations_since"))


def cell_centers(cells: DataFrame) -> DataFrame:
    return cells.withColumn("lat", geo.cell_center("gy", GRID_LAT_DEG)).withColumn(
        "lon", geo.cell_center("gx", GRID_LON_DEG))
