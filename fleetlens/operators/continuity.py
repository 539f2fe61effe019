"""Reporting gaps: how long each vehicle, and each trip of it, stayed silent between reports.

The log is cut into (vehicle, hour) pieces first. Its key (vehicle, ts) is unique, so a piece has
at most 3600 rows however many rows the vehicle has in total. Gaps inside a piece come from a
window over the piece; the gap into a piece comes from a second window over one row per piece.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GAP_BUCKETS, GAP_THRESHOLD_S, REPORT_INTERVAL_S
from ..functions import clock
from ..functions.measures import count_if, gap_bucket_conditions, safe_pct
from ..sources.scans import time_window

COUNTERS = ["gaps_total", "gaps_over_threshold", *[name for name, _, _ in GAP_BUCKETS]]


def _batch(log: DataFrame, since: int, until: int) -> DataFrame:
    return time_window(log, since + 1, until).withColumn(
        "hour_bucket", clock.hour_bucket())


def gap_flags(gap, threshold: int) -> dict:
    return {"gaps_total": gap.isNotNull(), "gaps_over_threshold": gap > threshold,
            **gap_bucket_conditions(gap)}


def _with_previous(batch: DataFrame, keys: list) -> DataFrame:
    window = Window.partitionBy(*keys, "hour_bucket").orderBy("ts")
    return batch.withColumn("prev_ts", F.lag("ts").over(window))


def _pieces(batch: DataFrame, keys: list, measures: list) -> DataFrame:
    """One row per (key, hour): its first and last ts and measures over its inner gaps.

    The grouping follows the window's partitioning, so it adds no shuffle.
    """
    return _with_previous(batch, keys).groupBy(*keys, "hour_bucket").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *measures)


def _entering_gap(pieces: DataFrame, keys: list, state: DataFrame | None) -> DataFrame:
    """Adds ``gap_in``: silence before the piece, seeded by the state carried from earlier batches."""
    before = F.lag("last_ts").over(Window.partitionBy(*keys).orderBy("hour_bucket"))
    if state is not None:
        carried = state.select(*keys, F.col("last_ts").alias("_carried"))
        pieces = pieces.join(carried, keys, "left")
        before = F.coalesce(before, F.col("_carried"))
    return pieces.withColumn("gap_in", F.col("first_ts") - before)


def report_gaps(log: DataFrame, since: int, until: int, state: DataFrame | None = None,
                by_trip: bool = False) -> DataFrame:
    """One row per report that has an earlier one: (vehicle[, trip], ts, prev_ts, gap_s)."""
    keys = ["vehicle_id", "trip_id"] if by_trip else ["vehicle_id"]
    batch = _batch(log, since, until).select(*keys, "ts", "hour_bucket")
    if by_trip:
        batch = batch.filter(F.col("trip_id").isNotNull())
    inner = _with_previous(batch, keys).filter(F.col("prev_ts").isNotNull()).select(*keys, "ts", "prev_ts")
    pieces = batch.groupBy(*keys, "hour_bucket").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    entering = _entering_gap(pieces, keys, state).filter(F.col("gap_in").isNotNull()).select(
        *keys, F.col("first_ts").alias("ts"), (F.col("first_ts") - F.col("gap_in")).alias("prev_ts"))
    return inner.unionByName(entering).withColumn("gap_s", F.col("ts") - F.col("prev_ts"))


def gap_hour_counters(log: DataFrame, since: int, until: int, threshold: int = GAP_THRESHOLD_S,
                      state: DataFrame | None = None) -> DataFrame:
    """Gaps per hour of the later report: total, over the threshold, and by duration."""
    batch = _batch(log, since, until).select("vehicle_id", "ts", "hour_bucket")
    inner = gap_flags(F.col("ts") - F.col("prev_ts"), threshold)
    pieces = _pieces(batch, ["vehicle_id"], [count_if(c).alias(f"_{n}") for n, c in inner.items()])
    entered = _entering_gap(pieces, ["vehicle_id"], state)
    outer = gap_flags(F.col("gap_in"), threshold)
    summed = entered.groupBy("hour_bucket").agg(
        *[(F.sum(f"_{n}") + count_if(c)).alias(n) for n, c in outer.items()])
    return summed.filter(F.col("gaps_total") > 0)


def add_counters(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counters are additive: the hours of a new batch add to the stored ones."""
    return stored.unionByName(fresh).groupBy("hour_bucket").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def vehicle_gap_state(log: DataFrame, since: int, until: int, stored: DataFrame | None = None) -> DataFrame:
    """Last ts per vehicle after the batch."""
    seen = _batch(log, since, until).select("vehicle_id", F.col("ts").alias("last_ts"))
    rows = seen if stored is None else stored.select("vehicle_id", "last_ts").unionByName(seen)
    return rows.groupBy("vehicle_id").agg(F.max("last_ts").alias("last_ts"))


def trip_gap_state(log: DataFrame, since: int, until: int, threshold: int = GAP_THRESHOLD_S,
                   stored: DataFrame | None = None) -> DataFrame:
    """Per (vehicle, trip): last ts, and whether any gap so far exceeded the threshold."""
    keys = ["vehicle_id", "trip_id"]
    batch = _batch(log, since, until).filter(F.col("trip_id").isNotNull()).select(*keys, "ts", "hour_bucket")
    pieces = _pieces(batch, keys, [F.max(F.col("ts") - F.col("prev_ts")).alias("longest")])
    gap = F.greatest(F.coalesce("longest", F.lit(0)), F.coalesce("gap_in", F.lit(0)))
    rows = _entering_gap(pieces, keys, stored).select(*keys, "last_ts", (gap > threshold).alias("has_gap"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*keys, "last_ts", "has_gap"))
    return rows.groupBy(*keys).agg(F.max("last_ts").alias("last_ts"), F.bool_or("has_gap").alias("has_gap"))


def gap_state_join(log: DataFrame, since: int, until: int, vehicles: DataFrame, trips: DataFrame) -> DataFrame:
    """Rows of a batch with the last ts carried for their vehicle and for their (vehicle, trip)."""
    batch = _batch(log, since, until).select("vehicle_id", "trip_id", "ts")
    with_vehicle = batch.join(vehicles.select("vehicle_id", F.col("last_ts").alias("vehicle_last_ts")),
                              "vehicle_id", "left")
    return with_vehicle.join(trips.select("vehicle_id", "trip_id", F.col("last_ts").alias("trip_last_ts")),
                             ["vehicle_id", "trip_id"], "left")


def continuity_report(log: DataFrame, hours: DataFrame, since: int, until: int) -> DataFrame:
    """Fleet means over vehicles and summed gap counters. Hours are taken by bucket start, so the
    partial first hour of the window is left out."""
    per_vehicle = time_window(log, since, until).groupBy("vehicle_id").agg(
        F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span"))
    fleet = per_vehicle.agg(
        F.count("*").alias("vehicles"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.avg("span").alias("avg_span_s"), F.avg("n").alias("avg_observations_per_vehicle"))
    gaps = hours.filter(F.col("hour_bucket").between(since, until)).agg(
        F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).alias("gaps"))
    both = fleet.withColumn("gaps", gaps.scalar())
    return both.select(*fleet.columns, *[F.col(f"gaps.{c}").alias(c) for c in COUNTERS])


def with_report_pct(report: DataFrame, interval_s: int = REPORT_INTERVAL_S) -> DataFrame:
    """Adds observed against expected reports per vehicle, as a ratio of fleet means, at most 100."""
    slots = F.when(F.col("avg_span_s") > 0, F.col("avg_span_s") / max(interval_s, 1) + 1)
    ratio = F.col("avg_observations_per_vehicle") / slots * 100
    pct = F.when(slots.isNotNull(), F.round(F.least(F.lit(100.0), ratio), 1))
    return report.withColumn("report_continuity_pct", pct).withColumn(
        "pct_of_gaps", safe_pct("gaps_over_threshold", "gaps_total"))


def trip_completeness(state: DataFrame, since: int, until: int) -> DataFrame:
    return state.filter(F.col("last_ts").between(since, until)).agg(
        F.count("*").alias("trips"), count_if(~F.col("has_gap")).alias("complete_trips")
    ).withColumn("pct", safe_pct("complete_trips", "trips"))
