"""The six quality layers. Every function takes frames already limited to its window, or the
window's bounds; every result is a small frame."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (DAY_S, DELAY_FEED_ZONE, FRESH_THRESHOLDS_S, GAP_BUCKETS, GRID_LAT_DEG, GRID_LON_DEG,
                         IMPLAUSIBLE_MPS, POPULATION_FIELDS, STALE_S)
from ..functions import clock
from ..functions.measures import count_if, safe_pct
from ..sources.scans import time_window
from .keyed import latest_in_window, lookup_join
from .live import coverage_against, fleet_stats


# ---- coverage -------------------------------------------------------------
def fleet_coverage(latest: DataFrame, now: int, expected: int | None) -> DataFrame:
    stats = fleet_stats(latest, now)
    expected_col = F.lit(expected).cast("bigint")
    return stats.select(F.col("active_vehicles").alias("active"), expected_col.alias("expected"),
                        safe_pct("active_vehicles", expected_col).alias("pct"))


def route_coverage(positions: DataFrame, routes: DataFrame, now: int, window_s: int = STALE_S) -> DataFrame:
    """Routes of the vehicles seen in the last five minutes, by their newest report."""
    seen = latest_in_window(positions, now - window_s, now)
    live = seen.agg(F.count_distinct(F.when(F.col("route_id") != "", F.col("route_id"))).alias("routes_live"))
    return coverage_against(live, routes)


def spatial_coverage(observed: DataFrame, stops: DataFrame) -> DataFrame:
    """Observed cells (one-row frame ``cells``) against the cells of the box around all stops."""
    height = F.max("stop_lat") - F.min("stop_lat")
    width = F.max("stop_lon") - F.min("stop_lon")
    area = F.greatest(height, F.lit(0.0)) / GRID_LAT_DEG * (F.greatest(width, F.lit(0.0)) / GRID_LON_DEG)
    box = stops.agg(F.greatest(F.lit(1).cast("bigint"), F.bround(area, 0).cast("bigint")).alias("total"),
                    F.count("stop_lat").alias("located"))
    total = box.select(F.when(F.col("located") > 0, F.col("total")).alias("total"))
    return observed.select(F.col("cells").alias("cells_observed"), total.scalar().alias("cells_total"),
                           safe_pct("cells", total.scalar()).alias("pct"))


# ---- freshness ------------------------------------------------------------
def freshness_thresholds(rows: DataFrame, now: int) -> DataFrame:
    """Vehicles at most 30 / 60 / 120 / 300 s old, one row per threshold."""
    age = F.lit(now) - F.col("ts")
    counted = rows.agg(F.count("*").alias("total"),
                       *[count_if(age <= s).alias(f"within_{s}") for s in FRESH_THRESHOLDS_S])
    pairs = F.array(*[F.struct(F.lit(s).alias("threshold_s"), F.col(f"within_{s}").alias("vehicles"))
                      for s in FRESH_THRESHOLDS_S])
    return counted.select("total", F.explode(pairs).alias("p")).select(
        "p.threshold_s", "p.vehicles", safe_pct("p.vehicles", "total").alias("pct"))


def staleness_buckets(rows: DataFrame, now: int) -> DataFrame:
    """Vehicles by age; the first bucket also takes reports from the future."""
    age = F.lit(now) - F.col("ts")
    conditions = {name: (age <= high if low == 0 else (age > low) & (age <= high) if high else age > low)
                  for name, low, high in GAP_BUCKETS}
    counted = rows.agg(*[count_if(c).alias(name) for name, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("vehicles")) for n in conditions])
    return counted.select(F.explode(pairs).alias("p")).select("p.bucket", "p.vehicles")


def feed_age_cadence(polls: DataFrame) -> DataFrame:
    """Age of the feed when polled, mean spacing of distinct feed timestamps, mean latency.

    The spacings of sorted distinct values add up to last minus first.
    """
    good = polls.filter((F.col("ok") == 1) & (F.col("feed_timestamp") != 0))
    distinct = F.count_distinct("feed_timestamp")
    spacing = (F.max("feed_timestamp") - F.min("feed_timestamp")) / F.nullif(distinct - 1, F.lit(0))
    return good.agg(
        F.round(F.avg(F.col("polled_at") - F.col("feed_timestamp")), 1).alias("feed_age_at_source_s"),
        F.round(spacing, 1).alias("native_publish_cadence_s"),
        F.round(F.avg("latency_ms"), 0).cast("bigint").alias("ingest_ms"))


# ---- correctness ----------------------------------------------------------
def implausible_speed(rows: DataFrame) -> DataFrame:
    fast = count_if(F.col("speed") >= IMPLAUSIBLE_MPS)
    return rows.agg(F.count("*").alias("total"), fast.alias("implausible_speed")).withColumn(
        "pct", safe_pct("implausible_speed", "total"))


def coordinate_validity(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows at exactly (0, 0) and rows outside the box of all stops; half-empty ones are skipped."""
    box = stops.agg(F.struct(F.min("stop_lat").alias("lat0"), F.max("stop_lat").alias("lat1"),
                             F.min("stop_lon").alias("lon0"), F.max("stop_lon").alias("lon1")).alias("b")).scalar()
    boxed = rows.select("lat", "lon", box.alias("b"))
    inside = F.col("lat").between(F.col("b.lat0"), F.col("b.lat1")) & F.col("lon").between(
        F.col("b.lon0"), F.col("b.lon1"))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return boxed.agg(F.count("*").alias("total"), count_if(placed & ~inside).alias("out_of_bounds"),
                     count_if((F.col("lat") == 0) & (F.col("lon") == 0)).alias("zero_coord"))


def referential_integrity(positions: DataFrame, routes: DataFrame, trips: DataFrame, since: int) -> DataFrame:
    """Rows whose route or trip is not in the schedule; rows are counted per (route, trip) first."""
    pairs = time_window(positions, since).groupBy("route_id", "trip_id").agg(F.count("*").alias("n"))
    known = lambda df, key, flag: df.select(key).distinct().withColumn(flag, F.lit(True))
    checked = lookup_join(pairs, known(routes, "route_id", "_route"), "route_id")
    checked = lookup_join(checked, known(trips, "trip_id", "_trip"), "trip_id")
    missing = lambda key, flag: F.coalesce(F.sum(F.when(
        F.col(key).isNotNull() & F.col(flag).isNull(), F.col("n"))), F.lit(0))
    return checked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                       missing("route_id", "_route").alias("invalid_route_id"),
                       missing("trip_id", "_trip").alias("invalid_trip_id"))


def duplicate_snapshot_rate(polls: DataFrame) -> DataFrame:
    ok = F.col("ok") == 1
    return polls.agg(count_if(ok).alias("polls"),
                     count_if(ok & (F.coalesce("new_rows", F.lit(0)) == 0)).alias("duplicates")).withColumn(
        "pct", safe_pct("duplicates", "polls"))


# ---- field richness -------------------------------------------------------
def field_population(positions: DataFrame, since: int) -> DataFrame:
    counted = time_window(positions, since).agg(
        F.count("*").alias("total"), *[F.count(f).alias(f) for f in POPULATION_FIELDS])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("populated")) for f in POPULATION_FIELDS])
    return counted.select("total", F.explode(pairs).alias("p")).select(
        "p.field", "p.populated", "total", safe_pct("p.populated", "total").alias("pct"))


def static_feed_age(routes, stops, trips, shapes, loaded_at: int | None, now: int) -> DataFrame:
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    loaded = F.lit(loaded_at).cast("bigint")
    return routes.agg(F.count("*").alias("routes")).select(
        "routes", count(stops).alias("stops"), count(trips).alias("trips"), count(shapes).alias("shape_points"),
        loaded.alias("static_loaded_at"), F.round((F.lit(now) - loaded) / DAY_S, 1).alias("age_days"))


# ---- source reliability ---------------------------------------------------
def poll_success(polls: DataFrame) -> DataFrame:
    return polls.agg(F.count("*").alias("polls"), count_if(F.col("ok") == 1).alias("ok")).withColumn(
        "pct", safe_pct("ok", "polls"))


def error_breakdown(polls: DataFrame) -> DataFrame:
    text, status = F.lower(F.coalesce("error", F.lit(""))), F.col("http_status")
    kind = (F.when(text.contains("timeout") | text.contains("timed out"), "timeout")
            .when(status >= 500, "5xx").when(status >= 400, "4xx")
            .when(F.coalesce("entity_count", F.lit(0)) == 0, "empty_body").otherwise("other"))
    return polls.filter(F.col("ok") != 1).groupBy(kind.alias("kind")).agg(F.count("*").alias("polls"))


def volume_stability(polls: DataFrame) -> DataFrame:
    """Entities per successful poll; unstable when the smallest is under half the mean."""
    n = F.coalesce("entity_count", F.lit(0))
    stats = polls.filter(F.col("ok") == 1).agg(
        F.avg(n).alias("mean"), F.stddev_pop(n).alias("stdev"), F.min(n).alias("low"), F.max(n).alias("high"))
    return stats.select(
        F.round("mean", 1).alias("mean_entities"), F.coalesce(F.round("stdev", 1), F.lit(0.0)).alias("stdev_entities"),
        F.col("low").alias("min_entities"), F.col("high").alias("max_entities"),
        F.coalesce(F.col("low") < F.col("mean") * 0.5, F.lit(False)).alias("unstable"))


def schema_fingerprint(rows: DataFrame, fields) -> DataFrame:
    """The sorted names of fields with a value anywhere in the batch, joined by commas."""
    present = rows.agg(*[F.bool_or(F.col(f).isNotNull()).alias(f) for f in fields])
    names = F.array(*[F.when(F.col(f), F.lit(f)) for f in sorted(fields)])
    return present.select(F.array_join(F.array_compact(names), ",").alias("fields"))


def schema_changes(batches: DataFrame, fields, batch: str = "batch_ts") -> DataFrame:
    """Fingerprint per batch, kept where it differs from the batch before."""
    names = F.array(*[F.when(F.bool_or(F.col(f).isNotNull()), F.lit(f)) for f in sorted(fields)])
    prints = batches.groupBy(batch).agg(F.array_join(F.array_compact(names), ",").alias("fields"))
    # One row per batch: the window sees poll times, not observations.
    before = F.lag("fields", 1, "").over(Window.orderBy(batch))
    return prints.withColumn("_before", before).filter(F.col("fields") != F.col("_before")).select(
        F.col(batch).alias("changed_at"), "fields")


# ---- composite ------------------------------------------------------------
def composite_score(*scores):
    """Mean of the sub-scores that are present."""
    present = F.array_compact(F.array(*scores))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, F.round(total / F.size(present), 1))


def coverage_calendar(pulls: DataFrame, zone: str = DELAY_FEED_ZONE) -> DataFrame:
    """Per local day, endpoint and zone: calls, good calls, first and last call, rows written."""
    return pulls.groupBy(clock.local_date("polled_at", zone).alias("day"), "endpoint", "zone_id").agg(
        F.count("*").alias("calls"), count_if(F.col("is_success")).alias("ok_calls"),
        F.min("polled_at").alias("first_call"), F.max("polled_at").alias("last_call"),
        F.sum("new_rows").alias("new_rows"), F.sum("changed_rows").alias("changed_rows"))
