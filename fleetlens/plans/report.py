"""The quality report: six layers over one set of tables, a composite score, long-form metrics."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DAY_S, GAP_BUCKETS, HOUR_S
from ..operators import continuity, keyed, matching, quality, rollup, schedule, spatial


@dataclass(frozen=True)
class ReportTables:
    """What the report reads: the log, its projections and rollups, and the schedule."""

    positions: DataFrame
    latest: DataFrame
    polls: DataFrame
    grid_hours: DataFrame
    route_hours: DataFrame
    gap_hours: DataFrame
    trip_state: DataFrame
    matches: DataFrame
    routes: DataFrame
    trips: DataFrame
    stops: DataFrame
    shapes: DataFrame
    static_loaded_at: int | None = None
    expected_fleet: int | None = None


@dataclass(frozen=True)
class Windows:
    """Seconds each layer looks back; one common window when minutes are given."""

    coverage: int = 3 * DAY_S
    freshness: int = 1800
    continuity: int = 3 * HOUR_S
    correctness: int = HOUR_S
    richness: int = HOUR_S
    reliability: int = DAY_S

    @classmethod
    def of(cls, minutes: float | None) -> "Windows":
        return cls() if minutes is None else cls(*[max(1, int(minutes * 60))] * 6)


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def layers(t: ReportTables, now: int, minutes: float | None = None) -> dict[str, DataFrame]:
    """Every layer as a small frame, by name."""
    w = Windows.of(minutes)
    polls = lambda window: t.polls.filter(F.col("polled_at") >= now - window)
    fresh = keyed.latest_in_window(t.positions, now - w.freshness, now)
    checked = keyed.latest_in_window(t.positions, now - w.correctness, now)
    since = now - w.correctness
    report = continuity.continuity_report(t.positions, t.gap_hours, now - w.continuity, now)
    by_hour = rollup.route_coverage_by_hour(t.route_hours, now - w.coverage)
    return {
        "fleet_coverage": quality.fleet_coverage(t.latest, now, t.expected_fleet),
        "route_coverage": quality.route_coverage(t.positions, t.routes, now),
        "dark_routes": schedule.dark_routes(t.routes, t.trips, t.latest, limit=None),
        "spatial_coverage": quality.spatial_coverage(
            rollup.distinct_grid_cells(t.grid_hours, now - w.coverage), t.stops),
        "temporal_coverage": rollup.temporal_coverage(by_hour, _count(t.routes, "routes")),
        "freshness": quality.freshness_thresholds(fresh, now),
        "staleness": quality.staleness_buckets(fresh, now),
        "feed_age": quality.feed_age_cadence(polls(w.freshness)),
        "continuity": continuity.with_report_pct(report),
        "trip_completeness": continuity.trip_completeness(t.trip_state, now - w.continuity, now),
        "implausible_speed": quality.implausible_speed(checked),
        "off_route": spatial.off_route_summary(checked, spatial.off_route_distance(checked, t.trips, t.shapes)),
        "coordinates": quality.coordinate_validity(checked, t.stops),
        "integrity": quality.referential_integrity(t.positions, t.routes, t.trips, since),
        "schedule_link": matching.trip_match_summary(t.matches, since),
        "duplicates": quality.duplicate_snapshot_rate(polls(w.correctness)),
        "fields": quality.field_population(t.positions, now - w.richness),
        "static_feed": quality.static_feed_age(t.routes, t.stops, t.trips, t.shapes, t.static_loaded_at, now),
        "poll_success": quality.poll_success(polls(w.reliability)),
        "errors": quality.error_breakdown(polls(w.reliability)),
        "volume": quality.volume_stability(polls(w.reliability)),
    }


def quality_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: the five sub-scores and their mean over those that are present."""
    value = lambda layer, column: parts[layer].select(column).scalar()
    minute = parts["freshness"].filter(F.col("threshold_s") == 60).select("pct").scalar()
    scores = parts["implausible_speed"].select(
        value("route_coverage", "pct_live").alias("route_coverage_pct"), minute.alias("fresh_60_pct"),
        value("continuity", "report_continuity_pct").alias("continuity_pct"),
        (100 - F.coalesce("pct", F.lit(0.0))).alias("plausible_pct"),
        value("poll_success", "pct").alias("poll_success_pct"))
    return scores.withColumn("composite_score", quality.composite_score(*[F.col(c) for c in scores.columns]))


# Metric names (after the prefix), the column each reads, and its labels.
METRIC_PREFIX = "gtfs_quality_"
METRICS = {
    "fleet_coverage": [("fleet_coverage_pct", "pct"), ("fleet_active_vehicles", "active"),
                       ("fleet_expected_vehicles", "expected")],
    "route_coverage": [("route_coverage_pct", "pct_live"), ("routes_scheduled", "routes_scheduled"),
                       ("routes_live", "routes_live"), ("routes_dark", "routes_dark")],
    "dark_routes": [("dark_route_top_trip_count", "trip_count")],
    "spatial_coverage": [("spatial_coverage_pct", "pct"), ("spatial_cells_observed", "cells_observed"),
                         ("spatial_cells_total", "cells_total")],
    "temporal_coverage": [("temporal_coverage_pct", "pct_live", ["hour", "weekend"])],
    "freshness": [("fresh_within_pct", "pct", ["threshold_s"])],
    "staleness": [("staleness_bucket_count", "vehicles", ["bucket"])],
    "feed_age": [("feed_age_at_source_seconds", "feed_age_at_source_s"),
                 ("native_publish_cadence_seconds", "native_publish_cadence_s"), ("ingest_latency_ms", "ingest_ms")],
    "continuity": [("report_continuity_pct", "report_continuity_pct"), ("vehicles_in_window", "vehicles"),
                   ("gaps_over_threshold", "gaps_over_threshold"), ("gap_pct_of_gaps", "pct_of_gaps"),
                   ("session_churn", "gaps_over_threshold")],
    "gap_durations": [("gap_duration_bucket_count", "gaps", ["bucket"])],
    "trip_completeness": [("trip_completeness_pct", "pct"), ("trips_total", "trips"),
                          ("trips_complete", "complete_trips")],
    "implausible_speed": [("implausible_speed_pct", "pct"), ("implausible_speed_count", "implausible_speed")],
    "off_route": [("off_route_pct_within_50m", "pct_within_50m"), ("off_route_avg_distance_m", "avg_distance_m"),
                  ("off_route_routes_sampled", "routes_sampled")],
    "coordinates": [("coordinate_out_of_bounds", "out_of_bounds"), ("coordinate_zero", "zero_coord")],
    "integrity": [("referential_invalid_route_id", "invalid_route_id"),
                  ("referential_invalid_trip_id", "invalid_trip_id")],
    "duplicates": [("duplicate_snapshot_pct", "pct")],
    "fields": [("field_population_pct", "pct", ["field"])],
    "static_feed": [("static_feed_age_days", "age_days"), ("static_routes", "routes"), ("static_stops", "stops"),
                    ("static_trips", "trips"), ("static_shape_points", "shape_points")],
    "poll_success": [("poll_success_pct", "pct")],
    "errors": [("error_breakdown_count", "polls", ["kind"])],
    "volume": [("feed_volume_mean", "mean_entities"), ("feed_volume_stdev", "stdev_entities"),
               ("feed_volume_min", "min_entities"), ("feed_volume_max", "max_entities"),
               ("feed_volume_unstable", "unstable")],
    "schema": [("schema_fields_count", "field_count"), ("schema_last_changed_timestamp", "changed_at")],
    "summary": [("composite_score", "composite_score")],
}


def gap_durations(report: DataFrame) -> DataFrame:
    """The gap buckets of the continuity layer, one row each."""
    pairs = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("gaps")) for n, _, _ in GAP_BUCKETS])
    return report.select(F.explode(pairs).alias("p")).select("p.*")


def schema_layer(batches: DataFrame, fields, batch: str = "batch_ts") -> DataFrame:
    """Number of fields with a value in the newest batch's field set, and since when that set holds."""
    changes = quality.schema_changes(batches, fields, batch)
    names = F.split(F.max_by("fields", "changed_at"), ",")
    return changes.agg(F.size(names).alias("field_count"), F.max("changed_at").alias("changed_at"))


def _gauges(df: DataFrame, specs) -> DataFrame:
    """Rows of a layer -> (metric, labels, value), one pass over the layer."""
    types = dict(df.dtypes)
    def label_map(names):
        if not names:
            return F.create_map().cast("map<string,string>")
        text = lambda n: (F.col(n).cast("int") if types[n] == "boolean" else F.col(n)).cast("string")
        return F.create_map(*[c for n in names for c in (F.lit(n), text(n))])
    entries = F.array(*[
        F.struct(F.lit(METRIC_PREFIX + spec[0]).alias("metric"),
                 label_map(spec[2] if len(spec) > 2 else []).alias("labels"),
                 F.col(spec[1]).cast("double").alias("value"))
        for spec in specs])
    return df.select(F.explode(entries).alias("m")).select("m.*").filter(F.col("value").isNotNull())


def metrics_long(parts: dict[str, DataFrame], schema: DataFrame | None = None) -> DataFrame:
    """All layers as (metric, labels, value); a value that cannot be computed has no row."""
    frames = {**parts, "summary": quality_summary(parts), "gap_durations": gap_durations(parts["continuity"]),
              "dark_routes": parts["dark_routes"].agg(F.max("trip_count").alias("trip_count"))}
    if schema is not None:
        frames["schema"] = schema
    return reduce(DataFrame.unionByName, [_gauges(frames[n], s) for n, s in METRICS.items() if n in frames])
