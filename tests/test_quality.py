from conftest import HUB, NOW, one, values
from pyspark.sql import functions as F

from fleetlens.constants import DAY_S
from fleetlens.operators import continuity, keyed, matching, quality, rollup
from fleetlens.plans import report


def test_referential_integrity_counts_occurrences(data):
    assert one(quality.referential_integrity(data.positions, data.routes, data.trips, 0)) == {
        "total": 9, "invalid_route_id": 0, "invalid_trip_id": 0}
    odd = data.positions.withColumn("route_id", F.when(F.col("vehicle_id") == "TRAM-7", "X").otherwise(F.col("route_id")))
    assert one(quality.referential_integrity(odd, data.routes, data.trips, 0))["invalid_route_id"] == 5


def test_field_population(data):
    got = {r["field"]: r["populated"] for r in quality.field_population(data.positions, 0).collect()}
    assert got == {"route_id": 9, "lat": 8, "speed": 8, "bearing": 8, "trip_id": 7, "stop_id": 0, "occupancy_status": 0,
                   "congestion_level": 0, "current_status": 0}


def test_freshness(data):
    assert values(quality.freshness_thresholds(data.latest, NOW), "threshold_s", "vehicles") == [(30, 1), (60, 1), (120, 2), (300, 3)]
    assert dict(values(quality.staleness_buckets(data.latest, NOW), "bucket", "vehicles")) == {
        "b_0_60": 1, "b_60_180": 1, "b_180_300": 1, "b_300_600": 0, "b_600_plus": 1}


def test_poll_figures(data):
    assert one(quality.poll_success(data.polls)) == {"polls": 5, "ok": 4, "pct": 80.0}
    assert values(quality.error_breakdown(data.polls), "kind", "polls") == [("5xx", 1)]
    assert one(quality.feed_age_cadence(data.polls)) == {
        "feed_age_at_source_s": 7.0, "native_publish_cadence_s": 60.0, "ingest_ms": 300}
    volume = one(quality.volume_stability(data.polls))
    assert (volume["mean_entities"], volume["stdev_entities"], volume["unstable"]) == (810.0, 4.0, False)
    nothing = data.polls.filter("ok = 9")
    assert one(quality.volume_stability(nothing)) == {"mean_entities": None, "stdev_entities": 0.0, "min_entities": None,
                                                      "max_entities": None, "unstable": False}
    assert one(quality.poll_success(nothing))["pct"] is None


def test_error_kinds_in_order(spark):
    rows = [(0, 503, "Read timed out", 0), (0, 503, "x", 0), (0, 404, None, 9), (0, 200, None, 0), (0, None, "x", 5), (1, 500, None, 0)]
    polls = spark.createDataFrame(rows, "ok int, http_status int, error string, entity_count int")
    assert dict(values(quality.error_breakdown(polls), "kind", "polls")) == {"timeout": 1, "5xx": 1, "4xx": 1, "empty_body": 1, "other": 1}


def test_coordinates_skip_half_empty_rows(spark, data):
    rows = spark.createDataFrame([(0.0, 0.0), (HUB[0], None), HUB, (HUB[0] + 20, HUB[1])], "lat double, lon double")
    assert one(quality.coordinate_validity(rows, data.stops)) == {"total": 4, "out_of_bounds": 2, "zero_coord": 1}


def test_expected_fleet_may_be_unknown(data):
    assert one(quality.fleet_coverage(data.latest, NOW, None)) == {"active": 3, "expected": None, "pct": None}


def test_schema_changes(spark):
    rows = [(1, "a", None), (1, "b", None), (2, "a", None), (3, "a", 1.0)]
    batches = spark.createDataFrame(rows, "batch_ts bigint, vehicle_id string, speed double")
    assert values(quality.schema_changes(batches, ["speed", "vehicle_id"]), "changed_at", "fields") == [(1, "vehicle_id"), (3, "speed,vehicle_id")]


def tables_of(data):
    log = data.positions
    return report.ReportTables(
        positions=log, latest=data.latest, polls=data.polls, grid_hours=rollup.grid_hour_rollup(log), route_hours=rollup.route_hour_rollup(log),
        gap_hours=continuity.gap_hour_counters(log, 0, NOW), trip_state=continuity.trip_gap_state(log, 0, NOW),
        matches=matching.trip_nearest_match(keyed.live_trip_keys(log, 0, NOW), data.trips, NOW), routes=data.routes, trips=data.trips,
        stops=data.stops, shapes=data.shapes, static_loaded_at=NOW - DAY_S)


def test_report_and_metrics(data):
    parts = report.layers(tables_of(data), NOW, minutes=60)
    summary = one(report.quality_summary(parts))
    assert 0 <= summary["composite_score"] <= 100
    scores = [v for k, v in summary.items() if k != "composite_score" and v is not None]
    assert abs(summary["composite_score"] - sum(scores) / len(scores)) < 0.051
    schema = quality.schema_fingerprint(data.positions, ["vehicle_id", "speed"]).select(
        F.size(F.split("fields", ",")).alias("field_count"), F.lit(NOW).alias("changed_at"))
    rows = report.metrics_long(parts, schema).collect()
    names = {r["metric"] for r in rows}
    assert "gtfs_quality_composite_score" in names and "gtfs_quality_schema_fields_count" in names
    assert "gtfs_quality_fleet_coverage_pct" not in names          # no expected fleet size
    keys = [(r["metric"], tuple(sorted(r["labels"].items()))) for r in rows]
    assert len(keys) == len(set(keys)) and all(r["value"] is not None for r in rows)
    hours = [r for r in rows if r["metric"] == "gtfs_quality_temporal_coverage_pct"]
    assert 0 < len(hours) <= 48 and set(hours[0]["labels"]) == {"hour", "weekend"}


def test_default_windows_differ_by_layer(data):
    parts = report.layers(tables_of(data), NOW)
    assert one(parts["poll_success"])["polls"] == 5
    assert one(parts["trip_completeness"])["trips"] == 3
