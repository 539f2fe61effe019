import pytest
from conftest import COSLAT, HUB, one, values
from pyspark.sql import functions as F

from fleetlens.constants import METRES_PER_DEGREE
from fleetlens.operators import keyed, schedule


def test_feed_counts(data):
    c = one(schedule.feed_counts(data.agency, data.routes, data.stops, data.trips, data.stop_times, data.shapes, data.positions))
    assert [c[k] for k in ("agencies", "routes", "stops", "trips", "stop_times", "shape_points", "history_rows")] == [2, 4, 6, 7, 11, 10, 9]
    assert c["max_lat"] == HUB[0] + 0.05


@pytest.mark.parametrize("text", ["quay l", "QUAY", "10"])
def test_route_search_ignores_case(data, text):
    found = schedule.route_search(data.routes, data.trips, text, limit=50)
    assert values(found, "route_id", "trip_count", "total") == [("L10", 3, 1)]


def test_route_page(data):
    page = schedule.route_search(data.routes, data.trips, None, limit=2, offset=1)
    assert [r["route_short_name"] for r in page.collect()] == ["20X", "F5"]


def test_route_shape_and_stops(data):
    points = schedule.route_shape(data.trips, data.shapes)
    line = one(schedule.polyline(points, "L10"))["line"]
    assert len(line) == 6 and (line[0]["lon"], line[0]["lat"]) == (HUB[1], HUB[0])
    assert points.filter("route_id = 'N90'").isEmpty()
    stops = schedule.route_stops(data.stop_times, data.trips, data.stops)
    assert [s for _, s in values(stops.filter("route_id = 'L10'"), "stop_sequence", "stop_id")] == ["Q1", "Q2", "Q3", "Q6"]
    assert stops.filter("route_id = 'F5'").isEmpty()


def test_stop_schedule_window_is_closed(data):
    at = lambda stop, low, high: [r["departure_s"] for r in schedule.stop_schedule(
        data.stop_times, data.trips, data.routes, stop, low, high, limit=50).collect()]
    assert at("Q1", 22_520, 25_500) == [22_520, 25_500]
    assert at("Q1", 22_521, 25_499) == []
    assert at("Q4", 0, 200_000) == [42_330, 89_999, 94_205]


def test_stop_search(data):
    box = (HUB[1] - 0.0005, HUB[0] - 0.0005, HUB[1] + 0.0025, HUB[0] + 0.002)
    assert values(schedule.stop_search(data.stops, bbox=box, limit=None), "stop_id") == [("Q1",), ("Q2",), ("Q3",)]
    assert values(schedule.stop_search(data.stops, "fish", limit=5), "stop_id") == [("Q3",)]
    assert values(schedule.stop_search(data.stops, "a\\b", limit=5), "stop_id") == []


def test_routes_nearby(spark, data):
    probes = spark.createDataFrame([(1, *HUB)], "probe_id int, lat double, lon double")
    found = {r["route_id"]: r for r in schedule.routes_nearby(
        probes, data.stops, data.stop_times, data.trips, data.routes, 600.0, limit=50).collect()}
    assert set(found) == {"L10", "L20"}
    assert found["L10"]["distance_m"] == 0.0 and len(found["L10"]["stops"]) == 4
    assert found["L20"]["stops"] == ["Fish Market"]
    assert abs(found["L20"]["distance_m"] - 0.002 * METRES_PER_DEGREE * COSLAT) < 0.5


def test_nearby_is_a_circle(spark, data):
    # Q2 and Q3 lie 136 m and 167 m away; a corner of the box at that radius is out of reach.
    probes = spark.createDataFrame([(1, HUB[0] + 0.0015, HUB[1] + 0.002)], "probe_id int, lat double, lon double")
    near = schedule.routes_nearby(probes, data.stops, data.stop_times, data.trips, data.routes, 170.0, limit=50)
    names = {n for r in near.collect() for n in r["stops"]}
    assert names == {"Mill Bridge", "Fish Market"}


def test_dark_routes(data):
    assert values(schedule.dark_routes(data.routes, data.trips, data.latest, limit=25), "route_id", "trip_count") == [("N90", 2)]


def test_lookup_join_splits_a_hot_key(spark):
    """A third of all rows has one key: same rows as a plain count, and the plan deals the key over tasks."""
    big = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id",
                                               F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("pad"))
    small = spark.range(-1, 300_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = keyed.lookup_join(big, small, "k")
        rows = joined.groupBy().agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.length("pad")).alias("p"))
        assert tuple(rows.collect()[0]) == (300_000, 2 * (sum(i for i in range(300_000) if i % 3) - 100_000), 300_000 * 256)
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
