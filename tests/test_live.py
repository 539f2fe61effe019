import random

from conftest import NOW, one, values

from fleetlens.operators import live
from fleetlens.operators.quantiles import linear_percentiles


def test_fleet_stats(data):
    stats = one(live.fleet_stats(data.latest, NOW, 50_000))
    assert (stats["active_vehicles"], stats["active_routes"], stats["moving"]) == (4, 3, 2)
    assert one(live.fleet_stats(data.latest, NOW, 300))["stale_vehicles"] == 1


def test_fleet_states_overlap(data):
    states = one(live.fleet_states(data.latest, NOW))
    assert states == {"total": 4, "fresh": 1, "moving": 2, "stopped": 1, "stale": 1, "no_trip": 2,
                      "no_position": 1, "implausible": 0}


def test_latest_filter_is_closed(data):
    assert len(live.latest_filter(data.latest, NOW, max_age_s=70).collect()) == 2
    assert len(live.latest_filter(data.latest, NOW, route_id="L10").collect()) == 2


def test_fleet_filter(data):
    fleet = live.route_decorate(data.latest, data.routes)
    pick = lambda **f: [v for (v,) in values(live.fleet_filter(fleet, NOW, **f), "vehicle_id")]
    assert pick(motion="stopped") == ["F1", "X2"]
    assert pick(freshness="stale") == ["F1"]
    assert pick(agency_id="M2") == ["F1"]
    assert pick(slow_only=True) == []


def test_overview(data):
    view = one(live.fleet_overview(data.latest, data.polls, NOW))
    assert view["poll_success_rate"] == 0.8 and view["avg_poll_latency_ms"] == 300


def test_route_stats_and_rankings(spark, data):
    bunched = spark.createDataFrame([("L10", 2)], "route_id string, bunched bigint")
    stats = live.route_live_stats(data.latest, data.routes, bunched, NOW)
    assert values(stats, "route_id", "vehicles", "moving", "bunched") == [("L10", 2, 2, 2), ("L20", 1, 0, 0)]
    assert [r["route_id"] for r in live.busiest_routes(stats).collect()] == ["L10", "L20"]
    assert values(live.most_bunched_routes(stats), "route_id") == [("L10",)]
    assert live.slowest_routes(stats).isEmpty()


def test_dispatch_hours(spark):
    rows = spark.createDataFrame([("R1_07_15_9",), ("R1_07_20_8",), ("R1_25_00_1",), ("R1_07_15",), (None,), ("R1_x_0_1",)], "trip_id string")
    hours = live.dispatch_hours(rows)
    assert {r["hour"]: r["vehicles"] for r in hours.collect() if r["vehicles"]} == {7: 2}
    assert hours.count() == 24
    assert values(live.service_day_trim(hours), "hour") == [(7,)]


def test_percentiles_match_a_sorted_list(spark):
    rng = random.Random(7)
    values_ = [rng.uniform(0, 20) for _ in range(501)] + [3.25] * 400 + [25.0, -1.0]
    frame = spark.createDataFrame([(v,) for v in values_], "v double").repartition(5)
    got = one(linear_percentiles(frame, "v", {"a": 0.0, "b": 0.5, "c": 0.85, "d": 1.0}, 0.0, 20.0))
    ordered = sorted(values_)
    for name, p in {"a": 0.0, "b": 0.5, "c": 0.85, "d": 1.0}.items():
        k = (len(ordered) - 1) * p
        low = ordered[int(k)]
        high = ordered[min(int(k) + 1, len(ordered) - 1)]
        assert abs(got[name] - (low + (high - low) * (k - int(k)))) < 1e-9


def test_percentiles_of_nothing(spark):
    frame = spark.createDataFrame([], "v double")
    assert one(linear_percentiles(frame, "v", {"p50": 0.5}, 0.0, 20.0)) == {"p50": None}
