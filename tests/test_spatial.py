import math
import random

import pytest
from conftest import HUB, values
from pyspark.sql import functions as F

from fleetlens.operators import rollup, spatial


def planar(a, b):
    mid = math.radians((a[0] + b[0]) / 2)
    return math.hypot(math.radians(b[1] - a[1]) * 6371000 * math.cos(mid), math.radians(b[0] - a[0]) * 6371000)


def brute_bunched(rows):
    return sorted({(r, v) for r, v, lat, lon in rows for r2, v2, lat2, lon2 in rows
                   if r == r2 and v != v2 and planar((lat, lon), (lat2, lon2)) < 300})


def fleet(n, spread, seed, lat0=28.6, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scale = 0.002 if rng.random() < hot else spread
        rows.append((f"R{rng.randrange(3)}", f"V{i}", lat0 + rng.uniform(-scale, scale), 77.2 + rng.uniform(-scale, scale)))
    return rows


@pytest.mark.parametrize("n, spread, lat0, hot", [(300, 0.05, 28.6, 0.0), (300, 0.2, 28.6, 0.4), (200, 0.02, -1.0, 0.0), (200, 0.1, 68.0, 0.2)])
def test_bunching_equals_brute_force(spark, n, spread, lat0, hot):
    rows = fleet(n, spread, seed=n, lat0=lat0, hot=hot)
    frame = spark.createDataFrame(rows, "route_id string, vehicle_id string, lat double, lon double")
    # A tiny crowd limit sends every shared cell through the split path.
    for limit in (50_000, 2):
        assert values(spatial.bunched_vehicles(frame, hot_cell=limit), "route_id", "vehicle_id") == brute_bunched(rows)


def test_pair_two_cells_apart_in_longitude_is_found(spark):
    step = 299.0 / (111194.93 * math.cos(math.radians(28.6)))
    rows = [("R", "a", 28.6, 77.2), ("R", "b", 28.6, 77.2 + step), ("R", "c", 28.6, 77.3), ("Q", "d", 28.6, 77.2)]
    frame = spark.createDataFrame(rows, "route_id string, vehicle_id string, lat double, lon double")
    assert values(spatial.bunched_vehicles(frame), "vehicle_id") == [("a",), ("b",)]


def test_bunching_skips_missing_positions(spark, data):
    assert values(spatial.bunched_vehicles(data.latest), "route_id", "vehicle_id") == [("L10", "SIM-9"), ("L10", "TRAM-7")]


def test_nearest_stop(spark, data):
    points = spark.createDataFrame([(1, *HUB), (2, 0.0, 0.0), (3, None, None)], "point_id int, lat double, lon double")
    found = {r["point_id"]: r["stop_id"] for r in spatial.nearest_stop(points, data.stops).collect()}
    assert found == {1: "Q1", 2: None, 3: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_stop_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    snap = lambda x: round(x, 4 if seed == 1 else 3)   # coarse coordinates make ties and copies
    stops = [(f"S{i:03d}", f"n{i}", snap(28.6 + rng.uniform(-0.03, 0.03)), snap(77.2 + rng.uniform(-0.03, 0.03))) for i in range(250)]
    points = [(i, snap(28.6 + rng.uniform(-0.05, 0.05)), snap(77.2 + rng.uniform(-0.05, 0.05))) for i in range(300)]
    radius = 0.01
    def nearest(lat, lon):
        inside = [((a - lat) * (a - lat) + (o - lon) * (o - lon), s) for s, _, a, o in stops
                  if lat - radius <= a <= lat + radius and lon - radius <= o <= lon + radius]
        return min(inside)[1] if inside else None
    got = spatial.nearest_stop(spark.createDataFrame(points, "point_id int, lat double, lon double"),
                               spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat double, stop_lon double"), radius)
    assert values(got, "point_id", "stop_id") == [(i, nearest(lat, lon)) for i, lat, lon in points]
    few = spatial.label_few(spark.createDataFrame(points[:40], "point_id int, lat double, lon double"),
                            spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat double, stop_lon double"), radius)
    assert values(few, "point_id", "stop_id") == [(i, nearest(lat, lon)) for i, lat, lon in points[:40]]


def test_off_route_distance(spark, data):
    got = {r["vehicle_id"]: r["distance_m"] for r in spatial.off_route_distance(data.latest, data.trips, data.shapes).collect()}
    assert set(got) == {"TRAM-7", "X2", "SIM-9"} and max(got.values()) < 1e-6
    away = data.latest.withColumn("lat", F.col("lat") + 0.01).filter("vehicle_id = 'X2'")
    assert abs(spatial.off_route_distance(away, data.trips, data.shapes).first()["distance_m"] - 1113.2) < 0.01


def test_segments_survive_the_cut_into_ranges(spark):
    points = spark.createDataFrame([("R", i * 3, float(i), float(i)) for i in range(40)], "route_id string, shape_pt_sequence int, lat double, lon double")
    for chunk in (4, 64, 1000):
        segments = spatial.shape_segments(points, chunk).select(F.explode("segments").alias("s")).select("s.*")
        assert values(segments, "lat_a", "lat_b") == [(float(i), float(i + 1)) for i in range(39)]


def test_hotspot_labels(data):
    cells = rollup.grid_cells(rollup.grid_hour_rollup(data.positions), 0, min_observations=1)
    rows = spatial.hotspots(cells, data.stops, limit=1).collect()
    busiest = next(r for r in rows if r["ranking"] == "busiest")
    assert busiest["observations"] == 6 and busiest["stop_id"] == "Q1"
    assert {r["rank"] for r in rows} == {1}


@pytest.mark.parametrize("seed, spread", [(1, 0.1), (2, 0.002)])
def test_off_route_equals_brute_force_on_crossing_lines(spark, seed, spread):
    rng = random.Random(seed)
    lines = {"A": [(28.6 + rng.uniform(-0.1, 0.1), 77.2 + rng.uniform(-0.1, 0.1)) for _ in range(400)],     # long segments, all over
             "B": [(28.6 + i * 1e-4 + rng.uniform(-1e-5, 1e-5), 77.2 + 0.02 * math.sin(i / 30)) for i in range(500)]}
    fleet = [(f"V{i}", rng.choice("AB"), 28.6 + rng.uniform(-spread, spread), 77.2 + rng.uniform(-spread, spread)) for i in range(200)]
    fleet += [("far", "A", 0.0, 0.0), ("far2", "B", 0.0, 0.0), ("twin", *fleet[0][1:]), ("none", "C", 28.6, 77.2)]

    def metres(lat, lon, a, b):
        scale = 111_320.0 * max(math.cos(math.radians(lat)), 1e-9)
        (ax, ay), (bx, by) = (((o - lon) * scale, (n - lat) * 111_320.0) for n, o in (a, b))
        dx, dy = bx - ax, by - ay
        t = 0.0 if dx * dx + dy * dy <= 1e-9 else max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.hypot(ax + t * dx, ay + t * dy)

    vehicles = spark.createDataFrame(fleet, "vehicle_id string, route_id string, lat double, lon double")
    trips = spark.createDataFrame([(r, f"S{r}") for r in "AB"], "route_id string, shape_id string")
    shapes = spark.createDataFrame([(f"S{r}", i, *p) for r, line in lines.items() for i, p in enumerate(line)],
                                   "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    got = {r["vehicle_id"]: r["distance_m"] for r in spatial.off_route_distance(vehicles, trips, shapes).collect()}
    want = {v: min(metres(lat, lon, a, b) for a, b in zip(lines[r], lines[r][1:])) for v, r, lat, lon in fleet if r in lines}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)
