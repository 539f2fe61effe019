import random

import pytest
from conftest import NOW, one, values

from fleetlens.functions import parse
from fleetlens.operators import keyed, matching

SCHEDULED = "route_id string, trip_id string"
LIVE = "route_id string, trip_id string, vehicle_id string"


@pytest.mark.parametrize("planned, live, expected", [
    (["K_13_37"], ("K", "K_13_37_0"), ("K_13_37", "strict", 0.0)),
    (["K_13_37", "K_13_41"], ("K", "K_13_40_x"), ("K_13_41", "relaxed", 1.0)),
    (["K_13_30", "K_13_44"], ("K", "K_13_37_x"), ("K_13_30", "relaxed", 7.0)),   # equally far: the earlier one
    (["K_05_00"], ("K", "K_05_15_x"), ("K_05_00", "relaxed", 15.0)),              # the tolerance is closed
    (["K_05_00"], ("K", "K_05_16_x"), (None, "none", 16.0)),
    (["K_47_59", "K_48_00"], ("K", "K_47_58_x"), ("K_47_59", "relaxed", 1.0)),    # no 48th hour
    (["K_05_00"], ("other", "K_05_00_x"), (None, "none", None)),
    (["K_05_00", "K5"], ("K", "K_5h_00_x"), (None, "none", None)),
])
def test_match(spark, planned, live, expected):
    scheduled = spark.createDataFrame([("K", t) for t in planned], SCHEDULED)
    row = one(matching.trip_nearest_match(spark.createDataFrame([(*live, "V")], LIVE), scheduled, NOW))
    assert (row["matched_trip_id"], row["match_type"], row["delta_minutes"]) == expected


def test_match_equals_exhaustive_search(spark):
    rng = random.Random(11)
    pick = lambda n: [(f"R{rng.randrange(3)}", f"x_{rng.randrange(50):02d}_{rng.randrange(62):02d}_{i}") for i in range(n)]
    planned, live = pick(200), pick(150)
    minute = lambda t: (lambda h, m: h * 60 + m if h <= 47 and m <= 59 else None)(int(t.split("_")[1]), int(t.split("_")[2]))
    def search(route, trip):
        m = minute(trip)
        best = None
        for r, p in planned:
            c = minute(p)
            if r != route or c is None or m is None:
                continue
            rank = (abs(c - m), c, p if c >= m else "", [-ord(x) for x in p])
            if best is None or rank < best[0]:
                best = (rank, p, float(abs(c - m)))
        if best is None:
            return None, "none", None
        kind = "strict" if best[2] == 0 else "relaxed" if best[2] <= 15 else "none"
        return (best[1] if kind != "none" else None), kind, best[2]
    got = matching.trip_nearest_match(spark.createDataFrame([(*k, "V") for k in live], LIVE), spark.createDataFrame(planned, SCHEDULED), NOW)
    found = {(r["route_id"], r["live_trip_id"]): (r["matched_trip_id"], r["match_type"], r["delta_minutes"]) for r in got.collect()}
    assert found == {k: search(*k) for k in live}


def test_dispatch_minutes(spark):
    ids = {"1706_15_23_4361": 923, "x_29_25_05": 29 * 60 + 25, "x_99_00": None, "x_10_75": None, "x_a_b": None, "x_1": None, "": None}
    got = parse.with_dispatch_minute(spark.createDataFrame([(t,) for t in ids], "trip_id string"))
    assert {r["trip_id"]: r["minute"] for r in got.collect()} == ids


def test_live_keys_are_half_open(data):
    keys = keyed.live_trip_keys(data.positions, NOW - 7200, NOW - 60)
    assert values(keys, "route_id", "trip_id", "vehicle_id") == [("L10", "A1", "TRAM-7"), ("L20", "B1", "X2")]
    assert values(keyed.live_trip_keys(data.positions, NOW - 20, NOW), "trip_id") == [("A2",)]


def test_summary(spark):
    rows = [("a", "strict"), ("b", "strict"), ("c", "relaxed"), ("d", "none")]
    matches = spark.createDataFrame([(t, k, NOW) for t, k in rows], "live_trip_id string, match_type string, matched_at bigint")
    s = one(matching.trip_match_summary(matches, NOW))
    assert (s["total"], s["strict_pct"], s["linked_pct"]) == (4, 50.0, 75.0)
    assert one(matching.trip_match_summary(matches, NOW + 1))["strict_pct"] is None
