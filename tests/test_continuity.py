import random

import pytest
from conftest import NOW, one, values
from pyspark.sql import functions as F

from fleetlens.operators import continuity

COLUMNS = ["hour_bucket", *continuity.COUNTERS]


def test_report_on_known_log(data):
    hours = continuity.gap_hour_counters(data.positions, 0, NOW)
    report = one(continuity.continuity_report(data.positions, hours, NOW - 50_000, NOW))
    assert (report["vehicles"], report["observations"]) == (4, 9)
    assert (report["gaps_total"], report["gaps_over_threshold"], report["b_600_plus"]) == (5, 4, 4)
    assert report["avg_span_s"] == (17_980 + 14_200) / 4 and abs(report["avg_observations_per_vehicle"] - 2.25) < 0.06


def test_threshold_is_applied_when_folding(data):
    hours = continuity.gap_hour_counters(data.positions, 0, NOW, threshold=999_999)
    assert one(hours.agg(F.sum("gaps_total").alias("n"), F.sum("gaps_over_threshold").alias("o"))) == {"n": 5, "o": 0}


@pytest.mark.parametrize("threshold, complete", [(90, 1), (999_999, 3)])
def test_trip_completeness(data, threshold, complete):
    state = continuity.trip_gap_state(data.positions, 0, NOW, threshold)
    done = one(continuity.trip_completeness(state, 0, NOW))
    assert (done["trips"], done["complete_trips"]) == (3, complete)


def make_log(spark, seed=3):
    """Random reports; one vehicle holds a third of all rows and stays silent over whole hours."""
    rng, rows = random.Random(seed), set()
    while len(rows) < 900:
        vehicle = "V0" if rng.random() < 0.34 else f"V{rng.randrange(1, 12)}"
        ts = NOW - NOW % 3600 + rng.choice([0, 1, 2, 7, 8]) * 3600 + rng.randrange(3600)
        rows.add((vehicle, ts))
    full = [(v, rng.choice([None, "A", "B"]), ts) for v, ts in sorted(rows)]
    return full, spark.createDataFrame(full, "vehicle_id string, trip_id string, ts bigint")


def expected_gaps(rows, key):
    last, out = {}, []
    for row in sorted(rows, key=lambda r: r[2]):
        k = key(row)
        if k is None:
            continue
        if k in last:
            out.append((k, row[2], last[k]))
        last[k] = row[2]
    return out


def test_gaps_equal_a_plain_walk(spark):
    rows, log = make_log(spark)
    got = values(continuity.report_gaps(log, 0, 2 * NOW), "vehicle_id", "ts", "prev_ts")
    assert got == sorted(expected_gaps(rows, lambda r: r[0]))
    by_trip = values(continuity.report_gaps(log, 0, 2 * NOW, by_trip=True), "vehicle_id", "trip_id", "ts", "prev_ts")
    assert by_trip == sorted((*k, ts, prev) for k, ts, prev in expected_gaps(rows, lambda r: (r[0], r[1]) if r[1] else None))
    counted = one(continuity.gap_hour_counters(log, 0, 2 * NOW).agg(*[F.sum(c).alias(c) for c in continuity.COUNTERS]))
    gaps = [ts - prev for _, ts, prev in expected_gaps(rows, lambda r: r[0])]
    assert counted["gaps_total"] == len(gaps) == sum(counted[c] for c in continuity.COUNTERS[2:])
    assert counted["gaps_over_threshold"] == sum(g > 90 for g in gaps)


@pytest.mark.parametrize("cuts", [[NOW + 1800], [NOW - 100, NOW + 5000, NOW + 20_000]])
def test_any_split_into_batches_gives_the_same_state(spark, cuts):
    _, log = make_log(spark, seed=5)
    counters, vehicles, trips = None, None, None
    for low, high in zip([0, *cuts], [*cuts, 2 * NOW]):
        fresh = continuity.gap_hour_counters(log, low, high, state=vehicles)
        counters = fresh if counters is None else continuity.add_counters(counters, fresh)
        vehicles = continuity.vehicle_gap_state(log, low, high, vehicles)
        trips = continuity.trip_gap_state(log, low, high, stored=trips)
    assert values(counters, *COLUMNS) == values(continuity.gap_hour_counters(log, 0, 2 * NOW), *COLUMNS)
    whole = continuity.trip_gap_state(log, 0, 2 * NOW)
    assert values(trips, "vehicle_id", "trip_id", "last_ts", "has_gap") == values(whole, "vehicle_id", "trip_id", "last_ts", "has_gap")


def test_continuity_pct(spark):
    schema = "avg_span_s double, avg_observations_per_vehicle double, gaps_over_threshold bigint, gaps_total bigint, vehicles bigint"
    rows = [(300.0, 11.0, 1, 4, 1), (300.0, 5.5, 0, 0, 1), (0.0, 1.0, 0, 0, 1), (30.0, 9.0, 0, 1, 1)]
    got = [(r["report_continuity_pct"], r["pct_of_gaps"]) for r in continuity.with_report_pct(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(100.0, 25.0), (50.0, None), (None, None), (100.0, 0.0)]
