import math
import os
import sys
from types import SimpleNamespace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens import schemas  # noqa: E402
from fleetlens.constants import GRID_LAT_DEG, GRID_LON_DEG  # noqa: E402
from fleetlens.session import local_session  # noqa: E402

NOW = 1_718_454_321  # 1521 seconds into an hour
HOUR = 3600
HUB = (23_320.5 * GRID_LAT_DEG, 1_911.4 * GRID_LON_DEG)  # near the middle of its cell
COSLAT = math.cos(math.radians(HUB[0]))
CELL = (23_309, 1_904)
PROBE = ((CELL[0] + 0.35) * GRID_LAT_DEG, (CELL[1] + 0.6) * GRID_LON_DEG)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


def _reports():
    """(vehicle, seconds before NOW, trip, route, place, speed): a tram that changes its trip, an express
    that comes to a halt, a ferry that lost its position, and a simulated vehicle."""
    return [("TRAM-7", 5 * HOUR, "A1", "L10", PROBE, 4.0), ("TRAM-7", 4 * HOUR, "A1", "L10", PROBE, 9.5),
            ("TRAM-7", 5400, "A1", "L10", HUB, 6.5), ("TRAM-7", 45, "A1", "L10", HUB, 8.0), ("TRAM-7", 20, "A2", "L10", HUB, 3.5),
            ("X2", 4 * HOUR, "B1", "L20", HUB, 2.5), ("X2", 200, "B1", "L20", HUB, 0.2),
            ("F1", 30_000, None, "F5", (None, None), None), ("SIM-9", 70, None, "L10", HUB, 10.0)]


_CALLS = {"A1": [("Q1", "06:15:20", 22_520), ("Q2", "06:22:00", 22_920), ("Q3", "06:31:40", 23_500), ("Q6", "06:45:00", 24_300)],
          "A2": [("Q1", "07:05:00", 25_500), ("Q2", "07:12:00", 25_920)], "A3": [("Q1", "09:40:10", 34_810)],
          "B1": [("Q3", "11:00:00", 39_600), ("Q4", "11:45:30", 42_330)],
          "Z1": [("Q4", "26:10:05", 94_205)], "Z2": [("Q4", "24:59:59", 89_999)]}
_OFFSETS = {"Q1": (0, 0), "Q2": (0.0015, 0), "Q3": (0, 0.002), "Q4": (0.05, 0.05), "Q6": (-0.004, -0.003)}
_NAMES = {"Q1": "Old Quay", "Q2": "Mill Bridge", "Q3": "Fish Market", "Q4": "Airport Gate", "Q6": "Dry Dock"}


@pytest.fixture(scope="session")
def data(spark):
    """A harbour town with a tram, an express, a ferry and a night line, small enough to check by hand."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1).cache()
    positions = make([(v, NOW - ago, trip, route, *place, None if speed is None else 45.0, speed, None, None, None, None, NOW)
                      for v, ago, trip, route, place, speed in _reports()], schemas.POSITIONS)
    from pyspark.sql import functions as F
    arrived = positions.withColumn("arrival", F.monotonically_increasing_id()).cache()
    from fleetlens.operators.merge import latest_projection
    lat, lon = HUB
    stops = [(s, "P" + s, _NAMES[s], lat + y, lon + x) for s, (y, x) in _OFFSETS.items()] + [("Q5", "PQ5", "Lighthouse", *PROBE)]
    return SimpleNamespace(
        positions=arrived, latest=latest_projection(arrived).cache(),
        agency=make([("M1", "Metro Tram", "u", "Europe/Amsterdam", "nl"), ("M2", "Harbour Ferry", "u", "Europe/Amsterdam", "nl")], schemas.AGENCY),
        routes=make([("L10", "M1", "10", None, "Quay Loop", 0), ("L20", "M1", "20X", None, "Hill Express", 3),
                     ("F5", "M2", "F5", None, "North Ferry", 4), ("N90", "M2", "N90", None, "Night Line", 3)], schemas.ROUTES),
        stops=make(stops, schemas.STOPS),
        trips=make([("A1", "L10", "WK", None, 0, "SHX"), ("A2", "L10", "WK", None, 1, "SHX"), ("A3", "L10", "WK", None, 0, "SHY"),
                    ("B1", "L20", "WK", None, 0, "SHY"), ("C1", "F5", "WK", None, 0, None), ("Z1", "N90", "WK", None, 0, None),
                    ("Z2", "N90", "WK", None, 1, None)], schemas.TRIPS),
        stop_times=make([(trip, stop, i + 1, clock, clock, at, at) for trip, calls in _CALLS.items()
                         for i, (stop, clock, at) in enumerate(calls)], schemas.STOP_TIMES),
        shapes=make([("SHX", i, lat + i * 0.0008, lon + i * 0.0012, None) for i in range(6)]
                    + [("SHY", i, lat - i * 0.0015, lon, None) for i in range(4)], schemas.SHAPES),
        polls=make([(NOW - ago, 1, "feed", 200, n, n - 20, NOW - ago - 7, ms, None)
                    for ago, n, ms in ((460, 806, 250), (400, 814, 350), (340, 806, 300), (280, 814, 300))]
                   + [(NOW - 220, 0, "feed", 502, 0, 0, None, 9000, "HTTP 502")], schemas.POLLS),
    )


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
