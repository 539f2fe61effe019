"""Thresholds and grid steps. Results depend on every one of them."""

import math

# Grid: 250 m cells, longitude step widened at the anchor latitude.
GRID_M = 250.0
GRID_ANCHOR_LAT = 28.6
METRES_PER_DEGREE = 111_320.0
GRID_LAT_DEG = GRID_M / METRES_PER_DEGREE
GRID_LON_DEG = GRID_M / (METRES_PER_DEGREE * math.cos(math.radians(GRID_ANCHOR_LAT)))
EARTH_RADIUS_M = 6_371_000.0

# Speeds in metres per second unless the name says otherwise.
MOVING_MPS = 0.5
IMPLAUSIBLE_MPS = 20.0
MPS_TO_KMH = 3.6
SLOW_KMH = 10.0

# Ages and gaps in seconds.
HOUR_S = 3600
DAY_S = 86_400
FRESH_S = 60
STALE_S = 300
FRESH_THRESHOLDS_S = (30, 60, 120, 300)
GAP_THRESHOLD_S = 90
GAP_BUCKETS = (
    ("b_0_60", 0, 60),
    ("b_60_180", 60, 180),
    ("b_180_300", 180, 300),
    ("b_300_600", 300, 600),
    ("b_600_plus", 600, None),
)
REPORT_INTERVAL_S = 30
ROLLUP_REWIND_S = 3600
CONTINUITY_CHUNK_S = 86_400
MATCH_REWIND_S = 600
MATCH_CHUNK_S = 86_400
RETENTION_S = 12 * 3600
DELAY_FEED_RETENTION_S = 72 * 3600
DELAY_FEED_CLOCK_OFFSET_S = 19_800
DELAY_FEED_ZONE = "Asia/Kolkata"

# Distances in metres.
BUNCH_M = 300.0
OFF_ROUTE_M = 50.0

# Observation minimums and ranking rules.
MIN_OBS_DEFAULT = 8
MIN_OBS_HOTSPOT = 40
MAX_DWELL_FOR_CONGESTION_PCT = 35.0
CONGESTED_KMH = 15.0
HOTSPOT_LABEL_RADIUS_DEG = 0.01

MATCH_TOLERANCE_MIN = 15
IMPLAUSIBLE_DELAY_S = 7200
MAX_CHANGES = 32_767
SIMULATED_PREFIX = "SIM-"

POPULATION_FIELDS = (
    "stop_id", "occupancy_status", "congestion_level", "current_status",
    "bearing", "speed", "trip_id", "route_id", "lat",
)

# A restarted job takes up the stored rows of so many seconds, and holds a vehicle's newest row as long.
LATEST_RESTORE_S = 900
