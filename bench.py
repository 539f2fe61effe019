"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, ``all`` for every registered query), BENCH_REPEAT (default 2; the best run counts).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fleetlens.operators import rollup  # noqa: E402
from fleetlens.plans.catalog import QUERIES  # noqa: E402
from fleetlens.plans.driver_tables import DriverTables  # noqa: E402
from fleetlens.session import local_session, shared_dir  # noqa: E402

HEADLINE = [
    "grid_hour_rollup", "route_hour_rollup", "grid_cells", "hourly_series", "latest_in_window", "fleet_states",
    "route_live_stats", "speed_percentiles", "bunched_vehicles", "gap_hour_counters", "trip_gap_state",
    "continuity_report", "trip_nearest_match", "hotspots", "route_corridor", "nearest_stop", "off_route_distance",
    "routes_nearby", "route_stops", "referential_integrity", "quality_summary", "dedupe_append",
    "latest_wins_merge", "stop_delay_merge", "upsert_and_prune", "position_feed_flatten", "trip_update_flatten", "static_load",
]


FOLD_ROWS = 420_000  # rows of the log that the fold rate is measured on, at least


def timed(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def fold_rate(spark, sf_dir: str, repeat: int) -> tuple[int, float]:
    """Rows and seconds of both hourly rollups over a stored log: the events, repeated under other vehicle names."""
    positions = DriverTables(spark, sf_dir).positions
    copies = -(-FOLD_ROWS // max(1, positions.count()))
    numbered = positions.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    path = shared_dir(spark, "bench-log")
    numbered.withColumn("vehicle_id", F.concat_ws("-", "vehicle_id", "copy")).drop("copy").repartition(8).write.parquet(path)
    log = spark.read.parquet(path)
    folds = [lambda *_, fold=fold: fold(log) for fold in (rollup.grid_hour_rollup, rollup.route_hour_rollup)]
    best = min(sum(timed(fold, spark, sf_dir) for fold in folds) for _ in range(repeat + 1))
    return log.count(), best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    timed(QUERIES["log_extent"], spark, sf_dir)  # starts the executor threads
    seconds = {name: round(min(timed(QUERIES[name], spark, sf_dir) for _ in range(repeat)), 3) for name in names}
    rows, fold = fold_rate(spark, sf_dir, repeat)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rollup_fold_rows": rows,
        "rollup_fold_rows_per_sec": round(rows / fold)}))
    spark.stop()


if __name__ == "__main__":
    main()
