from conftest import CELL, HOUR, NOW, one, values
from pyspark.sql import functions as F

from fleetlens.operators import export, rollup


def test_grid_hour_rollup_counts_and_sums(data):
    grid = rollup.grid_hour_rollup(data.positions)
    total = one(grid.agg(*[F.sum(c).alias(c) for c in ("observations", "moving", "stopped", "speed_sum")]))
    assert total == {"observations": 8, "moving": 7, "stopped": 1, "speed_sum": 44.0}
    assert all(h % HOUR == 0 for (h,) in values(grid, "hour_bucket"))


def test_cells_are_floored(data):
    cells = rollup.grid_cells(rollup.grid_hour_rollup(data.positions), 0, min_observations=1)
    assert CELL in values(cells, "gy", "gx")


def test_route_hour_keeps_rows_without_position(data):
    total = one(rollup.route_hour_rollup(data.positions).agg(
        *[F.sum(c).alias(c) for c in ("observations", "moving", "stopped")]))
    assert total == {"observations": 9, "moving": 7, "stopped": 1}


def test_refold_replaces_whole_hours(data):
    full = rollup.grid_hour_rollup(data.positions)
    since = rollup.refold_since(NOW)
    assert since % HOUR == 0 and since <= NOW - HOUR
    again = rollup.rollup_refold(full, rollup.grid_hour_rollup, data.positions, since)
    columns = ["cell_y", "cell_x", "hour_bucket", "observations", "vehicles", "moving"]
    assert values(again, *columns) == values(full, *columns)
    gone = data.positions.filter(F.lit(False))
    assert rollup.rollup_refold(full, rollup.grid_hour_rollup, gone, 0).isEmpty()
    kept = rollup.rollup_refold(full, rollup.grid_hour_rollup, gone, since)
    assert values(kept, "hour_bucket") == [h for h in values(full, "hour_bucket") if h[0] < since]


def test_refold_start():
    assert rollup.refold_since(None) == 0
    assert rollup.refold_since(10_000) == 3600
    assert rollup.refold_since(10_000, full=True) == 0


def test_speed_histogram_bins(data, spark):
    counts = {r["bin"]: r["n"] for r in rollup.speed_histogram(data.positions, 0).collect()}
    assert counts == {0: 1, 1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0}
    fast = data.positions.withColumn("speed", F.lit(500.0)).limit(1)
    top = [r for r in rollup.speed_histogram(fast, 0).collect() if r["n"]]
    assert [(r["bin"], r["label"]) for r in top] == [(11, "79+")]


def test_corridor(data):
    cells = {(r["gy"], r["gx"]): r for r in rollup.route_corridor(data.positions, 0, "L10").collect()}
    probe, hub = cells.pop(CELL), next(iter(cells.values()))
    assert probe["observations"] == 2
    assert (hub["observations"], hub["speed_n"], hub["speed_sum"]) == (4, 4, 28.0)
    assert one(rollup.corridor_summary(rollup.route_corridor(data.positions, 0, "L10")))["cells"] == 2


def test_coarser_cells_keep_counts(data):
    grid = rollup.grid_hour_rollup(data.positions)
    for factor in (1, 2, 4):
        cells = rollup.grid_cells(grid, 0, factor=factor, min_observations=1)
        assert one(cells.agg(F.sum("observations").alias("n")))["n"] == 8


def test_export_scales(spark):
    rows = spark.createDataFrame([(float(i), i) for i in range(1, 11)], "speed_kmh double, obs bigint")
    scales = one(export.grid_scales(rows, 10))
    assert scales["truncated"] and scales["speed_p90"] == 10.0 and scales["speed_p10"] == 2.0
    empty = one(export.grid_scales(rows.filter("obs > 99"), 10))
    assert empty["count"] == 0 and empty["speed_p90"] is None


def test_vehicle_sets_merge_without_the_log(spark, data):
    key, counts = ["cell_y", "cell_x", "hour_bucket"], ["observations", "vehicles", "moving", "stopped", "speed_n", "speed_min", "speed_max"]
    old, late = (data.positions.filter(F.pmod("ts", F.lit(2)) == i) for i in (0, 1))
    none = spark.createDataFrame([], "vehicle_id string, number bigint")
    first = rollup.vehicle_numbers(none, old).cache()
    numbers = rollup.vehicle_numbers(first, data.positions).cache()
    assert sorted(r["number"] for r in numbers.collect()) == list(range(data.positions.select("vehicle_id").distinct().count()))
    assert set(map(tuple, first.collect())) <= set(map(tuple, numbers.collect()))
    sets = rollup.merge_sets(rollup.grid_hour_sets(old, numbers), rollup.grid_hour_sets(late, numbers))
    merged = rollup.merge_grid_hours(rollup.grid_hour_rollup(old), rollup.grid_hour_rollup(late), sets)
    assert values(merged, *key, *counts) == values(rollup.grid_hour_rollup(data.positions), *key, *counts)
    everywhere = rollup.set_counts(sets, factor=1 << 20).groupBy("hour_bucket").agg(F.sum("vehicles").alias("n"))
    located = data.positions.filter("lat IS NOT NULL AND lon IS NOT NULL")
    assert values(everywhere, "hour_bucket", "n") == values(
        located.groupBy((F.col("ts") - F.col("ts") % 3600).alias("hour_bucket")).agg(F.count_distinct("vehicle_id").alias("n")), "hour_bucket", "n")
    far = spark.createDataFrame([(f"v{i}", 40_000 * i) for i in range(3)], "vehicle_id string, number bigint")   # several bitmaps
    seen = spark.createDataFrame([(f"v{i % 3}", 7200 + i, 28.6, 77.2) for i in range(9)], "vehicle_id string, ts bigint, lat double, lon double")
    assert [r["vehicles"] for r in rollup.set_counts(rollup.grid_hour_sets(seen, far)).collect()] == [3]
