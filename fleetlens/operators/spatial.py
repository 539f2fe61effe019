"""Nearest stop, bunching, distance from the route, hotspots.

Spatial joins meet through grid cells. Cells that could hold a large share of all rows are never
paired row by row: either the cell itself settles the answer, or only a bounded number of rows
per cell goes on to the exact test.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BUNCH_M, CONGESTED_KMH, EARTH_RADIUS_M, HOTSPOT_LABEL_RADIUS_DEG,
                         MAX_DWELL_FOR_CONGESTION_PCT, METRES_PER_DEGREE, OFF_ROUTE_M)
from ..functions import geo
from ..functions.measures import count_if, safe_pct
from ..session import shared_dir
from .keyed import first_per_key, lookup_join
from .rollup import cell_centers, with_speed_and_dwell
from .schedule import route_shape

# Cells and prefilters are a hair wider than the radius: rounding must not lose a point on the edge,
# which the exact test of the rows still decides.
_WIDER = 1 + 1e-6
_METRES_PER_RADIAN_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0


# ---- nearest stop ---------------------------------------------------------
def _square(value):
    return value * value


def _axis_gap(low_a, high_a, low_b, high_b):
    """Smallest distance between two intervals, 0 when they touch."""
    return F.greatest(low_b - high_a, low_a - high_b, F.lit(0.0))


def _axis_reach(low_a, high_a, low_b, high_b):
    """Largest distance between points of two intervals."""
    return F.greatest(high_b - low_a, high_a - low_b)


def _boxes(df: DataFrame, lat: str, lon: str, step: float, prefix: str) -> DataFrame:
    cell = [F.floor(F.col(lat) / step).alias(f"{prefix}_y"), F.floor(F.col(lon) / step).alias(f"{prefix}_x")]
    return df.groupBy(*cell).agg(
        F.min(lat).alias(f"{prefix}_lat0"), F.max(lat).alias(f"{prefix}_lat1"),
        F.min(lon).alias(f"{prefix}_lon0"), F.max(lon).alias(f"{prefix}_lon1"))


def nearest_stop(points: DataFrame, stops: DataFrame, radius_deg: float = HOTSPOT_LABEL_RADIUS_DEG,
                 split: int = 16) -> DataFrame:
    """For each point (point_id, lat, lon) the stop with the smallest squared-degree distance
    inside a box of +-radius; points without one stay, with a NULL stop.

    Both sides are summarised into fine cells with tight boxes. For every occupied point cell only
    those stop cells are kept that can hold the nearest stop of one of its points: nearer at their
    best than some other cell at its worst. At most (3 * split)^2 stop cells face one point cell,
    whatever the number of rows in them, and only the kept ones reach the row-level comparison.
    """
    step = radius_deg * _WIDER / split
    # Stops at one coordinate cannot be told apart by distance: the smallest id stands for them.
    unique = first_per_key(stops.filter(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull()).select(
        "stop_id", "stop_name", "stop_lat", "stop_lon"), ["stop_lat", "stop_lon"], "stop_id")
    located = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    point_cells = _boxes(located, "lat", "lon", step, "p")
    stop_cells = _boxes(unique, "stop_lat", "stop_lon", step, "s")

    around = F.sequence(F.lit(-1), F.lit(1))
    block = lambda name: F.floor(F.col(name) / split)
    asking = (point_cells.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
              .withColumn("block_y", block("p_y") + F.col("_dy"))
              .withColumn("block_x", block("p_x") + F.col("_dx")).drop("_dy", "_dx"))
    answering = stop_cells.withColumn("block_y", block("s_y")).withColumn("block_x", block("s_x"))
    sides = {axis: [F.col(f"{p}_{axis}{i}") for p in "ps" for i in (0, 1)] for axis in ("lat", "lon")}
    gap = {axis: _axis_gap(*bounds) for axis, bounds in sides.items()}
    reach = {axis: _axis_reach(*bounds) for axis, bounds in sides.items()}
    surely_inside = (reach["lat"] <= radius_deg / _WIDER) & (reach["lon"] <= radius_deg / _WIDER)
    candidates = asking.join(answering, ["block_y", "block_x"]).filter(
        (gap["lat"] <= radius_deg * _WIDER) & (gap["lon"] <= radius_deg * _WIDER)
    ).withColumn("best", _square(gap["lat"]) + _square(gap["lon"])).withColumn(
        "worst", F.when(surely_inside, _square(reach["lat"]) + _square(reach["lon"])))
    # The window holds one row per stop cell in reach, never the stops themselves.
    bound = F.min("worst").over(Window.partitionBy("p_y", "p_x"))
    kept = candidates.withColumn("bound", bound).filter(
        F.col("bound").isNull() | (F.col("best") <= F.col("bound") * (1 + 1e-9) + 1e-18)
    ).select("p_y", "p_x", "s_y", "s_x")

    cell = lambda name: F.floor(F.col(name) / step)
    stops_by_cell = unique.withColumn("s_y", cell("stop_lat")).withColumn("s_x", cell("stop_lon"))
    offered = kept.join(stops_by_cell, ["s_y", "s_x"]).drop("s_y", "s_x")
    compared = lookup_join(
        located.select("point_id", "lat", "lon", cell("lat").alias("p_y"), cell("lon").alias("p_x")),
        offered, ["p_y", "p_x"], "inner")
    # The box is closed and its edges are lat +- radius, as a range predicate would compute them.
    inside = (F.col("stop_lat").between(F.col("lat") - radius_deg, F.col("lat") + radius_deg)
              & F.col("stop_lon").between(F.col("lon") - radius_deg, F.col("lon") + radius_deg))
    d2 = _square(F.col("stop_lat") - F.col("lat")) + _square(F.col("stop_lon") - F.col("lon"))
    best = compared.filter(inside).groupBy("point_id").agg(
        F.min(F.struct(d2.alias("d2"), "stop_id", "stop_name")).alias("hit"))
    return points.join(best, "point_id", "left").select(
        *points.columns, F.col("hit.stop_id").alias("stop_id"), F.col("hit.stop_name").alias("stop_name"),
        F.col("hit.d2").alias("d2"))


# ---- bunching -------------------------------------------------------------
def bunched_vehicles(vehicles: DataFrame, distance_m: float = BUNCH_M, hot_cell: int = 50_000) -> DataFrame:
    """(route_id, vehicle_id) of vehicles with another one of their route nearer than the distance.

    The cell diagonal is shorter than the distance, so every vehicle of a cell with two or more is
    bunched without comparing anybody. Only a vehicle alone in its cell (one per route and cell)
    is compared with the vehicles of the cells around it, and a crowded neighbour cell is dealt
    over several tasks.
    """
    per_degree = _METRES_PER_RADIAN_DEGREE
    step = distance_m / per_degree / 1.4143
    placed = vehicles.filter(
        F.col("route_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).select("route_id", "vehicle_id", "lat", "lon",
             F.floor(F.col("lat") / step).alias("cy"), F.floor(F.col("lon") / step).alias("cx"))
    cell = ["route_id", "cy", "cx"]
    crowd = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.min("vehicle_id").alias("lone_id"),
                                      F.min("lat").alias("lone_lat"), F.min("lon").alias("lone_lon"))

    shared = lookup_join(placed, crowd.filter(F.col("n") > 1).select(*cell), cell, "left_semi")
    settled = shared.select("route_id", "vehicle_id")

    alone = crowd.filter(F.col("n") == 1).drop("n")
    # Rows and columns that can hold a vehicle within the distance; a degree of longitude shrinks
    # with the latitude, taken at its narrowest within reach of the lone vehicle.
    rows = int(distance_m / per_degree / step) + 1
    narrow = F.greatest(F.cos(F.radians(F.abs("lone_lat") + distance_m / per_degree)), F.lit(0.01))
    columns = (F.floor(F.lit(distance_m / per_degree / step) / narrow) + 1).cast("bigint")
    reach = (alone.withColumn("_columns", columns)
             .withColumn("_dy", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
             .withColumn("_dx", F.explode(F.sequence(-F.col("_columns"), F.col("_columns"))))
             .filter((F.col("_dy") != 0) | (F.col("_dx") != 0))
             .withColumn("cy", F.col("cy") + F.col("_dy")).withColumn("cx", F.col("cx") + F.col("_dx"))
             .drop("_dy", "_dx", "_columns"))
    parts = F.ceil(F.col("n") / hot_cell).cast("int")
    sized = crowd.select(*cell, parts.alias("parts"))
    asked = reach.join(sized, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = sized.filter(F.col("parts") > 1)
    dealt = lookup_join(placed, hot, cell, "left").withColumn(
        "part", F.pmod(F.xxhash64("vehicle_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    near = geo.planar_distance_m("lone_lat", "lone_lon", "lat", "lon") < distance_m
    pairs = asked.drop("parts").join(dealt, cell + ["part"]).filter(near)
    met = pairs.select("route_id", F.explode(F.array("lone_id", "vehicle_id")).alias("vehicle_id"))
    return settled.unionByName(met).distinct()


def bunched_per_route(bunched: DataFrame) -> DataFrame:
    return bunched.groupBy("route_id").agg(F.count("*").alias("bunched"))


# ---- off route ------------------------------------------------------------
def busiest_k_routes(vehicles: DataFrame, k: int) -> DataFrame:
    return (vehicles.filter(F.col("route_id").isNotNull()).groupBy("route_id")
            .agg(F.count("*").alias("vehicles")).orderBy(F.desc("vehicles"), "route_id").limit(k))


def shape_segments(points: DataFrame, chunk: int = 64) -> DataFrame:
    """Route points -> rows of up to ``chunk`` consecutive segments.

    Points are cut into ranges of the sequence number first, so no task orders a whole shape; the
    segment that leads into a range starts at the last point of the range before it.
    """
    ranged = points.withColumn("part", F.floor(F.col("shape_pt_sequence") / chunk))
    within = Window.partitionBy("route_id", "part").orderBy("shape_pt_sequence")
    inner = ranged.withColumn("next", F.lead(F.struct("lat", "lon")).over(within)).filter(
        F.col("next").isNotNull()).select("route_id", "part", "lat", "lon", "next")
    ends = ranged.groupBy("route_id", "part").agg(
        F.min_by(F.struct("lat", "lon"), "shape_pt_sequence").alias("head"),
        F.max_by(F.struct("lat", "lon"), "shape_pt_sequence").alias("tail"))
    across = Window.partitionBy("route_id").orderBy("part")
    joints = ends.withColumn("next", F.lead("head").over(across)).filter(F.col("next").isNotNull()).select(
        "route_id", "part", F.col("tail.lat").alias("lat"), F.col("tail.lon").alias("lon"), "next")
    segment = F.struct(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
                       F.col("next.lat").alias("lat_b"), F.col("next.lon").alias("lon_b"))
    return inner.unionByName(joints).groupBy("route_id", "part").agg(F.collect_list(segment).alias("segments"))


# Lines are indexed by cells. A segment is cut into pieces of a share of its route's mean length, which bounds their number by
# that of the segments; the cells of each level are _FANOUT times as wide as those below.
_PIECES = 8
_FANOUT = 8
_LEVELS = 3
_BOX = ("lat0", "lat1", "lon0", "lon1")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the shared folder, because what follows reads it several times."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _line_pieces(segments: DataFrame) -> DataFrame:
    """(route, cell, segment, box of the piece), a row per piece of every different segment; the cell is that of its middle."""
    ends = ["lat_a", "lon_a", "lat_b", "lon_b"]
    alike = segments.select("route_id", F.inline("segments")).dropna(subset=ends).distinct()
    alike = _stored(alike, "line-segments")
    span = F.hypot(F.col("lat_b") - F.col("lat_a"), F.col("lon_b") - F.col("lon_a"))
    step = alike.groupBy("route_id").agg((F.avg(span) / _PIECES).alias("mean"))
    stepped = lookup_join(alike, step, "route_id", "inner").withColumn("step", F.greatest("mean", F.lit(1e-6)))
    number = F.greatest(F.ceil(span / F.col("step")), F.lit(1)).cast("int")
    cut = stepped.withColumn("n", number).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda axis, i: F.col(f"{axis}_a") + (F.col(f"{axis}_b") - F.col(f"{axis}_a")) * (i / F.col("n"))
    cell = lambda axis: F.floor(at(axis, F.col("i") + 0.5) / F.col("step"))
    # Boxes are a hair wider than the piece, against rounding.
    low = lambda axis: F.least(at(axis, F.col("i")), at(axis, F.col("i") + 1)) - 1e-12
    high = lambda axis: F.greatest(at(axis, F.col("i")), at(axis, F.col("i") + 1)) + 1e-12
    return cut.select("route_id", cell("lat").alias("y0"), cell("lon").alias("x0"), *ends, low("lat").alias("lat0"),
                      high("lat").alias("lat1"), low("lon").alias("lon0"), high("lon").alias("lon1"))


def _cell_boxes(pieces: DataFrame) -> list[DataFrame]:
    """The boxes of the cells that hold a piece, and those of the wider cells around them, finest first."""
    union = [pick(c).alias(c) for c, pick in zip(_BOX, (F.min, F.max, F.min, F.max))]
    levels = [_stored(pieces.groupBy("route_id", "y0", "x0").agg(*union), "line-cells")]
    for i in range(1, _LEVELS):
        up = lambda axis: F.floor(F.col(f"{axis}{i - 1}") / _FANOUT).alias(f"{axis}{i}")
        levels[-1] = levels[-1].select("*", up("y"), up("x"))
        levels.append(levels[-1].groupBy("route_id", f"y{i}", f"x{i}").agg(*union))
    return levels


def off_route_distance(vehicles: DataFrame, trips: DataFrame, shapes: DataFrame,
                       k: int | None = None) -> DataFrame:
    """Metres from each positioned vehicle to its route's line, for all routes or the k busiest.

    Every different spot of a route descends levels of cells with their boxes. A box farther away than some box's far
    corner can't hold what is nearest. The segments of the nearest cell then give a distance, and only cells with a
    nearer box are looked into after it.
    """
    placed = vehicles.filter(F.col("route_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    line = route_shape(trips, shapes)
    if k is not None:
        line = line.join(busiest_k_routes(placed, k).select("route_id"), "route_id", "left_semi")
    pieces = _stored(_line_pieces(shape_segments(line)), "line-pieces")
    spot = ["route_id", "lat", "lon"]
    # A degree of longitude as the distance sees it: seen from the vehicle, at its own latitude.
    shrink = F.cos(F.radians("lat"))
    gap = (_axis_gap(F.col("lat"), F.col("lat"), F.col("lat0"), F.col("lat1")),
           _axis_gap(F.col("lon"), F.col("lon"), F.col("lon0"), F.col("lon1")) * shrink)
    reach = (_axis_reach(F.col("lat"), F.col("lat"), F.col("lat0"), F.col("lat1")),
             _axis_reach(F.col("lon"), F.col("lon"), F.col("lon0"), F.col("lon1")) * shrink)
    best, worst = (_square(a) + _square(b) for a, b in (gap, reach))
    wider = lambda bound: bound * (1 + 1e-6) + 1e-15
    found, on = placed.select(*spot).distinct(), ["route_id"]
    for i, boxes in reversed(list(enumerate(_cell_boxes(pieces)))):
        seen = lookup_join(found, boxes, on, "inner").select(*spot, f"y{i}", f"x{i}", best.alias("best"), worst.alias("worst"))
        bound = seen.groupBy(*spot).agg(F.min("worst").alias("bound"), F.collect_list(F.struct("best", f"y{i}", f"x{i}")).alias("cells"))
        near = bound.select(*spot, F.filter("cells", lambda c: c["best"] <= wider(F.col("bound"))).alias("cells"))
        on = ["route_id", f"y{i}", f"x{i}"]
        if i:
            found = near.select(*spot, F.inline("cells")).drop("best")
    near = _stored(near, "near-cells")
    # Joined row by row: the distance runs in generated code and is folded to one value per spot before anything moves.
    segments = pieces.select(*on, "lat_a", "lon_a", "lat_b", "lon_b")
    metres = geo.point_segment_distance_m("lat", "lon", "lat_a", "lon_a", "lat_b", "lon_b")
    first = near.select(*spot, "cells", F.array_min("cells").alias("c")).select(*spot, "cells", "c.y0", "c.x0")
    reached = lookup_join(first.drop("cells"), segments, on, "inner").groupBy(*spot).agg(F.min(metres).alias("distance_m"))
    others = first.join(reached, spot).select(*spot, "distance_m", F.col("y0").alias("_y"), F.col("x0").alias("_x"), F.inline("cells")).filter(
        ((F.col("y0") != F.col("_y")) | (F.col("x0") != F.col("_x")))
        & (F.col("best") <= wider(_square(F.col("distance_m") / METRES_PER_DEGREE))))
    nearer = lookup_join(others.select(*on, "lat", "lon"), segments, on, "inner").groupBy(*spot).agg(F.min(metres).alias("distance_m"))
    settled = reached.unionByName(nearer).groupBy(*spot).agg(F.min("distance_m").alias("distance_m"))
    return lookup_join(placed.select("vehicle_id", *spot), settled, spot, "inner").groupBy("vehicle_id", "route_id").agg(
        F.min("distance_m").alias("distance_m"))


def off_route_summary(vehicles: DataFrame, distances: DataFrame, k: int | None = None) -> DataFrame:
    """Sampled vehicles, those within 50 m, the mean; routes without a line count as sampled routes."""
    placed = vehicles.filter(F.col("route_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    chosen = placed.select("route_id").distinct() if k is None else busiest_k_routes(placed, k)
    routes = chosen.agg(F.count("*").alias("n"))
    within = count_if(F.col("distance_m") <= OFF_ROUTE_M)
    return distances.agg(F.count("*").alias("sampled"), within.alias("within_50m"),
                         F.round(F.avg("distance_m"), 1).alias("avg_distance_m")).select(
        "sampled", "within_50m", safe_pct("within_50m", "sampled").alias("pct_within_50m"),
        "avg_distance_m", routes.scalar().alias("routes_sampled"))


# ---- hotspots -------------------------------------------------------------
def label_few(points: DataFrame, stops: DataFrame, radius_deg: float = HOTSPOT_LABEL_RADIUS_DEG) -> DataFrame:
    """Nearest stop for a handful of points (a top-k list): one pass over the stops.

    The points, repeated for the nine cells around them, are broadcast: at most 9 rows per point.
    """
    cell = lambda name: F.floor(F.col(name) / (radius_deg * _WIDER))
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = (points.select("point_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
              .withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
              .select("point_id", "_lat", "_lon", (cell("_lat") + F.col("_dy")).alias("_y"),
                      (cell("_lon") + F.col("_dx")).alias("_x")))
    placed = stops.select("stop_id", "stop_name", "stop_lat", "stop_lon", cell("stop_lat").alias("_y"),
                          cell("stop_lon").alias("_x"))
    inside = (F.col("stop_lat").between(F.col("_lat") - radius_deg, F.col("_lat") + radius_deg)
              & F.col("stop_lon").between(F.col("_lon") - radius_deg, F.col("_lon") + radius_deg))
    d2 = _square(F.col("stop_lat") - F.col("_lat")) + _square(F.col("stop_lon") - F.col("_lon"))
    best = placed.join(F.broadcast(spread), ["_y", "_x"]).filter(inside).groupBy("point_id").agg(
        F.min(F.struct(d2.alias("d2"), "stop_id", "stop_name")).alias("hit"))
    return points.join(best, "point_id", "left").withColumn("stop_id", F.col("hit.stop_id")).withColumn(
        "stop_name", F.col("hit.stop_name")).drop("hit")


def hotspots(cells: DataFrame, stops: DataFrame, limit: int = 12) -> DataFrame:
    """Cells ranked three ways, each labelled with its nearest stop.

    One pass gives every cell a sort key per ranking it qualifies for; the top of each ranking is
    cut inside the tasks before anything is shuffled.
    """
    known = cell_centers(with_speed_and_dwell(cells.filter(F.col("speed_n") > 0)))
    crawling = (F.col("dwell_pct") <= MAX_DWELL_FOR_CONGESTION_PCT) & (F.col("speed_kmh") <= CONGESTED_KMH)
    entry = lambda name, key: F.struct(F.lit(name).alias("ranking"), key.alias("sort_key"))
    entries = F.array_compact(F.array(
        F.when(crawling, entry("congestion", F.col("speed_kmh"))),
        entry("dwell", -F.col("dwell_pct")),
        entry("busiest", -F.col("observations").cast("double"))))
    ranked = known.withColumn("e", F.explode(entries)).select("*", "e.ranking", "e.sort_key").drop("e")
    order = Window.partitionBy("ranking").orderBy("sort_key", "gy", "gx")
    listed = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    labelled = label_few(listed.withColumn("point_id", F.concat_ws(":", "ranking", "rank")), stops)
    return labelled.select(
        "ranking", "rank", "gy", "gx", "lat", "lon", "observations", "peak_vehicles", "speed_kmh",
        "dwell_pct", "stop_id", F.col("stop_name").alias("place"))
