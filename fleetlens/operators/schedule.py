"""Questions to the static schedule."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import METRES_PER_DEGREE
from ..functions import geo
from ..functions.measures import like_ci
from .keyed import first_per_key, lookup_join, top_per_key


def trip_count_per_route(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Routes with the number of their trips, 0 when there is none."""
    counts = trips.groupBy("route_id").agg(F.count("*").alias("trip_count"))
    return routes.join(counts, "route_id", "left").withColumn("trip_count", F.coalesce("trip_count", F.lit(0)))


def _matches(columns, text: str | None):
    condition = F.lit(True)
    if text:
        condition = like_ci(columns[0], text)
        for name in columns[1:]:
            condition = condition | like_ci(name, text)
    return condition


def _first(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """All rows, or the first ``limit`` by an ordering."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def route_search(routes: DataFrame, trips: DataFrame, text: str | None = None, *, limit: int,
                 offset: int = 0) -> DataFrame:
    """A page of matching routes by short name, each with the total number of matches."""
    found = routes.filter(_matches(["route_short_name", "route_long_name", "route_desc"], text))
    total = found.agg(F.count("*").alias("n"))
    listed = trip_count_per_route(found, trips).orderBy("route_short_name", "route_id").offset(offset).limit(limit)
    return listed.withColumn("total", total.scalar())


def stop_search(stops: DataFrame, text: str | None = None, bbox=None, *, limit: int | None) -> DataFrame:
    found = stops.filter(_matches(["stop_name", "stop_code"], text))
    if bbox is not None:
        found = found.filter(geo.in_box(bbox, "stop_lat", "stop_lon"))
    return _first(found.select("stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon"), limit, "stop_id")


def stop_schedule(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stop_id: str,
                  from_s: int = 0, to_s: int = 200_000, *, limit: int | None) -> DataFrame:
    """Departures from a stop in a closed range of seconds; hours past 24 included."""
    here = stop_times.filter((F.col("stop_id") == stop_id) & F.col("departure_s").between(from_s, to_s))
    served = here.select("trip_id", "arrival_time", "departure_time", "departure_s").join(
        trips.select("trip_id", "route_id"), "trip_id")
    named = served.join(routes.select("route_id", "route_short_name", "route_desc"), "route_id", "left")
    return _first(named, limit, "departure_s", "trip_id")


def route_stops(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """For every route, the stops of its trip with most stop times."""
    sizes = stop_times.groupBy("trip_id").agg(F.count("*").alias("n"))
    ranked = sizes.join(trips.select("trip_id", "route_id"), "trip_id")
    longest = first_per_key(ranked, "route_id", F.desc("n"), "trip_id").select("route_id", "trip_id")
    calls = stop_times.join(longest, "trip_id")
    return calls.join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id").select(
        "route_id", "trip_id", "stop_sequence", "stop_id", "stop_name", "stop_lat", "stop_lon",
        "arrival_time", "departure_time")


def route_shape_ids(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """For every route, the shape with most points among its trips."""
    used = trips.filter(F.col("shape_id").isNotNull()).select("route_id", "shape_id").distinct()
    sizes = shapes.groupBy("shape_id").agg(F.count("*").alias("points"))
    return first_per_key(used.join(sizes, "shape_id"), "route_id", F.desc("points"), "shape_id").select(
        "route_id", "shape_id", "points")


def route_shape(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of each route's fullest shape. Rows, not one array: a shape has no size limit."""
    chosen = route_shape_ids(trips, shapes).select("route_id", "shape_id")
    return lookup_join(shapes, chosen, "shape_id", "inner").select(
        "route_id", "shape_id", "shape_pt_sequence", F.col("shape_pt_lon").alias("lon"),
        F.col("shape_pt_lat").alias("lat"))


def polyline(points: DataFrame, route_id: str) -> DataFrame:
    """One named route as an ordered list of (lon, lat)."""
    ordered = F.sort_array(F.collect_list(F.struct("shape_pt_sequence", "lon", "lat")))
    return points.filter(F.col("route_id") == route_id).groupBy("route_id").agg(
        F.transform(ordered, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def dark_routes(routes: DataFrame, trips: DataFrame, latest: DataFrame, *, limit: int | None) -> DataFrame:
    """Scheduled routes without any latest row, busiest timetable first."""
    seen = latest.select("route_id").filter(F.col("route_id").isNotNull()).distinct()
    dark = routes.join(seen, "route_id", "left_anti")
    counted = trip_count_per_route(dark, trips).select("route_id", "route_short_name", "route_desc", "trip_count")
    return _first(counted, limit, F.desc("trip_count"), "route_id")


def routes_nearby(probes: DataFrame, stops: DataFrame, stop_times: DataFrame, trips: DataFrame,
                  routes: DataFrame, radius_m: float = 500.0, *, limit: int | None) -> DataFrame:
    """Routes serving a stop within a circle around each probe (probe_id, lat, lon), nearest first.

    Probes and stops meet in cells as wide and high as the radius, in longitude at the probe's own
    latitude, then the exact circle decides. The timetable is narrowed to the stops found before it
    is joined.
    """
    band = radius_m / METRES_PER_DEGREE * (1 + 1e-6)  # a hair wider, against rounding
    near_probe = probes.select("probe_id", F.col("lat").alias("probe_lat"), F.col("lon").alias("probe_lon"))
    # Columns as wide as the radius at the band's edge farther from the equator; near the poles one column.
    far = F.greatest(F.abs(F.col("band") * band), F.abs((F.col("band") + 1) * band)) + band
    width = F.lit(band) / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.0)))), F.lit(0.01))
    home = F.floor(F.col("probe_lat") / band)
    near_probe = near_probe.withColumn("band", F.explode(F.sequence(home - 1, home + 1)))
    column = F.floor(F.col("probe_lon") / width)
    near_probe = near_probe.withColumn("column", F.explode(F.sequence(column - 1, column + 1)))
    banded = stops.select("stop_id", "stop_name", "stop_lat", "stop_lon").withColumn(
        "band", F.floor(F.col("stop_lat") / band)).withColumn("column", F.floor(F.col("stop_lon") / width))
    distance = geo.radius_distance_m("stop_lat", "stop_lon", "probe_lat", "probe_lon")
    near = banded.join(near_probe, ["band", "column"]).withColumn("distance_m", distance).filter(
        F.col("distance_m") <= radius_m).select("probe_id", "stop_id", "stop_name", "distance_m")
    calls = stop_times.select("stop_id", "trip_id").join(near.select("stop_id").distinct(), "stop_id", "left_semi")
    serving = calls.join(trips.select("trip_id", "route_id"), "trip_id").filter(
        F.col("route_id").isNotNull()).select("stop_id", "route_id").distinct()
    found = near.join(serving, "stop_id").groupBy("probe_id", "route_id").agg(
        F.min("distance_m").alias("distance_m"),
        F.sort_array(F.collect_set("stop_name")).alias("stops"))
    nearest = found if limit is None else top_per_key(found, "probe_id", limit, "distance_m", "route_id")
    names = routes.select("route_id", F.col("route_short_name").alias("short_name"),
                          F.col("route_long_name").alias("long_name"), "agency_id")
    return lookup_join(nearest, names, "route_id").withColumn("distance_m", F.round("distance_m", 1))


def feed_counts(agency, routes, stops, trips, stop_times, shapes, history) -> DataFrame:
    """Row counts of the schedule and the log, and the box around all stops."""
    counted = {"agencies": agency, "routes": routes, "stops": stops, "trips": trips,
               "stop_times": stop_times, "shape_points": shapes, "history_rows": history}
    box = stops.agg(F.min("stop_lat").alias("min_lat"), F.min("stop_lon").alias("min_lon"),
                    F.max("stop_lat").alias("max_lat"), F.max("stop_lon").alias("max_lon"))
    counts = [df.agg(F.count("*").alias("n")).scalar().alias(name) for name, df in counted.items()]
    return box.select(*counts, "min_lat", "min_lon", "max_lat", "max_lon")
