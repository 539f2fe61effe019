"""Live trips to the nearest timetabled departure of their route.

A route has at most 2880 distinct dispatch minutes (hours 0-47), however many trips it has. The
timetable and the live trips are first reduced to those minutes; the search for the neighbours of
a minute runs over the reduced rows, and the answer is joined back to the live trips.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MATCH_TOLERANCE_MIN
from ..functions import parse
from ..functions.measures import count_if, safe_pct
from ..sources.scans import time_window
from .keyed import live_trip_keys, lookup_join


TIMETABLE = "route_id string, minute int, first_trip string, last_trip string"


def timetable_minutes(scheduled: DataFrame) -> DataFrame:
    """The timetable reduced to (route, minute) with the first and last trip of the minute; may be stored."""
    planned = parse.with_dispatch_minute(scheduled.select("route_id", "trip_id"))
    return planned.groupBy("route_id", "minute").agg(F.min("trip_id").alias("first_trip"), F.max("trip_id").alias("last_trip"))


def _minutes(asked: DataFrame, scheduled: DataFrame | None, timetable: DataFrame | None) -> DataFrame:
    """(route, minute) of both sides with the first and last timetabled trip of the minute.

    Rows without a minute stay as one group per route; a filter here would be evaluated on the
    whole parsing expression once more for every row.
    """
    if timetable is None:
        timetable = parse.with_dispatch_minute(scheduled.select("route_id", "trip_id")).select(
            "route_id", "minute", F.col("trip_id").alias("first_trip"), F.col("trip_id").alias("last_trip"))
    none = F.lit(None).cast("string")
    live = parse.with_dispatch_minute(asked.select("route_id", "trip_id")).select(
        "route_id", "minute", none.alias("first_trip"), none.alias("last_trip"))
    return timetable.unionByName(live).groupBy("route_id", "minute").agg(
        F.min("first_trip").alias("first_trip"), F.max("last_trip").alias("last_trip"))


def nearest_departures(asked: DataFrame, scheduled: DataFrame | None, timetable: DataFrame | None = None) -> DataFrame:
    """Per (route, minute): the nearest timetabled trip and its distance in minutes.

    The earlier neighbour wins a tie in distance. Of trips in one minute the last counts when the
    minute lies before the asked one, the first when it lies at or after it.
    """
    ascending = Window.partitionBy("route_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    # Looking back in descending order keeps the frame a running one, linear in the rows.
    descending = Window.partitionBy("route_id").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, 0)
    planned = F.col("minute").isNotNull() & F.col("first_trip").isNotNull()
    neighbour = lambda trip: F.last(F.when(planned, F.struct("minute", F.col(trip).alias("trip"))), ignorenulls=True)
    around = _minutes(asked, scheduled, timetable).withColumn("before", neighbour("last_trip").over(ascending)).withColumn(
        "after", neighbour("first_trip").over(descending))
    back = F.col("minute") - F.col("before.minute")
    ahead = F.col("after.minute") - F.col("minute")
    take_before = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    return around.select(
        "route_id", "minute", F.when(take_before, back).otherwise(ahead).alias("delta"),
        F.when(take_before, F.col("before.trip")).otherwise(F.col("after.trip")).alias("nearest_trip"))


def trip_nearest_match(live: DataFrame, scheduled: DataFrame | None, now: int, seen: DataFrame | None = None,
                       tolerance_min: int = MATCH_TOLERANCE_MIN, timetable: DataFrame | None = None) -> DataFrame:
    """``strict`` at distance 0, ``relaxed`` within the tolerance, else ``none`` (distance kept).

    ``seen`` may name the rows the live keys were taken from; their minutes are then read from
    there instead of reducing them to keys a second time. ``timetable`` (``timetable_minutes``) may stand for ``scheduled``.
    """
    wanted = parse.with_dispatch_minute(live.select("route_id", "trip_id", "vehicle_id"))
    nearest = nearest_departures(live if seen is None else seen, scheduled, timetable)
    found = lookup_join(wanted, nearest, ["route_id", "minute"])
    delta = F.col("delta")
    kind = F.when(delta == 0, "strict").when(delta <= tolerance_min, "relaxed").otherwise("none")
    return found.select(
        F.col("trip_id").alias("live_trip_id"), "vehicle_id", "route_id",
        F.when(delta <= tolerance_min, F.col("nearest_trip")).alias("matched_trip_id"),
        kind.alias("match_type"), delta.cast("double").alias("delta_minutes"),
        F.lit(now).cast("bigint").alias("matched_at"))


def match_window(positions: DataFrame, scheduled: DataFrame | None, since: int, until: int | None, now: int,
                 timetable: DataFrame | None = None) -> DataFrame:
    """Match the live trips seen in ``[since, until)`` of the log; without an end if ``until`` is None."""
    live = live_trip_keys(positions, since, until)
    last = None if until is None else until - 1
    return trip_nearest_match(live, scheduled, now, seen=time_window(positions, since, last), timetable=timetable)


def trip_match_summary(matches: DataFrame, since: int) -> DataFrame:
    kinds = ("strict", "relaxed", "none")
    counts = matches.filter(F.col("matched_at") >= since).agg(
        F.count("*").alias("total"), *[count_if(F.col("match_type") == k).alias(k) for k in kinds])
    return counts.select("total", *kinds, safe_pct("strict", "total").alias("strict_pct"),
                         safe_pct(F.col("strict") + F.col("relaxed"), "total").alias("linked_pct"))
