"""The periodic fold: rollups, continuity and trip matching from the log, each behind a watermark.

A watermark moves only after what it stands for is written. Rollup hours and matches are
replaced as wholes, so repeating a pass changes nothing. Gap counters are kept per fold and
summed when read, which makes repeating a continuity step harmless too.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import (CONTINUITY_CHUNK_S, GAP_THRESHOLD_S, MATCH_CHUNK_S, MATCH_REWIND_S)
from ..operators import continuity, keyed, matching, merge, rollup
from ..sources.scans import time_window
from . import tables

LOG_SCHEMA = schemas.T.StructType(
    schemas.POSITIONS.fields + schemas.struct_of("arrival:l day:D batch:l").fields)
WATERMARKS = schemas.struct_of("key:s value:l")
MATCH_UPDATES = schemas.T.StructType(schemas.TRIP_MATCH.fields + schemas.struct_of("batch:l").fields)
COUNTERS = schemas.T.StructType(schemas.CONTINUITY_HOUR.fields + schemas.struct_of("step:l").fields)


def newest_matches(updates: DataFrame) -> DataFrame:
    """Of every live trip the match that the latest pass wrote."""
    return keyed.first_per_key(updates, "live_trip_id", F.desc("batch"), F.desc("matched_at"), "route_id", "vehicle_id")


@dataclass(frozen=True)
class FoldTables:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def log(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("log"), LOG_SCHEMA)

    @property
    def grid_hours(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("grid_hour"), schemas.GRID_HOUR)

    @property
    def route_hours(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("route_hour"), schemas.ROUTE_HOUR)

    @property
    def gap_hours(self) -> DataFrame:
        """Counters of all steps: those folded into the base, and the steps after it."""
        base = tables.latest_version(self.spark, self.path("continuity_base"))
        steps = tables.read_table(self.spark, self.path("continuity"), COUNTERS)
        steps = (steps if base is None else steps.filter(F.col("step") > base)).drop("step")
        both = steps.unionByName(self.state("continuity_base", schemas.CONTINUITY_HOUR))
        return both.groupBy("hour_bucket").agg(*[F.sum(c).alias(c) for c in continuity.COUNTERS])

    def merge_steps(self, keep: int = 2) -> None:
        """Fold all but the newest steps into the base. The base names the last step in it, so a step
        whose folder outlives a failure is not counted twice."""
        steps = sorted(int(v) for v in tables.partition_values(self.spark, self.path("continuity"), "step"))[:-keep]
        base = tables.latest_version(self.spark, self.path("continuity_base"))
        fresh = [s for s in steps if base is None or s > base]
        if fresh:
            stored = tables.read_table(self.spark, self.path("continuity"), COUNTERS)
            rows = stored.filter(F.col("step").isin(fresh)).drop("step").unionByName(
                self.state("continuity_base", schemas.CONTINUITY_HOUR))
            sums = rows.groupBy("hour_bucket").agg(*[F.sum(c).alias(c) for c in continuity.COUNTERS])
            tables.write_version(sums, self.path("continuity_base"), fresh[-1])
        for step in steps:
            tables.drop_partition(self.spark, self.path("continuity"), "step", step)

    def _edge(self, day: str, pick) -> int | None:
        rows = self.log.filter(F.col("day") == F.lit(day).cast("date"))
        return rows.agg(pick("ts")).first()[0]

    def extent(self) -> tuple[int, int] | None:
        """Oldest and newest report, read from the first and the last day's folder alone."""
        days = tables.partition_values(self.spark, self.path("log"), "day")
        if not days:
            return None
        return self._edge(days[0], F.min), self._edge(days[-1], F.max)

    def state(self, name: str, schema) -> DataFrame:
        return tables.read_version(self.spark, self.path(name), schema)

    @property
    def trip_state(self) -> DataFrame:
        return self.state("trip_gap_state", schemas.TRIP_GAP_STATE)

    @property
    def matches(self) -> DataFrame:
        """The newest match of every live trip."""
        return newest_matches(tables.read_table(self.spark, self.path("trip_match"), MATCH_UPDATES)).drop("batch")

    def watermarks(self) -> dict:
        """A handful of named numbers."""
        return {r["key"]: r["value"] for r in self.state("watermarks", WATERMARKS).collect()}

    def advance(self, **marks: int) -> None:
        old = self.state("watermarks", WATERMARKS)
        fresh = self.spark.createDataFrame(list(marks.items()), WATERMARKS)
        version = tables.latest_version(self.spark, self.path("watermarks"))
        tables.write_version(merge.watermark_state(old, fresh), self.path("watermarks"),
                             0 if version is None else version + 1)


def fold_rollups(t: FoldTables, newest: int, full: bool = False) -> int:
    """Recompute the hours from one hour before the watermark; ``full`` recomputes all."""
    since = rollup.refold_since(t.watermarks().get("rollup"), full)
    tables.replace_hours(rollup.grid_hour_rollup(t.log, since), t.path("grid_hour"), since)
    tables.replace_hours(rollup.route_hour_rollup(t.log, since), t.path("route_hour"), since)
    t.advance(rollup=newest)
    return since


def _start(t: FoldTables, newest: int) -> int:
    """Where a first fold begins: just before the oldest stored report."""
    extent = t.extent()
    return newest if extent is None or extent[0] is None else max(0, extent[0] - 1)


def fold_continuity(t: FoldTables, newest: int, chunk_s: int = CONTINUITY_CHUNK_S,
                    threshold: int = GAP_THRESHOLD_S) -> bool:
    """One bounded step of the gap counters. Returns whether a backlog is left."""
    since = t.watermarks().get("continuity")
    since = _start(t, newest) if since is None else since
    if since >= newest:
        return False
    until = min(since + chunk_s, newest)
    vehicles = tables.read_version(t.spark, t.path("vehicle_gap_state"), schemas.VEHICLE_GAP_STATE, since)
    trips = tables.read_version(t.spark, t.path("trip_gap_state"), schemas.TRIP_GAP_STATE, since)
    counters = continuity.gap_hour_counters(t.log, since, until, threshold, vehicles)
    tables.replace_partitions(counters.withColumn("step", F.lit(until).cast("bigint")), t.path("continuity"), "step")
    # State versions carry the watermark they belong to, so a step always starts from its own.
    # The version it started from stays beside the new one, until the next step has been written.
    tables.write_version(continuity.vehicle_gap_state(t.log, since, until, vehicles), t.path("vehicle_gap_state"), until)
    tables.write_version(continuity.trip_gap_state(t.log, since, until, threshold, trips), t.path("trip_gap_state"), until)
    t.advance(continuity=until)
    t.merge_steps()
    return until < newest


def match_new_trips(t: FoldTables, trips: DataFrame, newest: int, now: int, compact_at: int = 64) -> bool:
    """Match the live trips seen since the watermark, with a short rewind, at most a day at once.

    A pass writes its own matches only; what is read takes the newest of each trip.
    """
    mark = t.watermarks().get("trip_match")
    since = max(0, mark - MATCH_REWIND_S) if mark is not None else _start(t, newest)
    if since >= newest:
        return False
    until = min(since + MATCH_CHUNK_S, newest)
    found = matching.match_window(t.log, trips, since, until, now)
    found.write.mode("overwrite").parquet(f"{t.path('trip_match')}/batch={until}")
    if len(tables.partition_values(t.spark, t.path("trip_match"), "batch")) > compact_at:
        tables.compact_updates(t.spark, t.path("trip_match"), MATCH_UPDATES, newest_matches)
    t.advance(trip_match=until)
    return until < newest


def run_once(t: FoldTables, trips: DataFrame, now: int, full: bool = False) -> dict:
    """One pass of all three folds; audit figures in the result."""
    for name in ("log", "trip_match"):
        tables.recover(t.spark, t.path(name))
    extent = t.extent()
    if extent is None or extent[1] is None:
        return {"rows_scanned": 0}
    newest = extent[1]
    since = fold_rollups(t, newest, full)
    backlog = fold_continuity(t, newest)
    unmatched = match_new_trips(t, trips, newest, now)
    scanned = time_window(t.log, since).count()
    counts = rollup.rollup_counts(t.grid_hours, t.route_hours).first()
    return {"rows_scanned": scanned, "watermark": newest, "since": since,
            "cells": counts["cells"], "routes": counts["routes"],
            "continuity_backlog": backlog, "match_backlog": unmatched}


def catch_up(t: FoldTables, newest: int, chunk_s: int = CONTINUITY_CHUNK_S) -> int:
    """Repeat continuity steps until no backlog is left; returns the number of steps."""
    steps = 1
    while fold_continuity(t, newest, chunk_s):
        steps += 1
    return steps
