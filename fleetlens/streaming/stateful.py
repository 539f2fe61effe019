"""Keyed state over the position stream: latest rows, hourly cells, sessions, gaps, matches."""

from typing import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import DAY_S, DELAY_FEED_RETENTION_S, GAP_THRESHOLD_S, LATEST_RESTORE_S
from ..functions import clock, geo
from ..functions.measures import count_if, is_plausible_moving, is_stopped
from ..operators import matching
from ..operators.continuity import gap_flags
from ..plans import tables
from ..plans.fold import MATCH_UPDATES, newest_matches


# ---- latest row per vehicle ----------------------------------------------
def latest_rows(positions: DataFrame, columns) -> DataFrame:
    """Streaming aggregate: the newest row of each vehicle, the later arrival among equals."""
    newest = F.max_by(F.struct(*columns), F.struct("ts", "arrival")).alias("row")
    return positions.groupBy("vehicle_id").agg(newest).select("row.*")


class LatestProcessor(StatefulProcessor):
    """Holds the newest row of a vehicle until ``keep_s`` after it, in event time, and tells when it lets go."""

    def __init__(self, columns, schema: str, keep_s: int):
        self.columns, self.schema, self.keep_s = list(columns), schema, keep_s
        self.order = [self.columns.index(c) for c in ("ts", "arrival")]
        self.told = Row(*self.columns, "expired")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _rank(self, row) -> tuple:
        return tuple(row[i] for i in self.order)

    def _take(self, row) -> bool:
        """Keeps a row that is newer, or came later at the same time."""
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and self._rank(row) <= self._rank(held):
            return False
        due = lambda r: (r[self.order[0]] + self.keep_s) * 1000
        if held is not None:
            self.handle.deleteTimer(due(held))
        self.handle.registerTimer(due(row))
        self.newest.update(tuple(row))
        return True

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take([initialState[c] for c in self.columns])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(([r[c] for c in self.columns] for r in rows), key=self._rank)
        if self._take(best):
            yield self.told(*best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and (held[self.order[0]] + self.keep_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
            yield self.told(*held, True)

    def close(self) -> None:
        pass


def live_rows(positions: DataFrame, schema: str, restored: DataFrame | None = None, keep_s: int = LATEST_RESTORE_S,
              lateness: str = "1 hour") -> DataFrame:
    """Newest rows of the vehicles as they change, in the columns of ``schema`` (with vehicle_id, ts, arrival) and
    ``expired``: true in the row that says a vehicle has been silent for ``keep_s`` and its state is gone.

    ``restored`` are stored rows, one per vehicle, that a job without a checkpoint starts from. Rows behind the
    watermark are left out. State holds the vehicles of the last lateness and keep_s, not all ever seen. Needs RocksDB.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]
    timed = positions.select(*columns, F.timestamp_seconds("ts").alias("at")).withWatermark("at", lateness)
    initial = restored.select(*columns).groupBy("vehicle_id") if restored is not None else None
    return timed.groupBy("vehicle_id").transformWithState(
        LatestProcessor(columns, schema, keep_s), outputStructType=f"{schema}, expired boolean", outputMode="update",
        timeMode="eventTime", initialState=initial)


# ---- copies ---------------------------------------------------------------
def unique_rows(positions: DataFrame, keys=("vehicle_id", "ts"), lateness: str = "1 hour") -> DataFrame:
    """Streaming dedupe-append: the first of the rows with equal keys, without reading the log. A key is held until the
    watermark passes it; rows behind the watermark are dropped, and counted by Spark (``runner.WatermarkDrops``)."""
    timed = positions.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(list(keys))


# ---- hourly cells ---------------------------------------------------------
def hourly_cells(positions: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Closed hours of every cell, each once, from one read of the stream: copies go, then the rows of a vehicle in a
    cell are summed, then the vehicles of the cell. An hour closes when the watermark passes its end."""
    moving = is_plausible_moving()
    located = positions.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    vehicles = unique_rows(located, lateness=lateness).groupBy(
        F.window("at", "1 hour").alias("w"), geo.cell_y().alias("cell_y"), geo.cell_x().alias("cell_x"), "vehicle_id").agg(
        F.count("*").alias("observations"), count_if(moving).alias("moving"), count_if(is_stopped()).alias("stopped"),
        F.coalesce(F.sum(F.when(moving, F.col("speed"))), F.lit(0.0)).alias("speed_sum"))
    cells = vehicles.groupBy("w", "cell_y", "cell_x").agg(
        F.count("*").alias("vehicles"), *[F.sum(c).alias(c) for c in ("observations", "moving", "stopped", "speed_sum")])
    return cells.select("cell_y", "cell_x", F.unix_seconds("w.start").alias("hour_bucket"), "observations", "vehicles", "moving",
                        "stopped", "speed_sum")


# ---- sessions -------------------------------------------------------------
def sessions(positions: DataFrame, gap_s: int = GAP_THRESHOLD_S, lateness: str = "1 minute") -> DataFrame:
    """Stretches of a vehicle without a gap over the threshold; emitted once they are final."""
    timed = positions.select("vehicle_id", F.timestamp_seconds("ts").alias("at")).withWatermark("at", lateness)
    # A step of exactly the gap still belongs to the session; whole seconds make that gap + 0.
    spans = timed.groupBy("vehicle_id", F.session_window("at", f"{gap_s} seconds").alias("s")).agg(
        F.count("*").alias("reports"))
    return spans.select("vehicle_id", F.unix_seconds("s.start").alias("first_ts"),
                        (F.unix_seconds("s.end") - gap_s).alias("last_ts"), "reports")


# ---- gaps -----------------------------------------------------------------
TRIP_STATE_TTL_S = DELAY_FEED_RETENTION_S
GAP_SCHEMA = "kind string, vehicle_id string, trip_id string, ts bigint, prev_ts bigint, has_gap boolean"


class GapProcessor(StatefulProcessor):
    """Carries the last ts of a vehicle, and last ts and gap flag of each of its trips.

    A report not newer than the vehicle's last one is a copy or too late, and never counts. Once per
    day of a vehicle's reports, trips without a report for the time of retention are forgotten. All of
    it is one value, as every call for state goes to the executor and back; a vehicle has at most one
    report a second, so the time of retention bounds the value.
    """

    def __init__(self, threshold_s: int = GAP_THRESHOLD_S):
        self.threshold_s = threshold_s
        self.told = Row("kind", "vehicle_id", "trip_id", "ts", "prev_ts", "has_gap")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ts bigint, trips array<struct<trip_id: string, ts: bigint, has_gap: boolean>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        last, trips = (None, {}) if held is None else (held[0], {trip: (ts, has_gap) for trip, ts, has_gap in held[1]})
        # Late rows and copies go as they come; of equal times the first to arrive stays.
        first = {}
        for row in rows:
            ts, arrival = row["ts"], row["arrival"]
            if last is None or ts > last:
                rank = (arrival is None, arrival)
                if ts not in first or rank < first[ts][0]:
                    first[ts] = (rank, row["trip_id"])
        if not first:
            return
        times = sorted(first)
        by_trip = {}
        for ts, before in zip(times, [last, *times[:-1]]):
            if before is not None:
                yield self.told("gap", key[0], None, ts, before, None)
            trip = first[ts][1]
            if trip is not None:
                by_trip.setdefault(trip, []).append(ts)
        if last is not None and times[-1] // DAY_S > last // DAY_S:
            trips = {trip: known for trip, known in trips.items() if known[0] >= times[-1] - TRIP_STATE_TTL_S}
        for trip, seen in by_trip.items():
            trips[trip] = seen[-1], self._has_gap(trips.get(trip), seen)
            yield self.told("trip", key[0], trip, seen[-1], None, trips[trip][1])
        self.held.update((times[-1], [(trip, *known) for trip, known in trips.items()]))

    def _has_gap(self, known: tuple | None, times: list) -> bool:
        steps = list(zip(times, times[1:]))
        if known is not None:
            steps.append((known[0], times[0]))
        return bool(known is not None and known[1]) or any(b - a > self.threshold_s for a, b in steps)

    def close(self) -> None:
        pass


def gap_events(positions: DataFrame, threshold_s: int = GAP_THRESHOLD_S) -> DataFrame:
    """Gap rows and trip-state rows from keyed state; needs the RocksDB store (``use_rocksdb``)."""
    reports = positions.select("vehicle_id", "trip_id", "ts", "arrival")
    return reports.groupBy("vehicle_id").transformWithState(
        GapProcessor(threshold_s), outputStructType=GAP_SCHEMA, outputMode="append", timeMode="none")


def gap_counters(events: DataFrame, threshold_s: int = GAP_THRESHOLD_S) -> DataFrame:
    """Hour counters from written gap rows. Deriving them when read keeps a replay harmless."""
    gap = F.col("ts") - F.col("prev_ts")
    return events.filter(F.col("kind") == "gap").groupBy(clock.hour_bucket().alias("hour_bucket")).agg(
        *[count_if(c).alias(n) for n, c in gap_flags(gap, threshold_s).items()])


# ---- trip matching --------------------------------------------------------
def match_batch(root: str, trips: DataFrame, now: int, compact_every: int = 64):
    """Writer that matches the live trips of a batch; each batch writes its own matches only, and
    ``fold.newest_matches`` reads the newest of each trip. The timetable is reduced to its minutes once, beside the
    matches, when the first batch comes; past matches are folded after every ``compact_every`` batches."""
    timetable = f"{root}/.timetable"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not write.ready:
            matching.timetable_minutes(trips).write.mode("overwrite").parquet(timetable)
            write.ready = True
        matched = matching.match_window(batch, None, 0, None, now, spark.read.schema(matching.TIMETABLE).parquet(timetable))
        matched.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            tables.compact_updates(spark, root, MATCH_UPDATES, newest_matches)

    write.ready = False
    return write
