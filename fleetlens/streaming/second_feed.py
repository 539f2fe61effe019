"""Jobs of the second feed: vehicle polls to the log, delay rounds to the status tables, retention."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import DELAY_FEED_CLOCK_OFFSET_S, DELAY_FEED_RETENTION_S, DELAY_FEED_ZONE
from ..functions import clock
from ..operators import merge
from ..operators.keyed import first_per_key
from ..plans import tables
from ..session import room_for
from ..sources import feeds
from ..sources.scans import time_window

_OBSERVED = ("vehicle_id string, label string, lat double, lon double, bearing double, trip_id string, route_id string, start_time string, "
             "start_date date, scheduled boolean, sch_no string, stop_id string, status int, ts bigint, arrival bigint")
VEHICLE_LOG = f"{_OBSERVED}, day date, batch bigint"
VEHICLE_LATEST = f"{_OBSERVED}, batch bigint"
VEHICLES = "vehicle_id string, label string, first_seen timestamp, last_seen timestamp, batch bigint"
POLLS = ("message_id bigint, polled_at bigint, ok boolean, error string, entities bigint, stale bigint, new_rows bigint, "
         "duplicates bigint, batch bigint")
ROUNDS = "message_id bigint, zone_id int, ok boolean, error string, trips bigint, stops bigint, batch bigint"


@dataclass(frozen=True)
class SecondFeedTables:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema) -> DataFrame:
        return tables.read_table(self.spark, self.path(name), schema)

    @property
    def log(self) -> DataFrame:
        return self._read("log", VEHICLE_LOG)

    @property
    def latest(self) -> DataFrame:
        return merge.latest_projection(self._read("latest", VEHICLE_LATEST)).drop("batch")

    @property
    def vehicles(self) -> DataFrame:
        return merge.seen_fold(self._read("vehicles", VEHICLES))

    @property
    def polls(self) -> DataFrame:
        return self._read("polls", POLLS)

    @property
    def rounds(self) -> DataFrame:
        return self._read("rounds", ROUNDS)

    @property
    def trip_status(self) -> DataFrame:
        return self._read("trip_status", schemas.TRIP_STATUS)

    @property
    def stop_delay(self) -> DataFrame:
        return self._read("stop_delay", schemas.STOP_DELAY)


def _counted(entities: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per message: entities, stale ones, rows and new rows, all counted by one grouping."""
    def ones(df, message, **counts):
        return df.select(F.col(message).alias("message_id"), *[
            counts.get(c, F.lit(0)).cast("bigint").alias(c) for c in ("entities", "stale", "rows", "new_rows")])
    each = ones(entities, "message_id", entities=F.lit(1), stale=F.col("stale")).unionByName(
        ones(rows, "arrival", rows=F.lit(1))).unionByName(ones(fresh, "arrival", new_rows=F.lit(1)))
    return each.groupBy("message_id").agg(*[F.sum(c).alias(c) for c in each.columns[1:]])


def vehicle_batch(store: SecondFeedTables, offset_s: int = DELAY_FEED_CLOCK_OFFSET_S,
                  retention_s: int = DELAY_FEED_RETENTION_S, compact_every: int = 64):
    """Writer for a micro-batch of vehicle polls (message_id, ingested_at, body): log, latest rows, vehicle
    dimension and one poll row per message, failures included. A batch that is written again replaces itself."""
    def write(messages: DataFrame, batch_id: int) -> None:
        spark, now = store.spark, messages.agg(F.max("ingested_at")).first()[0]
        if now is None:
            return
        polls = feeds.json_envelope_split(messages).drop("body").persist()
        # Rows and audit come from the same cleaned entities: a message is parsed once.
        entities = feeds.vehicle_entities(polls.filter("ok").select("message_id", "data"), now, offset_s, retention_s).persist()
        rows = feeds.vehicle_rows(entities).withColumnRenamed("message_id", "arrival").persist()
        try:
            span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
            fresh = rows.filter("false").select("arrival")
            if span["low"] is not None:
                near = time_window(store.log.filter(F.col("batch") != batch_id), span["low"], span["high"])
                tables.append_log(merge.dedupe_append(near, rows), store.path("log"), batch_id)
                fresh = time_window(store.log, span["low"], span["high"]).filter(F.col("batch") == batch_id).select("arrival")
                merge.latest_projection(rows).write.mode("overwrite").parquet(f"{store.path('latest')}/batch={batch_id}")
            # Only the vehicles of this batch are written; readers fold the batches.
            seen = merge.seen_rows(rows, F.timestamp_seconds(F.lit(now)))
            seen.write.mode("overwrite").parquet(f"{store.path('vehicles')}/batch={batch_id}")
            told = polls.select("message_id", F.col("ingested_at").alias("polled_at"), "ok", "error").join(
                _counted(entities, rows, fresh), "message_id", "left")
            zero = lambda name: F.coalesce(name, F.lit(0))
            told.select("message_id", "polled_at", "ok", "error", "entities", zero("stale").alias("stale"), zero("new_rows").alias("new_rows"),
                        (zero("rows") - zero("new_rows")).alias("duplicates")).write.mode(
                "overwrite").parquet(f"{store.path('polls')}/batch={batch_id}")
        finally:
            for df in (rows, entities, polls):
                df.unpersist()
        if batch_id % compact_every == compact_every - 1:
            tables.compact_updates(spark, store.path("latest"), VEHICLE_LATEST, merge.latest_projection)
            tables.compact_updates(spark, store.path("vehicles"), VEHICLES, merge.seen_fold)
            tables.compact_log(spark, store.path("log"), VEHICLE_LOG)
    return write


def _merge_days(store: SecondFeedTables, name: str, schema, rows: DataFrame, keys, change) -> None:
    """Replace the service days that ``rows`` touch, by the row of the last message for every key. Written aside first: a
    plan must not overwrite the files it reads; every day is then swapped in by itself."""
    named = rows.groupBy("service_date").count().collect()  # a few days per round
    days = [row["service_date"] for row in named]
    incoming = first_per_key(rows, keys, F.desc("message_id")).drop("message_id")
    tables.recover(store.spark, store.path(name))
    stored = tables.read_table(store.spark, store.path(name), schema).filter(F.col("service_date").isin(days)) if days else None
    if stored is None:
        return
    aside = f"{store.root}/.new.{name}"
    with room_for(store.spark, stored.count() + sum(row["count"] for row in named)):
        change(stored, incoming).hint("rebalance", "service_date").write.mode("overwrite").partitionBy("service_date").parquet(aside)
    for day in days:
        tables.swap_partition(store.spark, f"{aside}/service_date={day}", f"{store.path(name)}/service_date={day}")


def delay_round(store: SecondFeedTables):
    """Writer for the messages (message_id, zone_id, ingested_at, body) of one round: trip status and stop
    delays by service day, and a row per zone call. Of a trip that several messages name the last one counts."""
    def write(messages: DataFrame, batch_id: int) -> None:
        now = messages.agg(F.max("ingested_at")).first()[0]
        if now is None:
            return
        # Parsed once and set aside, nothing is cached.
        aside = f"{store.root}/.round"
        settled = feeds.trip_update_settled(feeds.json_envelope_split(messages).select("message_id", "zone_id", "ok", "error", "data"))
        settled.write.mode("overwrite").parquet(aside)
        calls = store.spark.read.schema(settled.schema).parquet(aside)
        trips, stops = feeds.settled_rows(calls)
        at = F.timestamp_seconds(F.lit(now))
        status = trips.withColumn("zone_id", F.col("zone_id").cast("smallint"))
        _merge_days(store, "trip_status", schemas.TRIP_STATUS, status, merge.STATUS_KEY,
                    lambda old, new: merge.trip_status_merge(old, new, at, batch_id))
        _merge_days(store, "stop_delay", schemas.STOP_DELAY, stops, merge.DELAY_KEY,
                    lambda old, new: merge.stop_delay_merge(old, new, at))
        told = calls.select("message_id", "zone_id", "ok", "error", *[F.size(c).cast("bigint").alias(c) for c in ("trips", "stops")])
        told.write.mode("overwrite").parquet(f"{store.path('rounds')}/batch={batch_id}")
        tables.drop_folder(store.spark, aside)
    return write


def apply_retention(store: SecondFeedTables, now: int, retention_s: int = DELAY_FEED_RETENTION_S) -> dict:
    """Drop what is older than the retention: log rows, latest rows and vehicles by time, delays and trip
    status by whole service days of the feed's own zone."""
    spark, cutoff = store.spark, now - retention_s
    local = str(spark.range(1).select(clock.local_date(F.lit(cutoff), DELAY_FEED_ZONE)).first()[0])
    dropped = {"log": tables.prune_log(spark, store.path("log"), VEHICLE_LOG, cutoff)}
    for name in ("stop_delay", "trip_status"):
        old = [d for d in tables.partition_values(spark, store.path(name), "service_date") if d < local]
        for day in old:
            tables.drop_partition(spark, store.path(name), "service_date", day)
        dropped[name] = old
    alive = store.vehicles.filter(F.col("last_seen") >= F.timestamp_seconds(F.lit(cutoff))).select("vehicle_id").persist()
    try:
        alive.count()  # known before the first of its files is rewritten
        tables.prune_updates(spark, store.path("vehicles"), VEHICLES, merge.seen_fold, lambda rows: rows.join(alive, "vehicle_id", "left_semi"))
    finally:
        alive.unpersist()
    tables.prune_updates(spark, store.path("latest"), VEHICLE_LATEST, merge.latest_projection, lambda rows: merge.retention_prune(rows, cutoff))
    return dropped
