"""Feed messages to the observation log, batch by batch."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..constants import HOUR_S
from ..operators import merge
from ..plans import tables
from ..plans.fold import LOG_SCHEMA
from ..sources.feeds import message_fields, position_entities, position_rows
from ..sources.scans import time_window

DEAD_SCHEMA = schemas.T.StructType(schemas.DEADLETTERS.fields + schemas.struct_of("arrival:l batch:l").fields)
POLL_SCHEMA = schemas.T.StructType(schemas.POLLS.fields + schemas.struct_of("message_key:l batch:l").fields)
LATEST_SCHEMA = schemas.T.StructType(schemas.POSITIONS.fields + schemas.struct_of("arrival:l batch:l").fields)
LATE_SCHEMA = "newest bigint, kept bigint, late bigint, batch bigint"
FIELD_SETS = "changed_at bigint, fields string, batch bigint"


@dataclass(frozen=True)
class IngestTables:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def log(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("log"), LOG_SCHEMA)

    @property
    def dead(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("dead"), DEAD_SCHEMA)

    @property
    def polls(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("polls"), POLL_SCHEMA)

    @property
    def latest(self) -> DataFrame:
        """The newest row of every vehicle; of equal times the later arrival."""
        return merge.latest_projection(tables.read_table(self.spark, self.path("latest"), LATEST_SCHEMA)).drop("batch")

    @property
    def late(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("late"), LATE_SCHEMA)

    def compact(self) -> None:
        """Fold the latest rows of past batches into one partition, and the closed days of the log."""
        tables.compact_updates(self.spark, self.path("latest"), LATEST_SCHEMA, merge.latest_projection)
        tables.compact_log(self.spark, self.path("log"), LOG_SCHEMA)

    @property
    def field_sets(self) -> DataFrame:
        return tables.read_table(self.spark, self.path("field_sets"), FIELD_SETS)


# An arrival number holds the micro-batch, the message in it and the entity in the message, so no two
# entities share one and their order is that of arrival.
MESSAGE_BITS, ENTITY_BITS = 18, 20
_BATCH_SHIFT = MESSAGE_BITS + ENTITY_BITS


def number_messages(messages: DataFrame, batch_id: int) -> DataFrame:
    """Adds ``message_key``: the batch and the message's place in it, by the time it came and its id.

    Only the keys of one micro-batch's messages are ordered, never their bodies, which aren't shuffled either: the
    numbers, bounded by MESSAGE_BITS, are broadcast to them. A message that came twice keeps one number. Messages
    without an id are told apart by a hash of their text.
    """
    mark = F.col("message_id") if "message_id" in messages.columns else F.xxhash64("body")
    marked = messages.withColumn("_mark", mark)
    keys = marked.select(F.col("ingested_at").alias("_at"), F.col("_mark").alias("_same")).distinct()
    place = F.row_number().over(Window.orderBy("_at", "_same")).cast("bigint") - 1
    fits = F.when(place < 1 << MESSAGE_BITS, place).otherwise(F.raise_error(F.lit("too many messages in one batch")))
    numbered = keys.withColumn("message_key", F.lit(batch_id * (1 << MESSAGE_BITS)) + fits)
    same = F.col("_at").eqNullSafe(F.col("ingested_at")) & F.col("_same").eqNullSafe(F.col("_mark"))
    return marked.join(F.broadcast(numbered), same).select(*messages.columns, "message_key")


def parsed_rows(numbered: DataFrame) -> DataFrame:
    """Numbered messages (body, ingested_at, message_key) parsed once: the rows of their entities with their arrival, message
    and ``header_time``, and for every message its first entity, even if that is no row (``vehicle_id`` is then NULL or empty)."""
    flat = position_rows(position_entities(numbered), F.col("ingested_at"))
    entity = F.when(F.col("entity_no") < 1 << ENTITY_BITS, F.col("entity_no")).otherwise(
        F.raise_error(F.lit("too many entities in one message")))
    arrival = F.col("message_key") * (1 << ENTITY_BITS) + F.when(F.col("entity_no").isNotNull(), entity)
    return flat.select(*schemas.POSITION_COLUMNS[:-1], "ingested_at", arrival.cast("bigint").alias("arrival"),
                       "message_key", "entity_no", "header_time")


def observation_rows(parsed: DataFrame) -> DataFrame:
    """The log rows among ``parsed_rows``."""
    return parsed.filter(F.col("vehicle_id") != "").select(*schemas.POSITION_COLUMNS[:-1], "ingested_at", "arrival")


def message_headers(parsed: DataFrame) -> DataFrame:
    """(message_key, polled_at, feed_timestamp) of every message among ``parsed_rows``, once."""
    first = parsed.filter(F.coalesce("entity_no", F.lit(0)) == 0)
    return first.select("message_key", F.col("ingested_at").alias("polled_at"), F.col("header_time").alias("feed_timestamp")).dropDuplicates(
        ["message_key"])


def message_of(arrival: str = "arrival"):
    return F.shiftright(arrival, ENTITY_BITS).alias("message_key")


def watch_fields(messages: DataFrame, store: IngestTables, now: int, batch_id: int) -> None:
    """Record the fields that carry a value in the batch's messages, whatever they are called, whenever they differ from
    those before."""
    before = store.field_sets.filter(F.col("batch") < batch_id).agg(F.max_by("fields", "batch").alias("f")).first()["f"]
    present = ",".join(message_fields(messages))
    if present and present != before:
        row = store.spark.createDataFrame([(now, present)], "changed_at bigint, fields string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{store.path('field_sets')}/batch={batch_id}")


def late_counts(rows: DataFrame, before: int | None, window_s: int) -> DataFrame:
    """(newest, kept, late): rows older than the window behind the newest of all earlier batches are late."""
    late = F.lit(False) if before is None else F.col("ts") < before - window_s
    newest = F.max("ts") if before is None else F.greatest(F.max("ts"), F.lit(before))
    return rows.agg(newest.alias("newest"), F.count(F.when(~late, 1)).alias("kept"), F.count(F.when(late, 1)).alias("late"))


def ingest_batch(store: IngestTables, routes: DataFrame, late_after_s: int = HOUR_S, compact_every: int = 64):
    """Writer for one micro-batch of messages: quarantine, dedupe-append, latest rows, one poll row per
    message, late rows, field watch.

    Every write replaces what the same batch may have written before a failure. Late rows are counted
    and kept: the log orders by report time, not by arrival.
    """
    def write(messages: DataFrame, batch_id: int) -> None:
        numbered = number_messages(messages, batch_id).persist()
        parsed = None
        try:
            now = numbered.agg(F.max("ingested_at")).first()[0]
            if now is None:
                return
            parsed = parsed_rows(numbered).persist()
            rows = observation_rows(parsed)
            kept, dead = merge.quarantine_split(rows, routes, now)
            span = kept.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
            if span["low"] is not None:
                # Only the stored stretch the batch can overlap with is read: day directories by
                # the window, row groups by the ts statistics.
                near = time_window(store.log.filter(F.col("batch") != batch_id), span["low"], span["high"])
                tables.append_log(merge.dedupe_append(near, kept), store.path("log"), batch_id)
                place = f"{store.path('latest')}/batch={batch_id}"
                merge.latest_projection(kept).write.mode("overwrite").parquet(place)
            dead.write.mode("overwrite").parquet(f"{store.path('dead')}/batch={batch_id}")
            fresh = time_window(store.log, span["low"] or 0, span["high"]).filter(F.col("batch") == batch_id)
            audit = merge.message_audit(message_headers(parsed), rows.select(message_of()), fresh.select(message_of()), "message_key")
            audit.write.mode("overwrite").parquet(f"{store.path('polls')}/batch={batch_id}")
            before = store.late.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            late_counts(rows, before, late_after_s).filter("newest IS NOT NULL").write.mode("overwrite").parquet(
                f"{store.path('late')}/batch={batch_id}")
            watch_fields(numbered, store, now, batch_id)
        finally:
            numbered.unpersist()
            if parsed is not None:
                parsed.unpersist()
        if batch_id % compact_every == compact_every - 1:
            store.compact()
    return write
