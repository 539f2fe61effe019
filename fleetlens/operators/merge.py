"""Merges, splits, refreshes and retention: the write side, as pure DataFrame functions.

Each function returns the new content of a table (or the rows to append); ``fleetlens.plans.tables``
puts it on storage.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_CHANGES, SIMULATED_PREFIX
from ..functions import clock
from ..functions.measures import any_differs, count_if
from .keyed import first_per_key, lookup_join

OBSERVATION_KEY = ["vehicle_id", "ts"]


# ---- observation log ------------------------------------------------------
def unique_observations(batch: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per (vehicle, ts): the first to arrive. Copies are dropped before the shuffle."""
    return first_per_key(batch, OBSERVATION_KEY, F.asc(order))


def dedupe_append(stored: DataFrame, batch: DataFrame, order: str = "arrival") -> DataFrame:
    """Rows of the batch that the log lacks.

    The stored side is narrowed to the days of the batch by a join key, so only those day
    partitions take part when the log is laid out by day.
    """
    keys = OBSERVATION_KEY + (["day"] if "day" in stored.columns and "day" in batch.columns else [])
    return unique_observations(batch, order).join(stored.select(*keys), keys, "left_anti")


def latest_projection(positions: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per vehicle: newest ts, and among equal ts the one that arrived last."""
    return first_per_key(positions, "vehicle_id", F.desc("ts"), F.desc(order))


def latest_wins_merge(current: DataFrame, batch: DataFrame, order: str = "arrival") -> DataFrame:
    """Replace a vehicle's row when the newcomer's ts is not older (equal ts: newcomer wins)."""
    sides = current.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return first_per_key(sides, "vehicle_id", F.desc("ts"), F.desc("_side"), F.desc(order)).drop("_side")


def quarantine_split(batch: DataFrame, routes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dead letters). A NULL route passes; a route the schedule lacks does not."""
    known = routes.select("route_id").distinct().withColumn("_known", F.lit(True))
    checked = lookup_join(batch, known, "route_id", "left")
    good = F.col("route_id").isNull() | F.coalesce("_known", F.lit(False))
    kept = checked.filter(good).select(*batch.columns)
    dead = checked.filter(~good).select(*batch.columns).withColumn(
        "reason", F.lit("unknown_route_id")).withColumn("quarantined_at", F.lit(now).cast("bigint"))
    return kept, dead


def deadletter_count(dead: DataFrame, since: int | None = None) -> DataFrame:
    rows = dead if since is None else dead.filter(F.col("quarantined_at") >= since)
    return rows.agg(F.count("*").alias("n"))


def prefix_purge(table: DataFrame, prefix: str = SIMULATED_PREFIX) -> DataFrame:
    """The table without rows whose vehicle id starts with the prefix."""
    return table.filter(~F.col("vehicle_id").startswith(prefix))


def purge_count(latest: DataFrame, prefix: str = SIMULATED_PREFIX) -> DataFrame:
    return latest.agg(count_if(F.col("vehicle_id").startswith(prefix)).alias("removed"))


# ---- retention ------------------------------------------------------------
def retention_prune(table: DataFrame, cutoff: int, column: str = "ts") -> DataFrame:
    """Rows that stay: those not older than the cutoff."""
    return table.filter(F.col(column) >= cutoff)


def retention_report(table: DataFrame, cutoff: int, column: str = "ts") -> DataFrame:
    """Per UTC day: rows kept and removed, and whether the whole day can simply be dropped."""
    old = F.col(column) < cutoff
    return table.groupBy(clock.day_of(column).cast("string").alias("day")).agg(
        F.count("*").alias("total"), count_if(old).alias("removed")).withColumn(
        "drop_day", F.col("removed") == F.col("total"))


def pull_log_retention(log: DataFrame, cutoff: int) -> DataFrame:
    """Prune pull-log rows, but keep everything from the newest successful trips pull on."""
    anchor = log.filter((F.col("check_no") == 3) & (F.col("row_count") > 0)).agg(
        F.coalesce(F.max("pulled_at"), F.lit(cutoff)).alias("anchor"))
    return log.filter((F.col("pulled_at") >= cutoff) | (F.col("pulled_at") >= anchor.scalar()))


# ---- schedule refresh -----------------------------------------------------
def static_replace_dedupe(rows: DataFrame, keys, position: str = "position") -> DataFrame:
    """Reloaded table content: of rows with the same key the last in file order stays."""
    return first_per_key(rows, keys, F.desc(position)).drop(position)


def upsert_and_prune(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Change report of a keyed refresh: every key with inserted / updated / unchanged / deleted."""
    values = [c for c in new.columns if c != key]
    left = old.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(True).alias("_in_old"))
    both = left.join(new.withColumn("_in_new", F.lit(True)), key, "full_outer")
    differs = any_differs([f"_old_{c}" for c in values], values)
    change = (F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "deleted")
              .when(differs, "updated").otherwise("unchanged"))
    return both.select(key, change.alias("change"))


def fk_restrict_check(deleted: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Keys that must not be dropped because history still points at them."""
    return deleted.select(key).distinct().join(history.select(key).distinct(), key, "left_semi")


def assert_droppable(deleted: DataFrame, history: DataFrame, key: str) -> None:
    held = fk_restrict_check(deleted, history, key)
    if not held.isEmpty():
        names = ", ".join(str(row[0]) for row in held.orderBy(key).limit(5).collect())
        raise ValueError(f"still referenced by history: {names}")


def fk_set_null(matches: DataFrame, trips: DataFrame) -> DataFrame:
    """Clear matched_trip_id where the trip is gone; the match type stays."""
    known = trips.select(F.col("trip_id").alias("matched_trip_id")).distinct().withColumn("_hit", F.lit(True))
    joined = lookup_join(matches, known, "matched_trip_id", "left")
    return joined.withColumn(
        "matched_trip_id", F.when(F.col("_hit"), F.col("matched_trip_id"))).select(*matches.columns)


def choose_replacement(current: DataFrame, pulled: DataFrame) -> DataFrame:
    """The pulled rows, or the current content when the pull is empty (``replace_if_nonempty``)."""
    return current if pulled.isEmpty() else pulled


def replace_if_nonempty(current: DataFrame, pulled: DataFrame) -> DataFrame:
    """The same decision inside one plan: current rows survive only if nothing was pulled."""
    pulled_any = pulled.agg((F.count("*") > 0).alias("any"))
    return current.filter(~pulled_any.scalar()).unionByName(pulled)


def concat_zones(zones: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, zones)


def all_zones_or_nothing(current: DataFrame, pulled: DataFrame, zones: list[int],
                         keys=("trip_id", "stop_sequence"), position: str = "position") -> DataFrame:
    """Replace the timetable only when every zone returned rows; across zones the last wins.

    ``pulled`` holds the concatenated zones with ``zone_id`` and the position of each row; the last
    zone is the last one of ``zones``, whatever its number.
    """
    seen = pulled.filter(F.col("zone_id").isin(*zones)).agg(
        (F.count_distinct("zone_id") == len(zones)).alias("complete"))
    rank = F.array_position(F.array(*map(F.lit, zones)), F.col("zone_id"))
    fresh = first_per_key(pulled, list(keys), F.desc(rank), F.desc(position)).drop(position)
    return current.filter(~seen.scalar()).unionByName(fresh.filter(seen.scalar()))


def zone_audit(pulled: DataFrame, zones: list[int], keys=("trip_id", "stop_sequence")) -> DataFrame:
    """One audit row: rows per pull, rows after dedupe, dropped copies, completeness."""
    per_key = pulled.groupBy(*keys).agg(F.count("*").alias("copies"))
    totals = per_key.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("pulled_rows"),
                         F.count("*").alias("unique_rows"))
    seen = pulled.filter(F.col("zone_id").isin(*zones)).agg(F.count_distinct("zone_id").alias("n"))
    return totals.select("pulled_rows", "unique_rows",
                         (F.col("pulled_rows") - F.col("unique_rows")).alias("dropped_rows"),
                         (seen.scalar() == len(zones)).alias("complete"))


# ---- delay feed -----------------------------------------------------------
STATUS_KEY = ["service_date", "trip_id"]
STATUS_VALUES = ["zone_id", "route_id", "start_time", "status", "stops_total", "stops_skipped",
                 "stops_with_delay", "max_delay_s"]
DELAY_KEY = ["service_date", "trip_id", "stop_sequence"]
DELAY_VALUES = ["stop_id", "arrival_delay_s", "departure_delay_s", "stop_status", "implausible"]


def _sides(stored: DataFrame, incoming: DataFrame, keys, kept) -> DataFrame:
    """Full outer join with stored columns under ``_old_`` and a flag for each side."""
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept], F.lit(True).alias("_in_old"))
    return old.join(incoming.withColumn("_in_new", F.lit(True)), list(keys), "full_outer")


def _pick(values) -> list:
    return [F.when(F.col("_in_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in values]


def trip_status_merge(stored: DataFrame, incoming: DataFrame, now, poll_id: int) -> DataFrame:
    """Upsert trip rows: values refresh, first_seen stays, the first canceled_at stays."""
    carried = STATUS_VALUES + ["first_seen", "last_seen", "canceled_at", "poll_id"]
    both = _sides(stored, incoming, STATUS_KEY, carried)
    fresh, now = F.col("_in_new"), F.lit(now)
    return both.select(
        *STATUS_KEY, *_pick(STATUS_VALUES),
        F.coalesce("_old_first_seen", now).alias("first_seen"),
        F.when(fresh, now).otherwise(F.col("_old_last_seen")).alias("last_seen"),
        F.coalesce("_old_canceled_at", F.when(fresh & (F.col("status") == "CANCELED"), now)).alias("canceled_at"),
        F.when(fresh, F.lit(poll_id)).otherwise(F.col("_old_poll_id")).cast("bigint").alias("poll_id"))


def _delay_state() -> dict:
    new = F.col("_in_old").isNull()
    return {"new": new, "changed": ~new & F.col("_in_new") & any_differs(
        [f"_old_{c}" for c in DELAY_VALUES], DELAY_VALUES)}


def stop_delay_merge(stored: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Upsert stop rows, touching only those whose values differ null-safely."""
    both = _sides(stored, incoming, DELAY_KEY, DELAY_VALUES + ["changes", "first_seen", "last_seen"])
    state, now = _delay_state(), F.lit(now)
    touched = state["new"] | F.coalesce(state["changed"], F.lit(False))
    changes = F.when(state["new"], 0).when(
        touched, F.least(F.col("_old_changes").cast("int") + 1, F.lit(MAX_CHANGES))
    ).otherwise(F.col("_old_changes").cast("int"))
    return both.select(
        *DELAY_KEY, *_pick(DELAY_VALUES), changes.cast("smallint").alias("changes"),
        F.coalesce("_old_first_seen", now).alias("first_seen"),
        F.when(touched, now).otherwise(F.col("_old_last_seen")).alias("last_seen"))


def stop_delay_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(inserted, changed) rows of one round."""
    both = _sides(stored, incoming, DELAY_KEY, DELAY_VALUES)
    state = _delay_state()
    return both.agg(count_if(state["new"]).alias("inserted"), count_if(state["changed"]).alias("changed"))


def seen_dimension_merge(stored: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Vehicle dimension: first_seen kept, last_seen refreshed, label = newest known label."""
    label = F.max_by(F.when(F.col("label").isNotNull(), F.col("label")),
                     F.when(F.col("label").isNotNull(), F.col("ts")))
    seen = batch.groupBy("vehicle_id").agg(label.alias("_new_label"))
    old = stored.select("vehicle_id", F.col("label").alias("_old_label"), F.col("first_seen").alias("_first"),
                        F.col("last_seen").alias("_last"))
    both = old.join(seen.withColumn("_in_new", F.lit(True)), "vehicle_id", "full_outer")
    now = F.lit(now)
    return both.select(
        "vehicle_id", F.coalesce("_new_label", "_old_label").alias("label"),
        F.coalesce("_first", now).alias("first_seen"),
        F.when(F.col("_in_new"), now).otherwise(F.col("_last")).alias("last_seen"))


def seen_rows(batch: DataFrame, now) -> DataFrame:
    """What one batch says about the vehicles in it: the newest label, and ``now`` as first and last time seen."""
    stored = batch.sparkSession.createDataFrame([], "vehicle_id string, label string, first_seen timestamp, last_seen timestamp")
    return seen_dimension_merge(stored, batch, now)


def seen_fold(updates: DataFrame) -> DataFrame:
    """Vehicle dimension from the rows (``seen_rows``) of many batches: as if they had been merged one after the other."""
    return updates.groupBy("vehicle_id").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("batch"))).alias("label"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


# ---- matches, audit, watermarks -------------------------------------------
def trip_match_upsert(stored: DataFrame, matches: DataFrame) -> DataFrame:
    """Keyed by the live trip id alone; the newer match replaces the older."""
    sides = stored.withColumn("_side", F.lit(0)).unionByName(matches.withColumn("_side", F.lit(1)))
    return first_per_key(sides, "live_trip_id", F.desc("_side"), F.desc("matched_at"),
                         F.asc("route_id"), F.asc("vehicle_id")).drop("_side")


def audit_row(batch: DataFrame, new_rows: DataFrame, now: int, source: str = "feed",
              http_status: int = 200, latency_ms: int | None = None) -> DataFrame:
    """One poll-log row for a batch; a batch without rows is a failed poll."""
    counts = batch.agg(F.count("*").alias("n"), F.max("feed_timestamp").alias("feed_timestamp"))
    fresh = new_rows.agg(F.count("*").alias("n"))
    ok = F.col("n") > 0
    return counts.select(
        F.lit(now).cast("bigint").alias("polled_at"), ok.cast("int").alias("ok"), F.lit(source).alias("source"),
        F.lit(http_status).alias("http_status"), F.col("n").cast("int").alias("entity_count"),
        fresh.scalar().cast("int").alias("new_rows"), F.col("feed_timestamp"),
        F.lit(latency_ms).cast("bigint").alias("latency_ms"),
        F.when(~ok, F.lit("feed returned no entities")).alias("error"))


def message_audit(messages: DataFrame, rows: DataFrame, fresh: DataFrame, key: str, source: str = "feed") -> DataFrame:
    """One poll-log row per message, those without a usable entity included.

    ``messages`` has the key, ``polled_at`` and ``feed_timestamp``, and may bring http_status,
    latency_ms and error; ``rows`` are its entities and ``fresh`` those of them that were new.
    """
    given = lambda name, kind, otherwise: (F.col(name) if name in messages.columns else F.lit(otherwise)).cast(kind)
    counted = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = messages.join(counted(rows, "_n"), key, "left").join(counted(fresh, "_new"), key, "left")
    n, failure = F.coalesce("_n", F.lit(0)), given("error", "string", None)
    ok = (n > 0) & failure.isNull()
    return both.select(
        "polled_at", ok.cast("int").alias("ok"), F.lit(source).alias("source"),
        given("http_status", "int", 200).alias("http_status"), n.cast("int").alias("entity_count"),
        F.coalesce("_new", F.lit(0)).cast("int").alias("new_rows"), "feed_timestamp",
        given("latency_ms", "bigint", None).alias("latency_ms"),
        F.when(~ok, F.coalesce(failure, F.lit("feed returned no entities"))).alias("error"), key)


def watermark_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Named watermarks after a fold: a changed key replaces the stored one."""
    kept = state.join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes)
