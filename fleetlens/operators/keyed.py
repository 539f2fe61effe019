"""One row per key, lookups, and joins that stay even when one key is hot."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scans import time_window


def first_per_key(df: DataFrame, keys, *order) -> DataFrame:
    """The first row of every key by an ordering.

    ``row_number() = 1`` is planned with a per-task group limit in front of the shuffle, so each
    task sends at most one row per key and a hot key costs no more than any other.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys, n: int, *order) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def argmax_per_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """The item with most rows in each group; ties go to the smallest item."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return first_per_key(counts, group, F.desc("n"), F.asc(item))


def latest_in_window(positions: DataFrame, since: int, until: int) -> DataFrame:
    """Newest row of each vehicle with ``since <= ts <= until``."""
    order = [F.desc("ts")] + ([F.desc("arrival")] if "arrival" in positions.columns else [])
    return first_per_key(time_window(positions, since, until), "vehicle_id", *order)


def live_trip_keys(positions: DataFrame, since: int, until: int | None) -> DataFrame:
    """Newest vehicle of each (route, trip) seen in ``[since, until)``; open at the end if ``until`` is None."""
    seen = time_window(positions, since, None if until is None else until - 1).filter(
        F.col("trip_id").isNotNull() & F.col("route_id").isNotNull())
    newest = first_per_key(seen.select("route_id", "trip_id", "vehicle_id", "ts"),
                           ["route_id", "trip_id"], F.desc("ts"), F.asc("vehicle_id"))
    return newest.select("route_id", "trip_id", "vehicle_id")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def key_list_lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``; NULL ids match nothing."""
    return df.join(ids.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a large, possibly skewed frame to a lookup frame.

    Adaptive execution measures the lookup and broadcasts it if it is small. Beyond that both sides
    are shuffled, and it deals the rows of a hot key over several tasks (``session.configure`` turns
    that on); the join types used here all allow their left side to be split.
    """
    return big.join(small, [on] if isinstance(on, str) else list(on), how)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def unknown_keys(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct non-null candidate keys that the known set lacks."""
    wanted = candidates.select(key).filter(F.col(key).isNotNull()).distinct()
    return wanted.join(known.select(key).distinct(), key, "left_anti")


def new_key_count(staged: DataFrame, stored: DataFrame, keys) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    fresh = staged.join(stored.select(*keys), keys, "left_anti")
    return fresh.agg(F.count("*").alias("new_keys"))


def page(df: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
