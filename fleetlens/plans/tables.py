"""Stored tables as plain Parquet directories.

The observation log is partitioned by day and micro-batch, rollups by hour bucket. Whole
partitions are replaced with dynamic partition overwrite, so a repeated batch or fold leaves the
same content. Small keyed tables are kept as numbered versions.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY_S
from ..functions import clock
from ..operators.merge import retention_prune


FOLDED = -1  # batch number of rows that were folded together

# ---- folders --------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    location = hadoop.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _fs(spark, path)
    return fs.exists(location)


def partition_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """Values of the first partition column, read from directory names alone."""
    fs, location = _fs(spark, root)
    if not fs.exists(location):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(location)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, location = _fs(spark, path)
    fs.delete(location, True)


def drop_partition(spark: SparkSession, root: str, column: str, value) -> None:
    drop_folder(spark, f"{root}/{column}={value}")


def swap_partition(spark: SparkSession, staged: str, target: str) -> None:
    """Put a written folder in the place of another one.

    The old content is set aside under a name that readers skip and goes last; ``recover`` puts it
    back if the swap was cut off before the new content was in place.
    """
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, target)
    parent, name = target.rsplit("/", 1)
    _, aside = _fs(spark, f"{parent}/.old.{name}")
    if fs.exists(old):
        fs.delete(aside, True)
        fs.rename(old, aside)
    fs.rename(new, old)
    fs.delete(aside, True)


def move(spark: SparkSession, source: str, target: str) -> str:
    """Rename a folder to a place that must be free, and return it."""
    fs, old = _fs(spark, source)
    _, new = _fs(spark, target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise FileExistsError(f"{source} can't be moved to {target}")
    return target


def recover(spark: SparkSession, root: str) -> None:
    """Undo a swap that was cut off: what was set aside comes back unless its successor is there."""
    fs, location = _fs(spark, root)
    if not fs.exists(location):
        return
    for status in fs.listStatus(location):
        name = status.getPath().getName()
        if name.startswith(".old."):
            _, target = _fs(spark, f"{root}/{name.removeprefix('.old.')}")
            if not fs.exists(target):
                fs.rename(status.getPath(), target)
            else:
                fs.delete(status.getPath(), True)


def read_table(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table, or an empty frame before its first write. The schema is explicit either way."""
    if not exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def replace_partitions(df: DataFrame, root: str, *columns: str) -> None:
    """Write, replacing exactly the partitions the frame holds.

    The rebalance step gathers each partition into few files and splits the ones that are too
    large for a single task.
    """
    df.hint("rebalance", *columns).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(root)


# ---- observation log ------------------------------------------------------
def append_log(rows: DataFrame, root: str, batch_id: int) -> None:
    """Append one micro-batch; writing the same batch again replaces it."""
    placed = rows.withColumn("day", clock.day_of()).withColumn("batch", F.lit(batch_id).cast("bigint"))
    replace_partitions(placed, root, "day", "batch")


def time_partition_layout(rows: DataFrame, column: str = "ts", hourly: bool = False) -> DataFrame:
    """Adds the partition columns: UTC day, and the hour of day for the faster feed."""
    placed = rows.withColumn("day", clock.day_of(column))
    return placed.withColumn("hour", clock.hour_of_day(column)) if hourly else placed


def prune_log(spark: SparkSession, root: str, schema, cutoff: int) -> list[str]:
    """Drop whole days before the cutoff and rewrite the day it falls into. Returns dropped days."""
    recover(spark, root)
    boundary = str(spark.range(1).select(clock.local_date(F.lit(cutoff), "UTC")).first()[0])
    dropped = [day for day in partition_values(spark, root, "day") if day < boundary]
    for day in dropped:
        drop_partition(spark, root, "day", day)
    if cutoff % DAY_S and exists(spark, f"{root}/day={boundary}"):
        _rewrite_day(spark, root, schema, boundary, lambda rows: retention_prune(rows, cutoff))
    return dropped


def _rewrite_day(spark: SparkSession, root: str, schema, day: str, change, batch: int | None = None) -> None:
    """Write a day's changed content aside, then swap it in; one batch folder if ``batch`` is given."""
    rows = change(read_table(spark, root, schema).filter(F.col("day") == F.lit(day).cast("date"))).drop("day")
    if batch is not None:
        rows = rows.withColumn("batch", F.lit(batch).cast("bigint"))
    aside = f"{root}/.new.day={day}"
    rows.hint("rebalance", "batch").write.mode("overwrite").partitionBy("batch").parquet(aside)
    swap_partition(spark, aside, f"{root}/day={day}")


def compact_log(spark: SparkSession, root: str, schema) -> list[str]:
    """Fold every closed day (all but the newest) that holds several batches into one. Returns the days.

    The folder gets a number that no batch has, so a batch that is written again replaces nothing in it;
    it finds its rows in the log and appends none of them.
    """
    recover(spark, root)
    done = []
    for day in partition_values(spark, root, "day")[:-1]:
        batches = [int(v) for v in partition_values(spark, f"{root}/day={day}", "batch")]
        if len(batches) > 1:
            _rewrite_day(spark, root, schema, day, lambda rows: rows, FOLDED)
            done.append(day)
    return done


def compact_updates(spark: SparkSession, root: str, schema, newest) -> bool:
    """Fold all but the latest batch of updates into one with ``newest``, so that reads stay short. False if there are
    not two to fold."""
    recover(spark, root)
    done = sorted(int(v) for v in partition_values(spark, root, "batch"))[:-1]
    if len(done) < 2:
        return False
    updates = read_table(spark, root, schema).filter(F.col("batch") <= done[-1])
    aside = f"{root}/.new.batch={done[-1]}"
    newest(updates).drop("batch").write.mode("overwrite").parquet(aside)
    swap_partition(spark, aside, f"{root}/batch={done[-1]}")
    for batch in done[:-1]:
        drop_partition(spark, root, "batch", batch)
    return True


def prune_updates(spark: SparkSession, root: str, schema, newest, keep) -> None:
    """Fold past batches and leave out what ``keep`` drops, in one rewrite; the latest batch, which may be written
    again, is rewritten by itself."""
    folded = compact_updates(spark, root, schema, lambda rows: keep(newest(rows)))
    for batch in sorted(int(v) for v in partition_values(spark, root, "batch"))[-1 if folded else -2:]:
        aside = f"{root}/.new.batch={batch}"
        keep(read_table(spark, root, schema).filter(F.col("batch") == batch)).drop("batch").write.mode("overwrite").parquet(aside)
        swap_partition(spark, aside, f"{root}/batch={batch}")


# ---- rollups --------------------------------------------------------------
def replace_hours(folded: DataFrame, root: str, since: int) -> None:
    """Replace every hour from ``since`` on, and remove those that hold nothing any more."""
    spark = folded.sparkSession
    stored = {int(v) for v in partition_values(spark, root, "hour_bucket") if int(v) >= since}
    # The hours written are noted while writing, so the fold runs once.
    written = Observation()
    replace_partitions(folded.observe(written, F.collect_set("hour_bucket").alias("hours")), root, "hour_bucket")
    for hour in stored - set(written.get["hours"] or ()):
        drop_partition(spark, root, "hour_bucket", hour)


# ---- small keyed tables ---------------------------------------------------
def latest_version(spark: SparkSession, root: str) -> int | None:
    versions = [int(v) for v in partition_values(spark, root, "version")]
    return max(versions, default=None)


def read_version(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    version = latest_version(spark, root) if version is None else version
    if version is None or not exists(spark, f"{root}/version={version}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={version}")


def write_version(df: DataFrame, root: str, version: int, keep: int = 2) -> None:
    """Write the whole new content beside the old one; readers move on when it is complete.

    The newest ``keep`` versions up to this one stay, whatever their numbers.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    older = sorted(int(v) for v in partition_values(spark, root, "version") if int(v) < version)
    for old in older[:len(older) - keep + 1]:
        drop_partition(spark, root, "version", old)
