"""Sources, triggers and the keyed update sink shared by the streaming jobs."""

from collections.abc import Callable, Iterable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.keyed import first_per_key
from ..plans import tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_trigger`` bounds a backlog's batches."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed feed payloads, one JSON message per line, stamped with the time they arrived."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(folder)
    return lines.select(F.col("value").alias("body"),
                        F.unix_seconds("_metadata.file_modification_time").alias("ingested_at"))


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond the memory of an executor needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


DROPS_SCHEMA = "batch bigint, rows bigint, dropped bigint"


class WatermarkDrops(StreamingQueryListener):
    """Keeps, per micro-batch of the named query, the rows it read and those Spark dropped behind the watermark.

    ``store`` writes what has come since the last call; a batch that ran twice counts as it ran last.
    """

    def __init__(self, name: str):
        self.name, self._rows, self._ended = name, [], {}

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            self._rows.append((p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event()).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the events of an ended query have come; they are sent behind its back."""
        if not self._ended.setdefault(str(query.runId), Event()).wait(seconds):
            raise TimeoutError(f"no end of query {query.runId} was reported")

    def store(self, spark: SparkSession, root: str) -> None:
        rows, self._rows = self._rows, []
        for batch, read, dropped in rows:
            spark.createDataFrame([(read, dropped)], "rows bigint, dropped bigint").coalesce(1).write.mode("overwrite").parquet(
                f"{root}/batch={batch}")


def watermark_drops(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, root, DROPS_SCHEMA)


def start(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append", every: str | None = None,
          name: str | None = None):
    """Run ``write_batch(frame, batch_id)`` per micro-batch: on a schedule, or once over what is there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append", drops: WatermarkDrops | None = None) -> None:
    """Process all available input and stop. ``drops`` must be among the session's listeners."""
    query = start(stream, write_batch, checkpoint, mode, name=drops.name if drops else None)
    query.awaitTermination()
    if drops:
        drops.wait(query)


def drain_folders(spark: SparkSession, folders: Iterable[str], schema, job: Callable[[DataFrame], DataFrame], write_batch,
                  checkpoint: str, mode: str = "append", drops_to: tuple[str, str] | None = None) -> list[str]:
    """One trigger per folder: each is moved to where the stream looks, and all its files, however many, are one micro-batch.

    The job stops between folders and goes on from its checkpoint. ``drops_to`` (name, root) stores what the watermark
    dropped. Returns where the folders are now.
    """
    drops = WatermarkDrops(drops_to[0]) if drops_to else None
    if drops:
        spark.streams.addListener(drops)
    moved, landing = [], f"{checkpoint}-landing"
    try:
        for folder in folders:
            moved.append(tables.move(spark, folder, f"{landing}/{len(moved)}"))
            drain(job(file_stream(spark, f"{landing}/*", schema)), write_batch, checkpoint, mode, drops)
    finally:
        if drops:
            spark.streams.removeListener(drops)
            drops.store(spark, drops_to[1])
    return moved


def land(frame: DataFrame, root: str, column: str) -> list[str]:
    """Writes ``frame`` as one folder per value of ``column``, each by many tasks; the folders in order."""
    frame.write.partitionBy(column).parquet(root)
    return [f"{root}/{column}={v}" for v in sorted(tables.partition_values(frame.sparkSession, root, column), key=int)]


def update_sink(root: str, first: int = 0, fold: Callable[[], None] | None = None, every: int = 64):
    """Batch writer for keyed updates: each micro-batch replaces its own partition.

    A job that starts anew over a stored table numbers its batches from ``first``. ``fold`` is called after every
    ``every`` batches, to fold past updates together.
    """
    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{root}/batch={first + batch_id}")
        if fold and batch_id % every == every - 1:
            fold()
    return write


def newest_updates(spark: SparkSession, root: str, schema: str, keys) -> DataFrame:
    """The current value of every key: the one written by the latest batch."""
    updates = tables.read_table(spark, root, f"{schema}, batch bigint")
    return first_per_key(updates, keys, F.desc("batch")).drop("batch")


def compact_updates(spark: SparkSession, root: str, schema: str, keys) -> None:
    """Fold all but the latest batch of updates into one; of each key the latest batch's row stays."""
    tables.compact_updates(spark, root, f"{schema}, batch bigint", lambda rows: first_per_key(rows, keys, F.desc("batch")))
