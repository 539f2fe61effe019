"""Session settings and the shared folder for checkpoints and intermediate tables."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Only settings the results or the skew handling rely on. Parallelism (shuffle partitions, split
# size, memory) belongs to the cluster and is left alone.
_SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming sessions of a busy key are merged inside the tasks before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("fleetlens")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Otherwise the call site of every column expression is recorded, which takes longer than
        # planning. A static setting: a cluster job passes it when it is submitted.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_ROWS_A_TASK = 500_000


@contextmanager
def room_for(spark: SparkSession, rows: int):
    """Inside the block a shuffle of so many rows has at least one partition for every half a million of them, so that what a
    task sorts doesn't grow with the input. Never fewer than the cluster's own number; adaptive execution may join small ones."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // _ROWS_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local-mode session (tests) may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-fleetlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
