"""What the operators share: staged tables, blocks of words, hashes, Arrow output."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shared_dir

# The blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage and survives lost executors.

    The plan isn't run again, so its shuffle files go as soon as the table is written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that no later plan reads, once what was made of them is staged itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, about ``size`` bytes of text at a time, so that memory stays bounded."""
    start = 0
    while start < len(data):
        cut = _BLANK.search(data, start + size)
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = values + _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` values; equal runs get equal hashes at any place.

    The factor is odd, so a changed value always changes the sum before it is scrambled.
    """
    if len(values) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) - width + 1, np.uint64)
        for i in range(width):
            total = total * _STEP + values[i:len(values) - width + 1 + i]
    return mixed(total)


def batches(schema: pa.Schema, rows: Iterator[tuple], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches from (row, bytes) pairs, cut at about ``limit`` bytes or 10,000 rows."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= limit or len(held) >= 10_000:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)
    pa.default_memory_pool().release_unused()  # the worker lives on; what its batches held goes back


def _batch(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
