"""Static schedule files (CSV with header, quoted commas, optional byte-order mark) to typed tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import clock, parse

# File of each table.
FILES = {
    "agency": ("agency.txt", schemas.AGENCY), "routes": ("routes.txt", schemas.ROUTES),
    "stops": ("stops.txt", schemas.STOPS), "trips": ("trips.txt", schemas.TRIPS),
    "shapes": ("shapes.txt", schemas.SHAPES), "stop_times": ("stop_times.txt", schemas.STOP_TIMES),
}
_DERIVED = {"arrival_s": "arrival_time", "departure_s": "departure_time"}


def _typed(name: str, kind: T.DataType, present) -> F.col:
    source = _DERIVED.get(name, name)
    if source not in present:
        return F.lit(None).cast(kind).alias(name)
    if name in _DERIVED:
        return clock.schedule_seconds(source).alias(name)
    text = F.col(source)
    if isinstance(kind, T.IntegerType):
        return parse.to_int(text).alias(name)
    if isinstance(kind, T.LongType):
        return F.trim(text).try_cast("bigint").alias(name)
    if isinstance(kind, T.DoubleType):
        return parse.to_float(text).alias(name)
    return text.alias(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False,
             position: bool = False) -> DataFrame:
    """Columns by header name; missing columns are NULL, extra ones are ignored.

    ``multi_line`` is for files with line breaks inside quotes; such a file cannot be split.
    ``position`` adds a column that orders rows as they stand in the file: the file, the split's first
    byte, and the row's number, which grows inside a split.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    place = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select(*[_typed(f.name, f.dataType, raw.columns) for f in schema], *[place.alias("position")] * position)


def static_csv_scan(spark: SparkSession, folder: str, table: str, multi_line: bool = False,
                    position: bool = False) -> DataFrame:
    """One schedule table from its folder; a missing file gives an empty table."""
    name, schema = FILES[table]
    try:
        return read_csv(spark, f"{folder}/{name}", schema, multi_line, position)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        empty = spark.createDataFrame([], schema)
        place = "struct<file_name:string,file_block_start:bigint,row:bigint>"
        return empty.withColumn("position", F.lit(None).cast(place)) if position else empty
