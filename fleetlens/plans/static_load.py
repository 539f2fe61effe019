"""Load of the static schedule: scan, last row wins by file position, key check, swap, load time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import static_csv
from . import tables

# The key of each table.
KEYS = {"agency": ["agency_id"], "routes": ["route_id"], "stops": ["stop_id"], "trips": ["trip_id"],
        "stop_times": ["trip_id", "stop_sequence"], "shapes": ["shape_id", "shape_pt_sequence"]}
META = "loaded_at bigint"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return tables.read_version(spark, f"{root}/{table}", static_csv.FILES[table][1])


def loaded_at(spark: SparkSession, root: str) -> int | None:
    rows = tables.read_version(spark, f"{root}/meta", META).collect()  # one row
    return rows[0][0] if rows else None


def load(spark: SparkSession, folder: str, root: str, now: int, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """Replace every table by the folder's content and return the change report of the keyed ones.

    Nothing is replaced if a route that history still names would go. Each table is written whole beside
    the old one, the load time last, so a load that stops half-way is simply run again.
    """
    fresh = {name: merge.static_replace_dedupe(static_csv.static_csv_scan(spark, folder, name, position=True).dropna(subset=keys), keys)
             for name, keys in KEYS.items()}
    changes = {name: merge.upsert_and_prune(read(spark, root, name), fresh[name], KEYS[name][0]) for name in ("routes", "trips")}
    if history is not None:
        merge.assert_droppable(changes["routes"].filter("change = 'deleted'"), history, "route_id")
    for name, rows in fresh.items():
        version = tables.latest_version(spark, f"{root}/{name}")
        tables.write_version(rows, f"{root}/{name}", 0 if version is None else version + 1)
    version = tables.latest_version(spark, f"{root}/meta")
    tables.write_version(spark.createDataFrame([(now,)], META), f"{root}/meta", 0 if version is None else version + 1)
    return changes
