"""Epoch seconds, schedule times and calendar parts. Nothing here depends on the session zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DAY_S, HOUR_S
from .columns import col


def time_bucket(ts="ts", width: int = HOUR_S) -> Column:
    ts = col(ts)
    return ts - F.pmod(ts, F.lit(width))


def hour_bucket(ts="ts") -> Column:
    return time_bucket(ts, HOUR_S)


def wall_clock(ts, zone: str = "UTC") -> Column:
    """Epoch seconds -> wall-clock TIMESTAMP_NTZ of a zone."""
    utc = F.timestamp_add("SECOND", col(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def hour_of_day(ts="ts", zone: str = "UTC") -> Column:
    if zone == "UTC":
        return F.floor(F.pmod(col(ts), F.lit(DAY_S)) / HOUR_S).cast("int")
    return F.hour(wall_clock(ts, zone))


def is_weekend(ts="ts", zone: str = "UTC") -> Column:
    return F.dayofweek(wall_clock(ts, zone)).isin(1, 7)


def local_date(ts, zone: str) -> Column:
    return F.to_date(wall_clock(ts, zone))


def day_of(ts="ts") -> Column:
    """UTC day, the partition column of the observation log."""
    return local_date(ts, "UTC")


def schedule_seconds(text) -> Column:
    """``HH:MM:SS`` with hours past 24 allowed -> seconds; anything else -> NULL."""
    parts = F.split(F.trim(col(text)), ":")
    units = [F.get(parts, F.lit(i)).try_cast("int").cast("bigint") for i in range(3)]
    return F.when(F.size(parts) == 3, (units[0] * 3600 + units[1] * 60 + units[2]).try_cast("int"))


def schedule_text(seconds) -> Column:
    seconds = col(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"),
                           F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"),
                           F.pmod(seconds, F.lit(60)).cast("int"))
