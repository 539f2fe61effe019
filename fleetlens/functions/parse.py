"""Tolerant parsing of feed text: a bad value becomes NULL, never an error."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

# Text that means "no value" in the delay feed.
PLACEHOLDERS = ("", "N/A")


# A decimal number and nothing else: the cast alone also takes Java suffixes such as "12f" and "500D".
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(text, kind: str) -> Column:
    return F.when(col(text).rlike(_NUMBER), F.trim(col(text)).try_cast(kind))


def to_int(text) -> Column:
    return _number(text, "int")


def to_float(text) -> Column:
    return _number(text, "double")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once. Inside a lambda Spark shares no common expressions, so a value used n
    times is made n times, and such uses multiply when they are nested."""
    return F.transform(F.array(value), use)[0]


def clean_text(text) -> Column:
    value = F.trim(col(text))
    return F.when(~value.isin(*PLACEHOLDERS), value)


def clean_float(text) -> Column:
    """Placeholders are no numbers, so the test for one turns them into NULL."""
    return _number(text, "double")


def clean_int(text) -> Column:
    """Integers that may arrive as ``'12.0'``; the fraction is cut off."""
    return clean_float(text).try_cast("bigint")


def clean_flag(text) -> Column:
    return clean_text(text) == "1"


def clean_epoch(text, offset_s: int = 0) -> Column:
    """Positive epoch seconds, corrected for a feed that stamps local wall-clock time."""
    seconds = clean_int(text)
    return F.when(seconds > 0, seconds - offset_s)


def _strict_date(text: Column, year, month, day) -> Column:
    """Date from fixed digit positions; impossible calendar dates give NULL."""
    iso = F.concat_ws("-", F.substring(text, *year), F.substring(text, *month), F.substring(text, *day))
    return F.when(text.rlike("^[0-9]{8}$"), iso.try_cast("date"))


def compact_date(text) -> Column:
    """YYYYMMDD -> date."""
    return _strict_date(clean_text(text), (1, 4), (5, 2), (7, 2))


def service_date(text) -> Column:
    """DDMMYYYY if that reads as a year in 2000-2100, else YYYYMMDD under the same rule."""
    def plausible(value, *places):
        return bound(_strict_date(value, *places), lambda d: F.when(F.year(d).between(2000, 2100), d))
    return bound(clean_text(text), lambda value: F.coalesce(
        plausible(value, (5, 4), (3, 2), (1, 2)), plausible(value, (1, 4), (5, 2), (7, 2))))


def with_dispatch_minute(df: DataFrame, trip_id: str = "trip_id", name: str = "minute") -> DataFrame:
    """Adds minutes since midnight of ``route_HH_MM...``; hours up to 47, anything else is NULL.

    In steps, because each later expression uses the one before several times.
    """
    cut = df.withColumn("_parts", F.split(col(trip_id), "_"))
    number = lambda i: F.get("_parts", F.lit(i)).try_cast("int")
    timed = cut.withColumn("_hour", number(1)).withColumn("_minute", number(2))
    shaped = (F.size("_parts") >= 3) & F.col("_hour").between(0, 47) & F.col("_minute").between(0, 59)
    return timed.withColumn(name, F.when(shaped, F.col("_hour") * 60 + F.col("_minute"))).drop(
        "_parts", "_hour", "_minute")


def dispatch_hour(trip_id) -> Column:
    """Hour 0-23 of a trip id with exactly four parts."""
    parts = F.split(col(trip_id), "_")
    text = F.get(parts, F.lit(1))
    hour = F.when((F.size(parts) == 4) & text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(hour.between(0, 23), hour)
