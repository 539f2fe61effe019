"""Range scans over stored tables.

The log is laid out by UTC day. A filter on ``ts`` alone cannot prune those directories, so the
matching ``day`` range is added wherever the table has the column.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DAY_S


_LAST_DAY = 2_932_896  # 9999-12-31


def _day(ts: int):
    return F.date_add(F.lit("1970-01-01").cast("date"), max(0, min(ts // DAY_S, _LAST_DAY)))


def time_window(log: DataFrame, since: int, until: int | None = None, column: str = "ts") -> DataFrame:
    """Closed window ``[since, until]``; open at the end when ``until`` is None."""
    rows = log.filter(F.col(column) >= since)
    if until is not None:
        rows = rows.filter(F.col(column) <= until)
    if "day" in log.columns:
        rows = rows.filter(F.col("day") >= _day(since))
        if until is not None:
            rows = rows.filter(F.col("day") <= _day(until))
    return rows


def rows_since(table: DataFrame, since: int, column: str) -> DataFrame:
    return table.filter(F.col(column) >= since).orderBy(column)


def most_recent(table: DataFrame, limit: int, column: str) -> DataFrame:
    return table.orderBy(F.desc(column)).limit(limit)
