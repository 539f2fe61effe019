"""Small helpers shared by the column builders."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lit_or_col(value) -> Column:
    """Numbers become literals; names and columns become columns."""
    return F.lit(float(value)) if isinstance(value, (int, float)) else col(value)
