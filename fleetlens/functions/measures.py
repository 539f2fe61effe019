"""Percentages, unit changes, labels and comparisons."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GAP_BUCKETS, IMPLAUSIBLE_MPS, MOVING_MPS, MPS_TO_KMH
from .columns import col, lit_or_col


def count_if(condition: Column) -> Column:
    """Conditional count that is 0, not NULL, over no rows."""
    return F.count(F.when(condition, F.lit(1)))


def safe_pct(part, total, digits: int = 1) -> Column:
    part, total = F.coalesce(col(part), F.lit(0)), col(total)
    return F.when(total > 0, F.round(part * 100.0 / total, digits))


def kmh(mps, digits: int = 1) -> Column:
    return F.round(lit_or_col(mps) * MPS_TO_KMH, digits)


def mean_kmh(speed_sum, speed_n, digits: int = 1) -> Column:
    total, n = col(speed_sum), col(speed_n)
    return F.when(n > 0, F.round(total / n * MPS_TO_KMH, digits))


def is_plausible_moving(speed="speed") -> Column:
    return (col(speed) > MOVING_MPS) & (col(speed) < IMPLAUSIBLE_MPS)


def is_stopped(speed="speed") -> Column:
    return col(speed) <= MOVING_MPS


def like_ci(column, text: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the text stay wildcards, a backslash is itself."""
    literal = text.replace("\\", "\\\\")
    return col(column).ilike(f"%{literal}%")


def label_range(index, width: float, bins: int) -> Column:
    """``lo-hi`` labels in km/h for bins ``width`` m/s wide; the last one is ``lo+``."""
    index = col(index)
    edge = lambda i: F.round(i * width * MPS_TO_KMH, 0).cast("int").cast("string")
    return F.when(index == bins - 1, F.concat(edge(index), F.lit("+"))).otherwise(
        F.concat(edge(index), F.lit("-"), edge(index + 1)))


def metric_class(value, low, high, classes: int = 7, reverse: bool = False) -> Column:
    """Index of the first of ``classes`` even breaks in [low, high] that is >= value."""
    value, low, high = map(lit_or_col, (value, low, high))
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    rank = F.least(F.greatest(F.ceil((value - low) / span * (classes - 1)), F.lit(0)), F.lit(classes - 1))
    placed = (F.lit(classes - 1) - rank) if reverse else rank
    return F.when(value.isNotNull(), placed).cast("int")


def any_differs(old: list, new: list) -> Column:
    """Null-safe row inequality: true when at least one pair differs."""
    return reduce(or_, (~col(a).eqNullSafe(col(b)) for a, b in zip(old, new)))


def gap_bucket_conditions(gap) -> dict:
    gap = col(gap)
    return {name: (gap > low) & (gap <= high) if high is not None else gap > low
            for name, low, high in GAP_BUCKETS}


def display_round(column, digits: int) -> Column:
    return F.round(col(column), digits)
