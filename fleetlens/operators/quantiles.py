"""Exact percentiles without gathering the values anywhere.

Values are counted per distinct value, the distinct values are counted per slice of a given value
range (a bounded number of slices), and only the slices that hold a wanted rank are ordered.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def _values_at(df: DataFrame, column: str, ranks: dict, low: float, high: float) -> DataFrame:
    """One row: ``total``, and the value at each named 0-based rank, given as a function of the total.

    ``low`` and ``high`` bound most values; any others fall into the end slices, which costs
    evenness but never exactness.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count("*").alias("n"))
    slice_of = F.floor((F.col("v") - low) * (SLICES / (high - low)))
    sliced = counts.withColumn("slice", F.greatest(F.lit(0), F.least(slice_of, F.lit(SLICES - 1))))
    # Both windows run over at most SLICES rows.
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("slice").agg(F.sum("n").alias("size")).withColumn(
        "before", F.coalesce(F.sum("size").over(running), F.lit(0))).withColumn(
        "total", F.sum("size").over(Window.orderBy("slice").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))

    ranks = {name: rank(F.col("total")) for name, rank in ranks.items()}
    def holds(rank, size):
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col(size))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | holds(rank, "size")
    holding = starts.filter(wanted).select("slice", "before", "total")
    upto = Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(holding, "slice").withColumn(
        "before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return placed.agg(F.max("total").alias("total"), *[
        F.max(F.when(holds(rank, "n"), F.col("v"))).alias(name) for name, rank in ranks.items()])


def linear_percentiles(df: DataFrame, column: str, probabilities: dict, low: float, high: float) -> DataFrame:
    """One row; linear interpolation between the two neighbouring ranks."""
    def position(p):
        return lambda total: (total - 1) * F.lit(float(p))
    def side(p, rounding):
        return lambda total: rounding(position(p)(total))
    ranks = {f"{name}_{end}": side(p, rounding) for name, p in probabilities.items()
             for end, rounding in (("lo", F.floor), ("hi", F.ceil))}
    ends = _values_at(df, column, ranks, low, high)
    def between(name, k):
        return F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (k - F.floor(k))
    return ends.select(*[between(name, position(p)(F.col("total"))).alias(name) for name, p in probabilities.items()])


def floor_ranks(df: DataFrame, column: str, probabilities: dict, low: float, high: float) -> DataFrame:
    """One row: the value at 0-based rank ``min(n - 1, int(n * p))`` of the ascending values."""
    def rank(p):
        return lambda total: F.least(total - 1, F.floor(total * F.lit(float(p))))
    return _values_at(df, column, {name: rank(p) for name, p in probabilities.items()}, low, high).drop("total")
