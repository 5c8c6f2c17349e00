"""Exact order statistics of large groups without gathering or sorting a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Quantiles that bound the segments of a range, and cells of even width in each of them.
SEGMENTS, CELLS = 32, 32


def cell_of(value: Column, bounds: list[float]) -> Column:
    """Number of a value's cell, growing with the value: cells divide the stretches between bounds evenly."""

    def within(i: int) -> Column:
        low, high = bounds[i], bounds[i + 1]
        width = high - low
        if not 0 < width < float("inf"):
            return F.lit(i * CELLS)
        return i * CELLS + F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((value - low) / width * CELLS))).cast("int")

    def search(i: int, j: int) -> Column:
        if j - i == 1:
            return within(i)
        middle = (i + j) // 2
        return F.when(value < bounds[middle], search(i, middle)).otherwise(search(middle, j))

    return search(0, len(bounds) - 1)


def running_counts(counted: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Adds ``upto`` (rows of the group at or below the value) and ``total``.

    ``counted`` has one row per group and distinct value.  The range of values is cut into cells
    between approximate quantiles, so heavy tails fill no cell: running sums over a bounded number of
    cells a group give each its base, and only the rows of one cell are sorted together.  Infinite
    values and NaN (the greatest) have their places like any other.
    """
    number = F.col(value).cast("double")
    cut = counted.withColumn("_cell", cell_of(number, _bounds(counted, number)))
    group = Window.partitionBy(*keys)
    bases = (
        cut.groupBy(*keys, "_cell")
        .agg(F.sum(n).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("_n").over(group))
        .drop("_n")
    )
    within = F.sum(n).over(Window.partitionBy(*keys, "_cell").orderBy(value))
    return cut.withColumn("_within", within).join(bases, [*keys, "_cell"]).withColumn("upto", F.col("_base") + F.col("_within")).drop("_cell", "_base", "_within")


def _bounds(counted: DataFrame, number: Column) -> list[float]:
    """Growing quantiles of the distinct values, two at least."""
    found = counted.where(number.isNotNull() & ~F.isnan(number)).agg(F.percentile_approx(number, [i / SEGMENTS for i in range(SEGMENTS + 1)], 2000).alias("q")).first().q
    bounds = sorted(set(found or [0.0]))
    return bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1.0 if abs(bounds[0]) < 1e15 else float("inf")]


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """``sorted[min(n - 1, floor(n * p))]`` of each group for each named p, its maximum and count."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_counts(counted, keys, value)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(p).alias(name) for name, p in ps.items()], F.max(value).alias("max"), F.max("total").alias("n"))
