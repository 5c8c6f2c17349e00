"""Running folds over strides in two levels, so that no task sees one row for every stride."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 1 << 12


def scan(heads: DataFrame, keys: list[str], stride: str, value: str, name: str, fold: Callable[[Column], Column], merge: Callable[..., Column], backwards: bool = False, fan: int = FAN) -> DataFrame:
    """Adds ``name``: the fold of ``value`` over all earlier strides (all later ones if ``backwards``).

    ``heads`` has a row for each of the keys and strides.  Strides are folded within runs of ``fan`` of
    them, and runs among each other, so a task sees ``fan`` rows, or a row for every run.  ``merge``
    joins the two and is given nulls where there is nothing before.
    """
    order = (lambda c: F.desc(c)) if backwards else F.asc
    before = lambda *by: Window.partitionBy(*keys, *by[1:]).orderBy(order(by[0])).rowsBetween(Window.unboundedPreceding, -1)
    cut = heads.withColumn("_run", F.floor(F.col(stride) / fan))
    runs = cut.groupBy(*keys, "_run").agg(fold(F.col(value)).alias("_all")).withColumn("_outer", fold(F.col("_all")).over(before("_run"))).drop("_all")
    inner = cut.withColumn("_inner", fold(F.col(value)).over(before(stride, "_run")))
    return inner.join(runs, [*keys, "_run"]).withColumn(name, merge(F.col("_inner"), F.col("_outer"))).drop("_run", "_inner", "_outer")


def sum_before(heads: DataFrame, keys: list[str], stride: str, value: str, name: str) -> DataFrame:
    return scan(heads, keys, stride, value, name, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def max_before(heads: DataFrame, keys: list[str], stride: str, value: str, name: str) -> DataFrame:
    return scan(heads, keys, stride, value, name, F.max, F.greatest)


def min_after(heads: DataFrame, keys: list[str], stride: str, value: str, name: str) -> DataFrame:
    return scan(heads, keys, stride, value, name, F.min, F.least, backwards=True)
