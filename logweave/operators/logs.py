"""Replicated-log operators: replay with overwrites, gaps, agreement and quorum arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .strides import max_before, min_after


def replay(entries: DataFrame, position: str = "pos", index: str = "idx", stride: int = 1 << 14) -> DataFrame:
    """Rows that survive a replay: an entry replaces its own index and all after it.

    A row survives if no later row has an index at or below its own.  The least index after each
    row is taken within strides of positions, then over the least index of all later strides, so no
    task ever holds the whole log.
    """
    cut = entries.withColumn("_stride", F.floor(F.col(position) / stride))
    # one row a stride
    heads = min_after(cut.groupBy("_stride").agg(F.min(index).alias("_least")), [], "_stride", "_least", "_beyond").drop("_least")
    # backwards, as a frame that grows is summed up once and one that shrinks anew for every row
    within = Window.partitionBy("_stride").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.least(F.min(index).over(within), F.col("_beyond"))
    return cut.join(heads, "_stride").withColumn("_later", later).where(F.col("_later").isNull() | (F.col("_later") > F.col(index))).drop("_stride", "_beyond", "_later")


def gaps(entries: DataFrame, index: str = "idx", keys: tuple[str, ...] = (), stride: int = 1 << 14) -> DataFrame:
    """Places where the index does not follow the one before it, with that one as ``previous``.

    Neighbours are looked up within strides of indexes; the first of a stride takes the last of the
    stride before, for which one row a stride is enough.
    """
    cut = entries.withColumn("_stride", F.floor(F.col(index) / stride))
    ends = cut.groupBy(*keys, "_stride").agg(F.max(index).alias("_last"))
    ends = max_before(ends, list(keys), "_stride", "_last", "_before").drop("_last")
    within = F.lag(index).over(Window.partitionBy(*keys, "_stride").orderBy(index))
    seen = cut.withColumn("previous", within).join(ends, [*keys, "_stride"]).withColumn("previous", F.coalesce("previous", "_before"))
    return seen.where(F.col(index) - F.col("previous") != 1).drop("_stride", "_before")


def quorum(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(n / 2).cast("int") + 1


def quorum_index(matches: Column) -> Column:
    """The largest index that a quorum of an array of match indexes has reached."""
    n = F.size(matches)
    return F.element_at(F.array_sort(matches), n - quorum(n) + 1)


def advanced_commit(candidate: Column, old: Column, entry_term: Column, own_term: Column) -> Column:
    """The commit index once a quorum holds ``candidate``.

    Entries of earlier terms are only committed along with one of the leader's own term, and the
    index never goes back.
    """
    return F.when((candidate > old) & (entry_term == own_term), candidate).otherwise(old)
