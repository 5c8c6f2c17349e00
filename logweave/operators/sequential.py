"""Order-dependent operators that no window function expresses, with constant memory per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .strides import max_before, scan, sum_before


def sequential(
    df: DataFrame, keys: list[str], order: list[str], inputs: list[str], initial: Callable[[], object], step: Callable, outputs: dict[str, str]
) -> DataFrame:
    """Run a state machine over the rows of each key in order and append its outputs.

    ``step(state, inputs) -> (state, outputs)``.  Rows stream past one at a time after one shuffle
    and sort, so a key may have any number of rows; parallelism is the number of keys.
    """
    added = [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]
    kinds = [to_arrow_type(f.dataType) for f in added]
    at, names = {c: i for i, c in enumerate(df.columns)}, [*df.columns, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(at[c]).to_pylist() for c in {*keys, *inputs}}
            made = []
            for k, row in zip(zip(*[columns[c] for c in keys]), zip(*[columns[c] for c in inputs])):
                if k != key:
                    key, state = k, initial()
                state, out = step(state, row)
                made.append(out)
            extra = [pa.array(c, t) for c, t in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def segments(df: DataFrame, keys: list[str], order: str, width: int, name: str, stride: int = 1 << 16) -> DataFrame:
    """Adds ``name``: the ``order`` of the last row that lies more than ``width`` after the one before it.

    Neighbours and the last such row are looked up within strides of ``order`` and carried from one
    stride to the next, so a key with most of the rows is cut by many tasks.
    """
    cut = df.withColumn("_stride", F.floor(F.col(order) / stride))
    last = max_before(cut.groupBy(*keys, "_stride").agg(F.max(order).alias("_last")), keys, "_stride", "_last", "_before").drop("_last")
    rows = Window.partitionBy(*keys, "_stride").orderBy(order)
    seen = cut.join(last, [*keys, "_stride"]).withColumn("_before", F.coalesce(F.lag(order).over(rows), F.col("_before")))
    opened = seen.withColumn("_opens", F.when(F.col("_before").isNull() | (F.col(order) - F.col("_before") > width), F.col(order)))
    heads = max_before(opened.groupBy(*keys, "_stride").agg(F.max("_opens").alias("_last")), keys, "_stride", "_last", "_carried").drop("_last")
    upto = F.max("_opens").over(rows.rangeBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_upto", upto).join(heads, [*keys, "_stride"]).withColumn(name, F.coalesce("_upto", "_carried")).drop("_stride", "_before", "_opens", "_upto", "_carried")


def anchored_window(
    df: DataFrame, keys: list[str], order: str, width: int | str, strict: bool = False, skip: str | None = None, name: str = "anchor", cut: bool = False
) -> DataFrame:
    """Anchor of every row: the first row opens a window, rows within ``width`` of it share its
    anchor, and the first row beyond opens the next.  A row inside does not extend the window.

    ``cut`` divides keys at gaps beyond a fixed ``width``, where a window always opens: for keys that
    are few.  It can't go with ``skip``, whose rows would bridge gaps.

    ``width`` is a number or a column, read where a window opens; ``strict`` excludes a row exactly
    ``width`` away; rows whose boolean ``skip`` column is true are their own anchors and open none.
    """
    if cut and (skip is not None or not isinstance(width, int)):
        raise ValueError("only windows of one width over all rows can be cut at gaps")
    if cut:
        df = segments(df, keys, order, width, "_segment")
    df = df.withColumn("_width", F.lit(width).cast("long") if isinstance(width, int) else F.col(width).cast("long"))
    df = df.withColumn("_skip", F.col(skip) if skip else F.lit(False))

    def step(state, row):
        at, w, skipped = row
        if skipped:
            return state, (at,)
        if state is None or (at - state[0] >= state[1] if strict else at - state[0] > state[1]):
            state = (at, w)
        return state, (state[0],)

    by = [*keys, "_segment"] if cut else keys
    return sequential(df, by, [order], [order, "_width", "_skip"], lambda: None, step, {name: "bigint"}).drop("_width", "_skip", "_segment")


def dense_index(df: DataFrame, keys: list[str], order: str, name: str, stride: int = 1 << 16) -> DataFrame:
    """1, 2, 3, ... within each key by a whole-number ``order`` column.

    Numbers are ``rows in earlier strides + rank in the stride``, so a key with most of the rows is
    numbered by many tasks; only one count per key and stride meets in one place.
    """
    cut = df.withColumn("_stride", F.floor(F.col(order) / stride))
    bases = sum_before(cut.groupBy(*keys, "_stride").agg(F.count("*").alias("_n")), keys, "_stride", "_n", "_base").drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_stride").orderBy(order))
    return cut.withColumn("_rank", rank).join(bases, [*keys, "_stride"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_stride", "_base", "_rank")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], strict: bool = True, stride: int | None = None) -> DataFrame:
    """Backward as-of join: for each left row the latest right row of its key before ``at``.

    Both sides carry ``at``; rows of ``right`` at the same time count as later unless not
    ``strict``.  One union, one shuffle on the keys and a running last value, no range join.  With a
    ``stride`` of ``at`` a key is divided by it, and the last right row of earlier strides is carried
    over, so a key with most of the rows is joined by many tasks.
    """
    values = F.struct(F.col(at).alias("_at"), *take)
    r = right.select(*keys, F.col(at).alias("_t"), F.lit(1 if strict else -1).alias("_side"), values.alias("_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    l_ = left.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    rows, by = l_.unionByName(r), list(keys)
    if stride is not None:
        rows, by = rows.withColumn("_stride", F.floor(F.col("_t") / stride)), [*keys, "_stride"]
    seen = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_seen", F.last("_right", ignorenulls=True).over(seen))
    if stride is not None:
        ends = rows.groupBy(*by).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_t"))).alias("_last"))
        newest = lambda c: F.max_by(c, c["_at"])
        ends = scan(ends, keys, "_stride", "_last", "_carried", newest, F.coalesce).drop("_last")
        joined = joined.join(ends, by).withColumn("_seen", F.coalesce("_seen", "_carried"))
    joined = joined.where("_left IS NOT NULL")
    return joined.select("_left.*", F.col("_seen._at").alias(f"{at}_right"), *[F.col(f"_seen.{c}").alias(c) for c in take])


def cumulative(column: str, keys: list[str], order: list[str]) -> Column:
    return F.sum(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
