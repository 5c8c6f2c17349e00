"""Request mixes over a key space, uniform or Zipf: the batch form of a load generator."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bench_key

#: Ranks of a Zipf law that are drawn exactly; later ones are drawn by the law's integral.
HEAD = 1024


def parse_mix(text: str) -> list[tuple[str, float]]:
    """``get=80,put=15`` as cumulative shares of one."""
    pairs = [(name.strip(), float(share)) for name, share in (item.split("=", 1) for item in text.split(",") if item.strip())]
    total = sum(s for _, s in pairs)
    if not pairs or total <= 0 or any(s < 0 for _, s in pairs):
        raise ValueError(f"not a request mix: {text!r}")
    return [(n, upto / total) for (n, _), upto in zip(pairs, accumulate(s for _, s in pairs))]


def zipf_rank(u: Column, keys: int, s: float) -> Column:
    """Rank (from 0) of a uniform draw: inverse distribution over the head, integral beyond it."""
    head = min(HEAD, keys)
    weights = [(r + 1) ** -s for r in range(head)]
    integral = lambda a, b: (b ** (1 - s) - a ** (1 - s)) / (1 - s) if s != 1 else math.log(b / a)
    tail = integral(head + 0.5, keys + 0.5) if keys > head else 0.0
    total = sum(weights) + tail
    bounds = [w / total for w in accumulate(weights)]
    ends = F.array(*map(F.lit, bounds))
    found = F.size(F.filter(ends, lambda b: b < u))
    if keys <= head:
        return F.least(found, F.lit(keys - 1)).cast("bigint")
    v = (u - bounds[-1]) * total
    if s == 1:
        x = (head + 0.5) * F.exp(v)
    else:
        x = F.pow(F.lit((head + 0.5) ** (1 - s)) + v * (1 - s), F.lit(1 / (1 - s)))
    return F.when(found < head, found).otherwise(F.least(F.floor(x - 0.5), F.lit(keys - 1))).cast("bigint")


def draw(seed: int, row: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row's number only."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), row.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def workload(spark: SparkSession, requests: int, keys: int, mix: str = "get=80,put=15,delete=5", zipf: float | None = None, cacheable: float = 0.0, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """``request, op, key``, the same for the same seed however the rows are dealt."""
    shares = parse_mix(mix)
    rows = spark.range(0, requests, 1, partitions).withColumnRenamed("id", "request")
    rows = rows.withColumn("_op", draw(seed, F.col("request"))).withColumn("_key", draw(seed + 1, F.col("request")))
    op = F.lit(shares[-1][0])
    for name, upto in reversed(shares[:-1]):
        op = F.when(F.col("_op") < upto, name).otherwise(op)
    rank = F.floor(F.col("_key") * keys) if zipf is None else zipf_rank(F.col("_key"), keys, zipf)
    return rows.select("request", op.alias("op"), bench_key(rank.cast("bigint"), cacheable).alias("key"))
