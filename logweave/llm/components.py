"""Connected components of a table of links, distributed: alternating large-star and small-star.

Each round is a min-aggregation (combined before the shuffle) and an equi-join on the node, which
adaptive execution splits where a node is hot; no links or components ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _print(df: DataFrame):
    r = df.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of a link; root is the smallest node reachable.

    Nodes are longs.  Links to oneself, repeated links and links with a null end are ignored; an
    empty table gives no rows.
    """
    cur = settle(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    mark = _print(cur)
    for _ in range(rounds if mark[0] else 0):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        moved = large.join(low.withColumnRenamed("v", "m"), "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = settle(low.select("u", "v").unionByName(moved).distinct(), "small-star")
        if (now := _print(cur)) == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
