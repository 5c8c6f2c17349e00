"""State snapshots as Parquet: records (tombstones included) and remembered requests, together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(records: DataFrame, anchored: DataFrame, path: str, at: int, window: int) -> None:
    """``records`` as of log position ``at``, and the requests still remembered then.

    The records are written last: a folder without them is no snapshot.
    """
    remembered = anchored.where((F.col("log_index") == F.col("anchor")) & (F.col("log_index") <= at) & (F.coalesce("request_id", F.lit("")) != ""))
    remembered.where(F.col("anchor") >= at - window).select("shard", "request_id", "anchor").write.parquet(f"{path}/requests")
    records.withColumn("at", F.lit(at).cast("bigint")).write.partitionBy("shard").parquet(f"{path}/records")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and remembered requests; reading one shard opens only its files."""
    return spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/requests")
