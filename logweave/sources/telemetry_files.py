"""Benchmark results as JSON lines and metrics as text, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LATENCY = "map<string, struct<p50:double, p95:double, p99:double, max:double, n:bigint>>"
_CONFIG = "struct<mix:string, dist:string, keys:bigint, value_size:bigint, cacheable:double, ttl:bigint, edge:string, nodes:array<string>>"
RUN_SCHEMA = (
    "name string, clients int, duration_s double, ops bigint, errors bigint, ops_per_s double, "
    f"latency_ms {_LATENCY}, cache_hits bigint, cache_reads bigint, stale_reads bigint, max_staleness_ms double, config {_CONFIG}"
)
OPTIONAL = ("cache_hits", "cache_reads", "stale_reads", "max_staleness_ms")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs with the fields that are left out when zero filled in."""
    rows = spark.read.schema(RUN_SCHEMA).json(path).where("name IS NOT NULL")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast(rows.schema[c].dataType) for c in OPTIONAL})


def append_runs(runs: DataFrame, path: str) -> None:
    zero = {c: F.when(F.col(c) != 0, F.col(c)) for c in OPTIONAL if c in runs.columns}
    runs.withColumns(zero).write.mode("append").option("ignoreNullFields", "true").json(path)


def latest_runs(runs: DataFrame, position: str, prefix: str = "") -> DataFrame:
    """The last run of each name, its prefix cut off."""
    name = F.when(F.startswith("name", F.lit(prefix)), F.substr("name", F.lit(len(prefix) + 1))).otherwise(F.col("name"))
    rest = [c for c in runs.columns if c != "name"]
    return runs.groupBy(name.alias("name")).agg(F.max_by(F.struct(*rest), position).alias("r")).select("name", "r.*")


def hit_and_stale_ratios(runs: DataFrame) -> DataFrame:
    one = F.greatest(F.lit(1), F.col("cache_reads"))
    return runs.select("name", "clients", (F.col("cache_hits") / one).alias("hit_ratio"), (F.col("stale_reads") / one).alias("stale_ratio"))


def write_metrics(lines: DataFrame, path: str) -> None:
    """One sorted text file; metrics of a process are few."""
    lines.coalesce(1).sortWithinPartitions("line").write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def batches(rows: DataFrame, keys: list[str], order: str, size: int = 20) -> DataFrame:
    """Adds ``batch``: rows of each key in groups of ``size`` in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size))
