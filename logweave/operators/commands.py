"""Command logs: request deduplication, the versioned fold, and the states that follow from it.

A log is a table ``shard, log_index, key, op (PUT | DELETE), has_expected, expected, request_id,
cacheable, ttl, ts_ms``.  Deduplication reads only indexes and request ids, so it runs per request
id; the fold runs per key; both are exact and neither needs the other's data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequential import anchored_window, sequential

#: Log positions for which a request id is remembered.
DEDUP_WINDOW = 100_000


def with_anchors(commands: DataFrame, window: int = DEDUP_WINDOW) -> DataFrame:
    """Adds ``anchor``: the index of the command that executes for this one.

    An id is remembered while ``index - anchor <= window``; a repeat does not renew it; an empty id
    is never remembered.
    """
    marked = commands.withColumn("_no_id", F.coalesce(F.col("request_id"), F.lit("")) == "")
    # commands without an id are their own anchors wherever they are; spread them
    spread = marked.withColumn("_id", F.when(F.col("_no_id"), F.concat(F.lit("#"), F.col("log_index"))).otherwise(F.concat(F.lit("="), "request_id")))
    return anchored_window(spread, ["shard", "_id"], "log_index", window, skip="_no_id").drop("_no_id", "_id")


def executed(anchored: DataFrame) -> DataFrame:
    return anchored.where("log_index = anchor")


def duplicates(anchored: DataFrame) -> DataFrame:
    return anchored.where("log_index <> anchor")


def _step(state, row):
    version, live = state
    op, has_expected, expected = row
    if op == "STATE":  # where a restored key begins
        return (expected, has_expected), ("OK", expected)
    seen = version if live else 0
    if has_expected and expected != seen:
        return state, ("MISMATCH", seen)
    if op == "PUT":
        return (version + 1, True), ("OK", version + 1)
    if op != "DELETE":
        raise ValueError(f"unknown operation {op!r}")
    if not live:
        return state, ("NOT_FOUND", 0)
    return (version + 1, False), ("OK", version + 1)


def fold(commands: DataFrame) -> DataFrame:
    """Adds ``status`` and ``version`` to executed commands, key by key in log order.

    The expected version is compared first, with the visible version (0 where the key is deleted or
    absent); versions go on from tombstones.
    """
    return sequential(commands, ["shard", "key"], ["log_index"], ["op", "has_expected", "expected"], lambda: (0, False), _step, {"status": "string", "version": "bigint"})


def unconditional_versions(commands: DataFrame) -> DataFrame:
    """The fold in closed form for logs without expected versions: windows only.

    A DELETE succeeds if the command before it on the key is a PUT; the version is the running
    count of commands that succeeded.
    """
    order = Window.partitionBy("shard", "key").orderBy("log_index")
    ok = (F.col("op") == "PUT") | (F.coalesce(F.lag("op").over(order), F.lit("DELETE")) == "PUT")
    marked = commands.withColumn("_ok", ok)
    count = F.sum(F.col("_ok").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("status", F.when(F.col("_ok"), "OK").otherwise("NOT_FOUND"))
        .withColumn("version", F.when(F.col("_ok"), count).otherwise(F.lit(0)))
        .drop("_ok")
    )


def apply(commands: DataFrame, window: int = DEDUP_WINDOW) -> DataFrame:
    """Every command with its outcome; a repeat has the outcome of its anchor."""
    anchored = with_anchors(commands, window)
    done = fold(executed(anchored)).select("shard", F.col("log_index").alias("anchor"), "status", "version")
    return anchored.join(done, ["shard", "anchor"])


def state(outcomes: DataFrame) -> DataFrame:
    """Current records, tombstones included, from executed commands with outcomes.

    A tombstone keeps the cache policy of the last value.
    """
    ok = F.col("status") == "OK"
    put = ok & (F.col("op") == "PUT")
    last = F.max_by(F.struct("version", "op", "ts_ms"), F.when(ok, F.col("log_index")))
    policy = F.max_by(F.struct("cacheable", "ttl", F.col("event_id").alias("value")), F.when(put, F.col("log_index")))
    return (
        outcomes.where(ok)
        .groupBy("shard", "key")
        .agg(last.alias("l"), policy.alias("p"))
        .select(
            "shard",
            "key",
            F.when(F.col("l.op") == "PUT", F.col("p.value")).alias("value"),
            F.col("l.version").alias("version"),
            (F.col("l.op") == "DELETE").alias("deleted"),
            "p.cacheable",
            "p.ttl",
            F.col("l.ts_ms").alias("updated_ms"),
        )
    )


def live(records: DataFrame) -> DataFrame:
    return records.where(~F.col("deleted"))


def resume(records: DataFrame, tail: DataFrame) -> DataFrame:
    """Outcomes of ``tail``, folded on from restored ``records`` instead of from nothing."""
    start = records.select(
        "shard", F.lit(0).cast("bigint").alias("log_index"), "key", F.lit("STATE").alias("op"), (~F.col("deleted")).alias("has_expected"),
        F.col("version").alias("expected"), F.lit("").alias("request_id"), "cacheable", "ttl", F.col("updated_ms").alias("ts_ms"), F.col("value").alias("event_id"),
    )
    return fold(start.unionByName(tail.select(*start.columns))).where("op <> 'STATE'")
