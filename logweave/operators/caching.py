"""A time-to-live cache with revalidation and invalidation, as an analytic model of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import anchored_window, sequential


def _step(state, row):
    state, out = answer(state, row)
    return state, (*out, state is not None)


def answer(state, row):
    """state: (version, fetched, expires) or None; row: an invalidation, or a read with the origin's answer."""
    kind, t, ok, version, ttl = row
    if kind == 0:
        return None, (None, None, None, None)
    if state is not None and t < state[2]:
        return state, ("Hit", state[0], (t - state[1]) // 1000, False)
    if ok is None:  # the origin did not answer: better old than nothing
        return state, ("Stale", state[0], (t - state[1]) // 1000, True) if state is not None else ("Error", None, None, True)
    if ok:
        label = "RefreshHit" if state is not None and state[0] == version else "Miss"
        return (version, t, t + 1000 * ttl), (label, version, 0, True)
    # the origin refuses: an expired entry stays as it is
    return state, ("Miss", None, None, True)


def cache_steps(reads: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Reads and invalidations (kind 1 and 0) in order, and whether the cache holds an entry after each.

    Reads have a label (Hit, RefreshHit, Miss, Stale, Error), the version served and its age.

    ``reads(uri, t, read_id, ok, version, ttl)`` carry the origin's answer at that time, ``ok`` null
    where it is out of reach; ``invalidations(uri, t)`` drop the entry.  Hits need
    ``t < fetched + ttl``; without an answer an expired entry is served as it is.
    """
    gone = invalidations.select("uri", "t", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("read_id"), F.lit(False).alias("ok"), F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("ttl"))
    asked = reads.select("uri", "t", F.lit(1).alias("kind"), "read_id", "ok", F.col("version").cast("bigint").alias("version"), F.col("ttl").cast("bigint").alias("ttl"))
    return sequential(
        gone.unionByName(asked), ["uri"], ["t", "kind", "read_id"], ["kind", "t", "ok", "version", "ttl"], lambda: None, _step,
        {"label": "string", "served": "bigint", "age": "bigint", "asked_origin": "boolean", "held": "boolean"},
    )


def served(steps: DataFrame) -> DataFrame:
    return steps.where("kind = 1").select("uri", "t", "read_id", "label", "served", "age", "asked_origin")


def cache_trace(reads: DataFrame, invalidations: DataFrame) -> DataFrame:
    """``uri, t, read_id, label, served, age, asked_origin`` of every read of ``cache_steps``."""
    return served(cache_steps(reads, invalidations))


def coalesce_invalidations(paths: DataFrame, pause_ms: int = 50) -> DataFrame:
    """Batches of distinct paths: the first path waits ``pause_ms`` and takes along what arrives.

    ``paths(queue, t, path)``; a batch is named by its first time.  Queues are few, so they are divided
    where nothing arrives for longer than the pause.
    """
    return anchored_window(paths, ["queue"], "t", pause_ms, name="batch", cut=True).groupBy("queue", "batch").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("requests"))
