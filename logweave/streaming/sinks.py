"""Invalidation sinks for streams: distinct paths of a micro-batch to a purge call, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame

ATTEMPTS, BASE_MS, PER_CALL = 4, 100, 1000


def ignore(paths: list[str]) -> None:
    """The sink that purges nothing."""


def with_retries(purge: Callable[[list[str]], None], attempts: int = ATTEMPTS, base_ms: int = BASE_MS, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], None]:
    """Doubling pauses between attempts; the last error is raised."""

    def call(paths: list[str]) -> None:
        for i in range(attempts):
            try:
                return purge(paths)
            except Exception:
                if i + 1 == attempts:
                    raise
                sleep(base_ms * 2**i / 1000)

    return call


def invalidate(purge: Callable[[list[str]], None], column: str = "path", per_call: int = PER_CALL) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every distinct path once, so many to a call.

    Paths are made distinct by Spark and fetched a partition at a time, so all calls come from the
    driver; ``invalidate_from_executors`` is for micro-batches with many paths.
    """

    def batch(df: DataFrame, _: int) -> None:
        _calls(purge, _paths(df, column).toLocalIterator(), per_call)

    return batch


def invalidate_from_executors(purge: Callable[[list[str]], None], column: str = "path", per_call: int = PER_CALL) -> Callable[[DataFrame, int], None]:
    """The same, each partition of distinct paths purged by the task that holds it.

    ``purge`` must be picklable and safe to repeat: a task that fails is run again.
    """

    def batch(df: DataFrame, _: int) -> None:
        _paths(df, column).foreachPartition(lambda rows: _calls(purge, rows, per_call))

    return batch


def _paths(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(f"{column} IS NOT NULL").distinct()


def _calls(purge: Callable[[list[str]], None], rows: Iterator, per_call: int) -> None:
    """So many paths to a call; after an error the other calls still go out and the first error is raised."""
    first: Exception | None = None
    while paths := [r[0] for r in islice(rows, per_call)]:
        try:
            purge(paths)
        except Exception as e:
            first = first or e
    if first is not None:
        raise first
