"""The time-to-live cache as a stream: the batch model's rules, one small state an address."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.caching import answer
from .apply import configure

OUTPUT = "uri string, t long, read_id long, label string, served long, age long, asked_origin boolean"
EVENTS = "uri string, t long, kind int, read_id long, ok boolean, version long, ttl long"


class CacheMachine(StatefulProcessor):
    """State: version, fetch time and expiry of an address; none where nothing is cached.

    An expired entry stays for revalidation and for times without an origin.  With ``forget_ms`` a
    timer drops it so long after it was last fetched, which bounds the state by what was read lately;
    a query with timers goes on making batches, so it has no end under the availableNow trigger.
    """

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "version long, fetched long, expires long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = before = tuple(self.entry.get()) if self.entry.exists() else None
        # an address's events of one micro-batch, in order
        columns = ("t", "kind", "read_id", "ok", "version", "ttl")
        events = sorted((r for pdf in rows for r in zip(*(pdf[c].tolist() for c in columns))), key=lambda r: r[:3])
        out = []
        for t, kind, read_id, ok, version, ttl in events:
            known = [None if pd.isna(v) else v for v in (ok, version, ttl)]
            state, (label, served, age, asked) = answer(state, (kind, t, *known))
            if kind:
                out.append((key[0], t, read_id, label, served, age, asked))
        if state != before:
            self.entry.update(tuple(map(int, state))) if state is not None else self.entry.clear()
            if state is not None and self.forget_ms is not None:
                at = int(timerValues.getCurrentProcessingTimeInMs()) + self.forget_ms
                self.due.update((at,))
                self.handle.registerTimer(at)
        made = pd.DataFrame(out, columns=["uri", "t", "read_id", "label", "served", "age", "asked_origin"])
        yield made.astype({"t": "int64", "read_id": "int64", "served": "Int64", "age": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an earlier timer of an entry that was fetched again since says nothing
        if not self.due.exists() or expiredTimerInfo.getExpiryTimeInMs() >= self.due.get()[0]:
            self.entry.clear()
            self.due.clear()
        yield pd.DataFrame(columns=["uri", "t", "read_id", "label", "served", "age", "asked_origin"]).astype({"t": "int64", "read_id": "int64"})

    def close(self) -> None:
        pass


def events(reads: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Both kinds of events in one stream: ``reads(uri, t, read_id, ok, version, ttl)`` as for the batch
    model and ``invalidations(uri, t)``."""
    gone = invalidations.select(
        "uri", "t", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("read_id"), F.lit(False).alias("ok"), F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("ttl")
    )
    asked = reads.select("uri", "t", F.lit(1).alias("kind"), "read_id", "ok", F.col("version").cast("bigint").alias("version"), F.col("ttl").cast("bigint").alias("ttl"))
    return gone.unionByName(asked)


def cache_stream(stream: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Label, version served and age of every read of a stream of ``events``, as the batch model gives
    them where events of an address arrive in the order of their times."""
    configure(stream.sparkSession)
    mode = "None" if forget_ms is None else "ProcessingTime"
    return stream.groupBy("uri").transformWithStateInPandas(CacheMachine(forget_ms), OUTPUT, "Append", mode)
