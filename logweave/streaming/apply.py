"""The command log as a stream: one stateful machine a shard, with the batch operators' rules.

Commands may arrive out of order across files: a shard holds them back until its log is contiguous.
State is a map of keys, a map of remembered requests and the next expected index, kept in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "shard int, log_index long, key string, op string, anchor long, status string, version long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["shard", "log_index", "key", "op", "anchor", "status", "version"]
#: Early rows that wait in memory, and outcomes that are collected before they are given on.
EARLY, GIVEN_ON = 20_000, 10_000


class ShardMachine(StatefulProcessor):
    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "idx long")
        self.pending = handle.getMapState("pending", "idx long", "key string, op string, has_expected boolean, expected long, request_id string")
        self.keys = handle.getMapState("keys", "key string", "version long, live boolean")
        self.requests = handle.getMapState("requests", "id string", "anchor long, status string, version long")
        # remembered requests by anchor, so that old ones can be dropped
        self.order = handle.getMapState("order", "anchor long", "id string")
        self.oldest = handle.getValueState("oldest", "idx long")
        #: how many rows wait in ``pending``
        self.stored = handle.getValueState("stored", "n long")

    def _apply(self, idx: int, key: str, op: str, has_expected: bool, expected: int, request: str):
        if request and self.requests.containsKey((request,)):
            anchor, status, version = self.requests.getValue((request,))
            if idx - anchor <= self.window:
                return anchor, status, version
        version, live = self.keys.getValue((key,)) if self.keys.containsKey((key,)) else (0, False)
        seen = version if live else 0
        if has_expected and expected != seen:
            status, out = "MISMATCH", seen
        elif op == "DELETE" and not live:
            status, out = "NOT_FOUND", 0
        else:
            status, out = "OK", version + 1
            self.keys.updateValue((key,), (out, op == "PUT"))
        if request:
            self.requests.updateValue((request,), (idx, status, out))
            self.order.updateValue((idx,), (request,))
        return idx, status, out

    def _forget(self, idx: int) -> None:
        at = self.oldest.get()[0] if self.oldest.exists() else 1
        while idx - at > self.window:
            if self.order.containsKey((at,)):
                (request,) = self.order.getValue((at,))
                self.order.removeKey((at,))
                if self.requests.containsKey((request,)) and self.requests.getValue((request,))[0] == at:
                    self.requests.removeKey((request,))
            at += 1
        self.oldest.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows in order are applied as they come; early ones wait, the first in memory, others in state.

        Neither the waiting rows in memory nor the outcomes that are not yet given on exceed a bound,
        however large a shard's micro-batch is.
        """
        at = self.next.get()[0] if self.next.exists() else 1
        early: dict[int, tuple] = {}
        stored = int(self.stored.get()[0]) if self.stored.exists() else 0
        out: list[tuple] = []

        def waiting(idx: int):
            nonlocal stored
            if idx in early:
                return early.pop(idx)
            if stored and self.pending.containsKey((idx,)):
                row = tuple(self.pending.getValue((idx,)))
                self.pending.removeKey((idx,))
                stored -= 1
                return row
            return None

        def store(idx: int, row: tuple) -> None:
            nonlocal stored
            stored += not self.pending.containsKey((idx,))
            self.pending.updateValue((idx,), row)

        def apply_from(row) -> None:
            nonlocal at
            while row is not None:
                anchor, status, version = self._apply(at, *row)
                out.append((key[0], at, row[0], row[1], anchor, status, version))
                at += 1
                row = waiting(at)

        apply_from(waiting(at))
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                idx, row = int(r.log_index), (r.key, r.op, bool(r.has_expected), int(r.expected), r.request_id or "")
                if idx == at:
                    apply_from(row)
                elif idx > at and (idx in early or len(early) < EARLY):
                    early[idx] = row
                elif idx > at:
                    store(idx, row)
                if len(out) >= GIVEN_ON:
                    self._forget(at)
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out.clear()
        for idx, row in early.items():
            store(idx, row)
        self.stored.update((stored,))
        self.next.update((at,))
        self._forget(at)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def apply_stream(commands: DataFrame, window: int) -> DataFrame:
    """Outcomes of a stream of commands, as the batch ``apply`` gives them, in append mode."""
    configure(commands.sparkSession)
    return commands.groupBy("shard").transformWithStateInPandas(ShardMachine(window), OUTPUT, "Append", "None")
