"""Operator 4, packing: bounded-space online best fit into fixed windows, leftovers merged at last.

Every partition keeps at most ``open_windows`` windows.  A document's ids are cut into full windows,
and its rest goes into the fullest window that holds it whole.  When none does, the fullest window
is topped up with the head of the rest and emitted, and the tail is placed in the same way.  What is
still open when a partition ends is merged in groups of about ``merge`` windows: pieces are laid end
to end and cut at window bounds, so each group pads one sequence at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import hold, settle, slices, table
from .encoding import KEPT_BYTES, WORD_BPE, library_encoder, tokenizer_path

WINDOW = 2048
OPEN_WINDOWS = 64
MERGE = 256
END_ID = 1
#: Bytes of ids in one batch of rows.
BATCH_BYTES = 4 << 20


class Packer:
    """Open windows of one partition, ordered by fill.  Pieces are (tag, start, length)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, int]] = []  # (fill, number), ascending
        self.held: dict[int, list[tuple[object, int, int]]] = {}
        self.count = 0

    def number(self) -> int:
        self.count += 1
        return self.count - 1

    def add(self, tag: object, total: int) -> Iterator[tuple[int, list[tuple[object, int, int]]]]:
        """Place ``total`` ids of ``tag``; yields every window that becomes full."""
        at = 0
        while total - at >= self.window:
            yield self.number(), [(tag, at, self.window)]
            at += self.window
        while at < total:
            need = total - at
            i = bisect_left(self.open, (self.window - need + 1, -1)) - 1
            if i < 0:
                if len(self.open) < self.most:
                    number = self.number()
                    self.held[number] = [(tag, at, need)]
                    insort(self.open, (need, number))
                    return
                fill, number = self.open.pop()
                self.held[number].append((tag, at, self.window - fill))
                at += self.window - fill
                yield number, self.held.pop(number)
                continue
            fill, number = self.open.pop(i)
            self.held[number].append((tag, at, need))
            if fill + need == self.window:
                yield number, self.held.pop(number)
            else:
                insort(self.open, (fill + need, number))
            return

    def rest(self) -> Iterator[tuple[int, list[tuple[object, int, int]]]]:
        for _, number in self.open:
            yield number, self.held[number]
        self.open, self.held = [], {}


_FIELDS = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open")


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int, open_windows: int, kept_bytes: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    hold(tokenizer)
    base = TaskContext.get().partitionId() << 32
    encoder, packer = library_encoder(tokenizer, False, kept_bytes), Packer(window, open_windows)
    end = end_id.to_bytes(4, "little")
    types = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    out: list[list] = [[] for _ in _FIELDS]
    size = 0

    def lay(number: int, pieces: list, is_open: bool) -> int:
        offset = 0
        for (doc, ids, first, total), start, length in pieces:
            for column, v in zip(out, (doc, first + start, ids[4 * start : 4 * (start + length)], total, base + number, offset, is_open)):
                column.append(v)
            offset += length
        return 4 * offset

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], list(_FIELDS))
        for column in out:
            column.clear()
        return made

    for batch in slices(batches, kind=tokenizer):
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
            ids += end
            total = len(ids) // 4
            # full windows go out at once; only the rest, less than a window, is held
            cut = total - total % window
            whole = [(packer.number(), [((doc, ids, 0, total), at, window)]) for at in range(0, cut, window)]
            rest = packer.add((doc, ids[4 * cut :], cut, total), total - cut)
            for number, pieces in chain(whole, rest):
                size += lay(number, pieces, False)
                if size >= BATCH_BYTES:
                    yield flush()
                    size = 0
    for number, pieces in packer.rest():
        lay(number, pieces, True)
    yield flush()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge: int = MERGE,
    kept_bytes: int = KEPT_BYTES,
) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``window`` ids.

    Returns a row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids are
    unsigned 32-bit little-endian.  ``kept_bytes`` bounds what a worker remembers.
    A null or empty text is one piece of the end id; null and
    repeated doc_ids are packed like any other (each row by itself); an empty table gives no rows;
    other columns are not read.
    """
    field = docs.schema["doc_id"]
    kind, arrow = field.dataType.simpleString(), to_arrow_type(field.dataType)
    rows = settle(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            lambda it: _pack(it, tokenizer, end_id, window, open_windows, kept_bytes, arrow),
            f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean",
        ),
        "packed",
    ).withColumn("length", (F.length("ids") / 4).cast("long"))
    done = rows.where(~F.col("open")).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    # leftovers: open_windows of a partition at most, merged in groups of about `merge` windows
    left = rows.where("open").drop("open")
    groups = max(1, -(-left.where("offset = 0").count() // merge))
    place = Window.partitionBy("_group").orderBy("sequence_id", "offset").rowsBetween(Window.unboundedPreceding, -1)
    laid = left.withColumn("_group", F.pmod(F.hash("sequence_id"), F.lit(groups)).cast("long")).withColumn(
        "_at", F.coalesce(F.sum("length").over(place), F.lit(0))
    )
    first, last = F.floor(F.col("_at") / window), F.floor((F.col("_at") + F.col("length") - 1) / window)
    cut = laid.withColumn("_w", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_at"), F.col("_w") * window)
    high = F.least(F.col("_at") + F.col("length"), (F.col("_w") + 1) * window)
    merged = cut.withColumn("_low", low).withColumn("_len", high - low).select(
        "doc_id",
        (F.col("start") + F.col("_low") - F.col("_at")).alias("start"),
        F.col("_len").alias("length"),
        F.substring("ids", (4 * (F.col("_low") - F.col("_at")) + 1).cast("int"), (4 * F.col("_len")).cast("int")).alias("ids"),
        "doc_tokens",
        F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftleft(F.col("_group"), 32)).bitwiseOR(F.col("_w")).alias("sequence_id"),
        (F.col("_low") - F.col("_w") * window).alias("offset"),
    )
    return done.unionByName(merged)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
