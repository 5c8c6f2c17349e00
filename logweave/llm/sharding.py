"""Operator 2, sharding: minimax contiguous partition, DataFrame functions only.

Documents with equal texts form a group that no cut may split.  A group that alone exceeds an even
share of the bytes (one text with very many copies) has a shard of its own, as otherwise its size
would be the capacity of all; such groups come first in the order, all others follow by the hash of
their text.  The smallest capacity for which a greedy left-to-right fill needs no more than
``shards`` shards is found by binary search, and the cuts are made within it.

The capacity is exact over groups, yet the driver never sees more sizes than about ``atoms`` at once.
It first sees the sums of runs of groups with equal leading hash bits.  With them as atoms the search
gives an upper bound of the capacity, an even share gives a lower one, and between the two bounds the
k-th cut of a greedy fill stays within a window of the order.  Only runs inside windows are divided
by further hash bits and summed again, until windows hold single groups.  Cuts elsewhere fall
between runs, which are between groups.

Slots within a shard are ``base of the cell + rank in the cell``, a cell being the groups of equal
leading hash bits within a shard.  A cell of more than ``part_rows`` rows, or of more than a small share
of all rows (a text with very many copies), is numbered in parts by row, so no task ever ranks a hot
group alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

SHARDS = 40
#: Sizes that the driver sees at once, about; cells of slots are as many.
ATOMS = 1 << 16
#: Rows of a cell that one task ranks, at most: so many, or this share of all rows.
PART_ROWS = 1 << 20
PART_SHARE = 512
OVERHEAD = 16
#: Bits of a text's hash that order the groups.
KEY_BITS = 60


def fits(prefix: list[int], capacity: int, shards: int, at: int = 0) -> list[int] | None:
    """Greedy check from cell ``at``: the ends of the shards, or None if over ``shards``.

    ``prefix`` are the running sums of the cell sizes, with 0 first.
    """
    cuts, last = [], len(prefix) - 1
    while at < last:
        if len(cuts) == shards:
            return None
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end <= at:
            return None
        cuts.append(end)
        at = end
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of a contiguous partition, and cuts within it.

    Of the cuts that the capacity allows, each is the nearest to an even share of what is left, so
    the last shards do not run empty.  The last cut is ``len(sizes)``.
    """
    if not sizes:
        return 0, []
    prefix = [0, *accumulate(sizes)]
    low, high = max(max(sizes), -(-prefix[-1] // shards)), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    cuts, at, last = [], 0, len(sizes)
    for left in range(shards, 0, -1):
        if at == last:
            break
        most = bisect_right(prefix, prefix[at] + low) - 1
        share = prefix[at] + (prefix[-1] - prefix[at]) / left
        end = bisect_right(prefix, share)
        if end > at + 1 and share - prefix[end - 1] < prefix[min(end, last)] - share:
            end -= 1
        end = min(most, max(end, at + 1), last)
        while left > 1 and end < most and fits(prefix, low, left - 1, end) is None:
            end += 1
        at = last if left == 1 else end
        cuts.append(at)
    return low, cuts


def apart(sizes: list[int], shards: int, total: int | None = None) -> list[int]:
    """Places of the groups that exceed an even share: each has a shard of its own.

    ``sizes`` hold the largest groups at least, ``total`` is the size of all.
    """
    out: list[int] = []
    rest, order = sum(sizes) if total is None else total, sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if len(out) + 1 >= shards or sizes[i] * (shards - len(out)) <= rest:
            break
        out.append(i)
        rest -= sizes[i]
    return sorted(out)


class Atoms:
    """Runs of groups in key order: ``(first key, bits of the run's prefix, bytes, groups)``."""

    def __init__(self, runs: list[tuple[int, int, int, int]], shards: int, largest: int) -> None:
        self.runs = sorted(runs)
        self.sizes = [n for _, _, n, _ in self.runs]
        self.prefix = [0, *accumulate(self.sizes)]
        self.shards = shards
        total = self.prefix[-1]
        self.least = max(largest, -(-total // shards)) if total else 0

    def upper(self) -> int:
        """The capacity if runs were atoms: no less than the groups need."""
        return minimax_cuts(self.sizes, self.shards)[0]

    def open_ranges(self) -> list[tuple[int, int]]:
        """First and last keys of the stretches within reach of a greedy cut that hold a run of several
        groups: one for each cut at most."""
        prefix, most, at, out = self.prefix, self.upper(), 0, []
        for k in range(1, self.shards):
            # a fill by whole runs and the least capacity cuts before the k-th cut, k full shards end after it
            at = max(at, bisect_right(prefix, prefix[at] + self.least) - 1)
            end = min(bisect_left(prefix, k * most), len(self.runs))
            several = [i for i in range(at, end) if self.runs[i][3] > 1 and self.runs[i][1] < KEY_BITS]
            if several:
                first, last = self.runs[several[0]][0], self._last_key(several[-1])
                if out and first <= out[-1][1] + 1:
                    out[-1] = (out[-1][0], max(last, out[-1][1]))
                else:
                    out.append((first, last))
        return out

    def _last_key(self, i: int) -> int:
        key, bits, *_ = self.runs[i]
        return key + (1 << (KEY_BITS - bits)) - 1


def _runs(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    shift = KEY_BITS - bits
    made = groups.groupBy(F.shiftright("key", shift).alias("run")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
    return [(r.run << shift, bits, r.bytes, r.groups) for r in made.collect()]


def plan(groups: DataFrame, shards: int = SHARDS, atoms: int = ATOMS) -> tuple[list[int], list[int], int]:
    """Keys of the giants, first keys of the other shards but the first, and the capacity of those.

    ``groups(key, bytes, rows)`` has a row for each key.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # more giants than shards cannot be, and the largest other group comes right after them
    top = [(r.key, r.bytes) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards + 1).collect()]
    giants = [top[i][0] for i in apart([n for _, n in top], shards, total)]
    largest = max((n for k, n in top if k not in giants), default=0)
    others = groups.where(~F.col("key").isin(giants)) if giants else groups
    bits = max(1, min(KEY_BITS, atoms.bit_length() - 1))
    found = Atoms(_runs(others, bits), shards - len(giants), largest)
    while ranges := found.open_ranges():
        inside = lambda key: any(a <= key <= b for a, b in ranges)  # noqa: E731, B023
        opened = [r for r in found.runs if inside(r[0])]
        several = [r for r in opened if r[3] > 1]
        # so many further bits that about ``atoms`` sizes come back, one at least
        bits = min(KEY_BITS, max(r[1] for r in several) + max(1, (atoms // len(several)).bit_length() - 1))
        within = reduce(or_, [F.col("key").between(a, b) for a, b in ranges])
        found = Atoms([*(r for r in found.runs if not inside(r[0])), *_runs(others.where(within), bits)], shards - len(giants), largest)
    capacity, cuts = minimax_cuts(found.sizes, found.shards)
    return giants, [found.runs[c][0] for c in cuts[:-1]], capacity


def shard(docs: DataFrame, shards: int = SHARDS, atoms: int = ATOMS, part_rows: int = PART_ROWS) -> DataFrame:
    """Assign every row of ``docs(doc_id, text, ...)`` to a shard and a slot.

    Returns ``doc_id, size, text_crc32, cell, shard, slot``; other columns are not read, so their names
    can't clash.

    A null text counts as no bytes and groups with the empty text; very long texts count whole; a null
    doc_id is numbered first in its cell; repeated rows each get a slot of their own; an empty table
    gives no rows; a group larger than the mean shard gets a shard that is larger, as it may not be cut.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    bits = max(1, min(KEY_BITS, atoms.bit_length() - 1))
    rows = settle(
        docs.select("doc_id", body.alias("_b"))
        .select(
            "doc_id",
            (F.length("_b").cast("long") + OVERHEAD).alias("size"),
            F.crc32("_b").alias("text_crc32"),
            # the head of a 160-bit hash: equal texts share it, and order is even
            F.conv(F.substring(F.sha1("_b"), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        )
        .withColumn("cell", F.shiftright("key", KEY_BITS - bits).cast("int"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "shard-rows",
    )
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    giants, starts, _ = plan(groups, shards, atoms)

    shard_of = F.lit(len(giants))
    for first in starts:
        shard_of = shard_of + (F.col("key") >= first).cast("int")
    for i, key in enumerate(giants):
        shard_of = F.when(F.col("key") == key, i).otherwise(shard_of)
    part_rows = max(1, min(part_rows, (groups.agg(F.sum("rows")).first()[0] or 0) // PART_SHARE))
    # at most as many cells as atoms: a few bytes each
    cells = groups.groupBy(F.shiftright("key", KEY_BITS - bits).cast("int").alias("cell")).agg(F.ceil(F.sum("rows") / part_rows).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    placed = rows.join(F.broadcast(cells), "cell").withColumn("part", part).withColumn("shard", shard_of)

    # a row for each cell and part; running sums restart in every shard
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("shard", "cell", "part")
        .agg(F.count("*").alias("_n"))
        .withColumn("base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("shard", "cell", "part", "base")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("doc_id", "key", "uid"))
    return (
        placed.withColumn("_r", rank)
        .join(bases, ["shard", "cell", "part"])
        .select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("base") + F.col("_r") - 1).cast("long").alias("slot"))
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )
