"""Operator 6, SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius by BK-trees.

Equal fingerprints are collapsed first, so copies cost one tree node.  Two fingerprints that differ
in at most r bits agree on all but r of any set of blocks of bits; with r + 4 blocks every choice
of 4 gives a shard key, and each linked pair meets in at least one shard.  A shard fixes about two
thirds of the bits, so its tree has a bound that does not depend on the corpus (2^22 points for
r = 2) and no shard can be hot for any other reason than truly close fingerprints.  Every shard's
tree is built and searched in the task that holds it: all the trees together grow with the corpus,
so they are not broadcast.  A tree reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import spread, tree_links
from .common import settle, slices, table
from .components import components

SHINGLE = 3
RADIUS = 2
AGREE = 4
SEED = 42
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, as an unsigned 64-bit number; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] or ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(body[s:e], SEED) for s, e in zip(starts[at : at + STEP], last[at : at + STEP])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        marks = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _fingerprints(it, shingle), f"doc_id {kind}, fp long"
    )


def shard_keys(fp, radius: int, agree: int = AGREE) -> list:
    """One long per choice of ``agree`` of ``radius + agree`` blocks: the choice and their bits."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(n), agree)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return keys


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp) sorted by key; shards of one point are passed over."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(ends - starts > 1):
            out += tree_links(spread(fps[starts[i] : ends[i]]).tolist(), radius)
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held and held[0][0][-1] == keys[-1]:
            held.append((keys, fps))  # the whole batch belongs to the shard that is open
            continue
        held.append((keys, fps))
        keys, fps = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from links(keys[:cut], fps[:cut])
        held = [(keys[cut:], fps[cut:])]
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that span every group of the fingerprints ``distinct(fp)``."""
    sharded = distinct.select("fp", F.explode(F.array(*shard_keys(F.col("fp"), radius))).alias("key")).select("key", "fp")
    # equal keys meet; rows of a key are sorted together, and keys never fill more than one tree
    return sharded.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: _search(it, radius), "a long, b long")


def groups(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` for every fingerprint of ``marks(doc_id, fp)``.

    Roots name components whose rows may all lack a doc_id; component_id is their least doc_id.
    """
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp"), radius), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over links, the row's own included.  Null, empty
    and blank texts have fingerprint 0 and link like any other; rows with a null doc_id take part
    and get the smallest other id of their component, null if there is none; repeated rows stay,
    with one component; an empty table gives no rows; other columns are not read.
    """
    marks = settle(fingerprints(docs, shingle), "fingerprints")
    return marks.join(groups(marks, radius).drop("root"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
