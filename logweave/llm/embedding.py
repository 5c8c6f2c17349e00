"""Operator 5, embedding near-dedup: an inverted multi-index, then exact cosines in double precision.

Two codebooks, one for each half of the unit vectors, span a grid of cells; the cells of each label
are its own.  A vector lives in its nearest cell and visits the cells nearest to it in the order of
the multi-sequence algorithm, as many as bring the target recall.  Of two cells the lower visits the
higher, so a pair is verified once.  Equal vectors of a label are one entry with a weight, and a
cell with many entries is divided into chunks that are visited in turn, so a task never holds more
than a chunk of members; visitors stream past them in blocks.  Tasks report link counts and a
spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import components

THRESHOLD = 0.93
RECALL = 0.99
#: Vectors on which the codebooks are fitted, at most (a codebook has half as many centroids at most,
#: which serves 130 million vectors; larger corpora take a larger sample), and vectors per cell to aim at.
SAMPLE = 8192
PER_CELL = 8
#: Members of a chunk, about, and visitors that are multiplied at once.
CHUNK = 1024
BLOCK = 1024


def unit(bodies: list[bytes], width: int) -> np.ndarray:
    """Rows of unit length; shorter vectors are padded with zeros, which changes no cosine."""
    out = np.zeros((len(bodies), width))
    for i, b in enumerate(bodies):
        v = np.frombuffer(b, "<f8")
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)  # no overflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


class MultiIndex:
    def __init__(self, halves: tuple[np.ndarray, np.ndarray], visits: int = 1) -> None:
        self.halves, self.visits = halves, visits
        self.split = halves[0].shape[1]

    @classmethod
    def fit(cls, x: np.ndarray, count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> MultiIndex:
        """Codebooks for a corpus of ``count`` vectors, and the visits that pairs at or above the
        threshold need: a stand-in partner is made for sample vectors at cosines spread over
        [threshold, 1], and the visits cover ``recall`` of those partners' cells."""
        k = int(min(max(4, len(x) // 2), max(4, round((count / PER_CELL) ** 0.5))))
        split = x.shape[1] // 2
        index = cls((kmeans(x[:, :split], k), kmeans(x[:, split:], k)))
        rng = np.random.default_rng(6)
        a = x[rng.permutation(len(x))[:1024]]
        noise = rng.normal(size=a.shape)
        noise -= (noise * a).sum(1, keepdims=True) * a
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        cos = np.linspace(threshold, 1, len(a))[:, None]
        first, second = index.distances(a)
        c1, c2 = (d.argmin(axis=1) for d in index.distances(cos * a + np.sqrt(1 - cos**2) * noise))
        own = first[np.arange(len(a)), c1] + second[np.arange(len(a)), c2]
        rank = np.array([(np.add.outer(p, q) < s).sum() + 1 for p, q, s in zip(first, second, own)])
        index.visits = int(np.quantile(rank, recall, method="higher"))
        return index

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.split], self.halves[0]), squared(x[:, self.split :], self.halves[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and the cells that it visits, nearest first.

        In the order of the multi-sequence traversal, the pair of an i-th and a j-th nearest
        centroid comes after i * j others at least, so only pairs with i * j <= visits can be
        among the first visits; those are ranked by their sums.
        """
        first, second = self.distances(x)
        k2, n = second.shape[1], min(self.visits, first.shape[1] * second.shape[1])
        o1, o2 = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        grid = [(i, j) for i in range(min(n, first.shape[1])) for j in range(min(n // (i + 1), second.shape[1]))]
        i, j = np.array(grid).T
        d1, d2 = np.take_along_axis(first, o1, 1), np.take_along_axis(second, o2, 1)
        sums = d1[:, i] + d2[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, :n]
        visited = np.take_along_axis(o1[:, i] * k2 + o2[:, j], order, 1)
        return o1[:, 0] * k2 + o2[:, 0], visited


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = []
        for v in batch.column(2).to_pylist():
            body = None
            if v and None not in v:
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    body = x.tobytes()
            bodies.append(body)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["vec_id", "label", "body"])


def _place(batches: Iterator[pa.RecordBatch], index: MultiIndex, width: int, step: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            own, visited = index.cells(unit(part.column(2).to_pylist(), width))
            later = [v[v > c] for v, c in zip(visited, own)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(own, pa.int64()), pa.array(later, pa.list_(pa.int64()))],
                ["entry", "label", "body", "weight", "cell", "visits"],
            )


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, cell, chunk), members of a group first; reports (a, b, n)."""
    names = ["a", "b", "n"]
    key, members = None, []
    links: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def count(x, xi, xw, y, yi, yw, same):
        hits = x @ y.T >= threshold
        if same:
            np.fill_diagonal(hits, False)
        for k, n in zip(xi, hits @ yw):
            if n:
                links[k] = links.get(k, 0) + int(n)
        if not same:
            for k, n in zip(yi, xw @ hits):
                if n:
                    links[k] = links.get(k, 0) + int(n)
        # a spanning forest of this block: one link for every two groups that meet
        shift = 0 if same else len(xi)
        group = np.arange(shift + len(yi))
        for r in np.flatnonzero(hits.any(axis=1)):
            columns = np.flatnonzero(hits[r])
            met, where = np.unique(group[shift + columns], return_index=True)
            for g, c in zip(met, columns[where]):
                if g != group[r]:
                    out.append((int(xi[r]), int(yi[c])))
                    group[group == g] = group[r]

    def report():
        a, b = zip(*out) if out else ((), ())
        made = pa.RecordBatch.from_arrays(
            [pa.array([*a, *links], pa.int64()), pa.array([*b, *[None] * len(links)], pa.int64()), pa.array([*[0] * len(a), *links.values()], pa.int64())], names
        )
        links.clear()
        out.clear()
        return made

    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
        visitor, entry, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        bodies = batch.column(6)
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at] and visitor[to] == visitor[at] and to - at < BLOCK:
                to += 1
            if keys[at] != key:
                key, members = keys[at], []
            xi, xw = entry[at:to], weight[at:to]
            if not visitor[at]:
                x = unit(bodies.slice(at, to - at).to_pylist(), width)
                for y, yi, yw in members:
                    count(x, xi, xw, y, yi, yw, False)
                count(x, xi, xw, x, xi, xw, True)
                members.append((x, xi, xw))
            elif members:
                x = unit(bodies.slice(at, to - at).to_pylist(), width)
                for y, yi, yw in members:
                    count(x, xi, xw, y, yi, yw, False)
            at = to
            if len(links) + len(out) > 20_000:  # counts add up, so a group may be reported in parts
                yield report()
    yield report()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label, ...)``.

    Vectors with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: no links, their own component, kept.  Vectors of other lengths
    never link.  Equal vectors of a label all link.  Rows with a null vec_id link like others but
    lend no id; alone they get a null component and are kept.  Repeated rows are vectors of their
    own that share an id.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = settle(
        vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(_prepare, f"vec_id {kind}, label string, body binary")
        # vectors of different lengths never meet
        .withColumn("label", F.when(F.col("label").isNotNull(), F.concat(F.length("body"), F.lit(":"), "label"))),
        "vectors",
    )
    valid = rows.where("label IS NOT NULL AND body IS NOT NULL")
    entries = settle(
        valid.groupBy("label", "body").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("entry", F.monotonically_increasing_id()),
        "entries",
    )
    size = entries.agg(F.count("*").alias("n"), F.max(F.length("body")).alias("w")).first()
    if size.n:
        width = size.w // 8
        # a bounded sample in hash order
        drawn = [bytes(r.body) for r in entries.select("body").orderBy(F.xxhash64("body", "label")).limit(sample).collect()]
        index = MultiIndex.fit(unit(drawn, width), size.n, threshold, recall)
        placed = settle(
            entries.select("entry", "label", "body", "weight").mapInArrow(
                lambda it: _place(it, index, width), "entry long, label string, body binary, weight long, cell long, visits array<long>"
            ),
            "placed",
        )
        cells = placed.groupBy("label", "cell").agg(F.count("*").alias("n")).select("label", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
        cells = settle(cells, "cells")
        with_chunk = placed.join(cells, ["label", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int"))
        with_chunk = settle(with_chunk, "chunked")
        member = with_chunk.select("label", "cell", "chunk", F.lit(False).alias("visitor"), "entry", "weight", "body")
        columns = ["label", "cell", "chunk", F.lit(True).alias("visitor"), "entry", "weight", "body"]
        own = with_chunk.where("chunk + 1 < chunks").withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))).select(*columns)
        abroad = (
            with_chunk.select("label", F.explode("visits").alias("cell"), "entry", "weight", "body")
            .join(cells, ["label", "cell"])  # cells that hold nothing are not visited
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(*columns)
        )
        # visitors of one member's chunk only meet that chunk
        found = settle(
            member.unionByName(own)
            .unionByName(abroad)
            .repartition("label", "cell", "chunk")
            .sortWithinPartitions("label", "cell", "chunk", "visitor")
            .mapInArrow(lambda it: _verify(it, width, threshold), "a long, b long, n long"),
            "vector-links",
        )
    else:
        found = spark.createDataFrame([], "a long, b long, n long")
    roots = components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "entry")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    rooted = entries.join(counts, "entry", "left").join(roots, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    named = rooted.join(least, "root").select(
        "label", "body", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = valid.join(named, ["label", "body"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("label IS NULL OR body IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reach GROUP BY vec_id"""
