"""Operator 10, quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics.  Class means and covariances come from
all labelled training rows by plain sums; covariances are shrunk towards the pooled one and towards
a multiple of the identity, and factored once (Cholesky).  A document's score is a logistic function
of the difference of the classes' Mahalanobis log-densities, its two parameters fitted on a bounded
sample of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carries, doc_crc, settle, slices, table, texts_of, with_text
from .quality_rules import CLASSES, WORDS, measure

FOLDS, HELD_OUT = 4, 2
KEEP_AT = 0.7
#: Shrinkage towards the pooled covariance, and towards the identity.
POOL, RIDGE = 0.1, 0.02
#: Training rows on which the logistic scale is fitted, at most.
SCALE_ROWS = 20_000

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "stops", "quotes", "other", "newlines", "repeated", "dup_lines", "common", "variety")
_AT = {c: i for i, c in enumerate(CLASSES)}


def features(text: str | None) -> list[float]:
    """Statistics of a text, transformed towards normal shapes; defined for empty texts too."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated, classes, common = measure(text)
    words, body = max(n, 1), max(chars, 1)
    root = lambda k: (classes[_AT[k]] / body) ** 0.5
    lines = text.count("\n") + 1
    return [
        np.log1p(n),
        np.log1p(chars / words),
        (symbols / body) ** 0.5,
        root("upper"),
        root("digit"),
        root("stop"),
        root("quote"),
        root("other_ascii"),
        root("newline"),
        (repeated / words) ** 0.5,
        (dup_lines / lines) ** 0.5,
        (sum(common[:-1]) / words) ** 0.5,
        # distinct words against what a text of this length could have
        len(set(text.split())) / words,
    ]


def _features(batches: Iterator[pa.RecordBatch], carried: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features(t) for t in texts_of(batch, carried)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["row", "x"])


class Discriminant:
    """Two Gaussian classes with cached factors, and the logistic scale of their difference."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> None:
        """counts (2), sums (2, d) and products (2, d, d) of the training rows of each class."""
        self.scale = np.array([1.0, 0.0])
        self.prior = float((counts[1] + 1) / (counts.sum() + 2))
        self.fitted = bool(counts.min() >= 2)
        if not self.fitted:
            return
        means = sums / counts[:, None]
        scatter = np.array([p - n * np.outer(m, m) for p, n, m in zip(products, counts, means)])
        pooled = scatter.sum(axis=0) / counts.sum()
        self.unit = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        grid = np.outer(self.unit, self.unit)
        d = len(self.unit)
        self.means, self.inverse, self.logdet = means, [], []
        for s, n in zip(scatter, counts):
            own = ((1 - pool) * s / n + pool * pooled) / grid
            own = (1 - ridge) * own + (ridge * np.trace(own) / d + 1e-6) * np.eye(d)  # flat statistics stay invertible
            factor = np.linalg.cholesky((own + own.T) / 2)
            self.inverse.append(np.linalg.inv(factor).T)
            self.logdet.append(2 * np.log(np.diag(factor)).sum())

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        logs = []
        for m, inverse, logdet in zip(self.means, self.inverse, self.logdet):
            z = (x - m) / self.unit @ inverse
            logs.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return logs[1] - logs[0]

    def fit_scale(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
        """Logistic regression of the labels on the squashed difference (Newton steps)."""
        if not self.fitted or not len(y):
            return
        u = np.stack([squash(self.difference(x)), np.ones(len(y))], axis=1)
        w = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
            g = u.T @ (y - p) - 1e-3 * w
            h = (u * (p * (1 - p))[:, None]).T @ u + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.scale = w if w[0] > 0 else np.array([1.0, 0.0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        u = squash(self.difference(x)) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def squash(d: np.ndarray) -> np.ndarray:
    """Signed square root: far outliers of either class should not set the scale."""
    return np.sign(d) * np.sqrt(np.abs(d))


def _score(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["row", "score"])


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``row`` (a struct of the kept columns) and ``x``, written once: the texts are read once."""
    rows, carried = with_text(docs, keep), carries(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    return settle(rows.mapInArrow(lambda it: _features(it, carried), f"row {kind}, x array<double>"), "features")


def labels_of(labels: DataFrame, column: str, train: Column) -> DataFrame:
    """``doc_id, y`` of the training rows; of repeated labels the larger counts."""
    return (
        labels.where(train & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("y"))
    )


def fit(rows: DataFrame, labels: DataFrame, pool: float = POOL, ridge: float = RIDGE, scale_rows: int = SCALE_ROWS) -> Discriminant:
    """The discriminant of ``rows(row.doc_id, x)`` with ``labels(doc_id, y)``."""
    known = settle(rows.select(F.col("row.doc_id").alias("doc_id"), "x").join(labels, "doc_id").select("doc_id", "x", "y"), "training")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.col("x")[i]
    made = known.groupBy("y").agg(
        F.count("*").alias("n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("s"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("p")
    )
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in made.where("y IN (0, 1)").collect():
        counts[r.y], sums[r.y] = r.n, r.s
        for (i, j), v in zip(pairs, r.p):
            products[r.y, i, j] = products[r.y, j, i] = v
    model = Discriminant(counts, sums, products, pool, ridge)
    if model.fitted:
        drawn = known.where("y IN (0, 1)").select("x", "y").orderBy(F.xxhash64("doc_id", "x")).limit(scale_rows).collect()
        model.fit_scale(np.array([r.x for r in drawn]), np.array([r.y for r in drawn], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, train: Column, keep: tuple[str, ...] = ("doc_id",), column: str = "quality") -> DataFrame:
    """``row, score`` of every row of ``docs(doc_id, text, ...)``.

    ``train`` says which rows of ``labels(doc_id, <column>)`` may be learnt from.  Null and empty
    texts are scored by their (zero) statistics; null doc_ids are scored and never learnt from;
    repeated rows are scored each; without labels of both classes every score is the share of label
    1, 0.5 without any; an empty table gives no rows; kept columns sit in a struct, so no name can
    clash.
    """
    keep = keep if "doc_id" in keep else ("doc_id", *keep)
    rows = measured(docs, keep)
    model = fit(rows, labels_of(labels, column, train))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _score(it, model), f"row {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc() % FOLDS == HELD_OUT
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), "score", F.when(F.col("score") >= KEEP_AT, 1).otherwise(0).alias("predicted")
    ).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
