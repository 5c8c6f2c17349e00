"""Operator 3, toxicity: a linear-chain conditional random field over tokens, aggregated to documents.

Tokens are parted by white space.  A token's own features are whole words and word beginnings that
occur in toxic training documents far more often than in others; two features of its context say that
the token before it, and the token after it, has such features.  The token labels follow from the
document labels: in a toxic document the tokens with own features are toxic, and so are the few tokens
between two of them (a toxic phrase is one span); all other tokens are not.  So a word of the lexicon
in a clean document is labelled clean, and a word outside it can be toxic.  The field (two tags,
transitions, a weight per feature) is trained on windows of tokens of a bounded sample; training and
scoring read tokens the same way.

A document's tokens without any feature all have the same potentials, so a stretch of g of them is
the g-th power of one 2 x 2 matrix and exact forward-backward passes cost only as many steps as
there are tokens with features.  The marginals of those tokens give the offending offsets, and
their largest value and sum give the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carries, doc_crc, forgets, settle, slices, table, texts_of, with_text

FOLDS, HELD_OUT = 5, 0
REJECT_AT = 0.5
#: Bounds of the labelled rows that the field is fitted on: documents of each label, windows of tokens.
SAMPLE_DOCS = 3000
MAX_WINDOWS = 60_000
#: A feature's least share of toxic sample documents, least number of them, and least ratio of rates.
#: The share bounds the features: there are at most 100 times as many as a sample document has on average.
MIN_SHARE, MIN_DOCS, MIN_RATIO = 0.01, 4, 20.0
#: Tokens between two with own features are labelled like them up to this distance of the two.
MAX_GAP = 3
PREFIXES = (3, 4, 5, 6, 7, 8)
WIDTH = 7
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_LETTER = re.compile(r"\w")


def lowered(text: str | None) -> str:
    """Lower case with the offsets of the text."""
    low = (text or "").lower()
    return low if text is None or len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_features(word: str) -> list[str]:
    """The word itself (with its end marked) and its beginnings."""
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, kind="toxicity"):
        found, marks = [], []
        for text in batch.column(0).to_pylist():
            words = set(_WORD.findall(lowered(text)))
            found.append(sorted({f for w in words for f in word_features(w)}))
            # copies of a document mostly agree on the least hash of their words, and count once
            marks.append(min((zlib.crc32(w.encode()) for w in words), default=0))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["y", "mark", "found"])


def token_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens begin and end."""
    return tuple(np.fromiter((at(m) for m in _TOKEN.finditer(text)), np.int64) for at in (re.Match.start, re.Match.end))


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation around it, whole if there is nothing else."""
    if (m := _LETTER.search(text, start, end)) is None:
        return start, end
    while not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    return m.start(), end


class Field:
    """Features by name, their weights, the bias and transitions; picklable.

    Feature numbers from ``len(names)`` on are those of the context.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.before, self.after = len(names), len(names) + 1
        self.weights = np.zeros(len(names) + 2)
        self.bias, self.moves = 0.0, np.zeros((2, 2))
        self.scale = np.zeros(3)

    def read(self, text: str | None) -> tuple[list[tuple[int, int, int, list[int]]], int]:
        """(token index, start, end, features) of the tokens that have features, and the number of tokens."""
        if not self.names:
            return [], 0
        low = lowered(text)
        found: dict[int, set[int]] = {}
        for last, (k, length, whole) in _automaton(tuple(self.names)).iter(low):
            start = last - length + 1
            if start and low[start - 1].isalpha():
                continue
            if whole and last + 1 < len(low) and low[last + 1].isalpha():
                continue
            found.setdefault(start, set()).add(k)
        if not found:
            return [], 0
        starts, ends = token_bounds(low)
        own: dict[int, set[int]] = {}
        places = sorted(found)
        for place, i in zip(places, np.searchsorted(starts, places, "right") - 1):
            own.setdefault(int(i), set()).update(found[place])
        out = []
        for i in sorted({j for i in own for j in (i - 1, i, i + 1) if 0 <= j < len(starts)}):
            ks = sorted(own.get(i, ())) + [self.before] * (i - 1 in own) + [self.after] * (i + 1 in own)
            out.append((i, *core(low, int(starts[i]), int(ends[i])), ks))
        return out, len(starts)

    def spots(self, text: str | None) -> list[tuple[int, int, int, list[int]]]:
        return self.read(text)[0]

    def windows(self, text: str | None, toxic: bool) -> list[tuple[list[list[int]], list[int]]]:
        """Features and tags of the tokens around each token with own features, and of the middle."""
        spots, tokens = self.read(text)
        features = {i: ks for i, _, _, ks in spots}
        own = [i for i, ks in features.items() if ks[0] < len(self.names)]
        marked = set(own) | {k for i, j in zip(own, own[1:]) if j - i <= MAX_GAP for k in range(i, j)}
        half = WIDTH // 2
        out = []
        for centre in [*own, tokens // 2]:
            around = range(centre - half, centre + half + 1)
            out.append(([features.get(i, []) for i in around], [int(toxic and i in marked) for i in around]))
        return out

    def marginals(self, spots: list[tuple[int, int, int, list[int]]], tokens: int) -> list[float]:
        """P(tag = toxic) of each spot: forward-backward over the whole document."""
        if not spots:
            return []
        m = np.exp(self.moves)
        back = m * np.array([1.0, np.exp(self.bias)])  # into a token without features
        into = [np.array([1.0, np.exp(min(30.0, self.bias + sum(self.weights[k] for k in ks)))]) for *_, ks in spots]
        power = _Powers(back)
        first = spots[0][0]
        # the first token has no transition into it
        a = into[0] if first == 0 else (np.array([1.0, np.exp(self.bias)]) @ power(first - 1)) @ (m * into[0])
        forward = [a / a.sum()]
        for p, q, e in zip(spots, spots[1:], into[1:]):
            a = forward[-1] @ power(max(0, q[0] - p[0] - 1)) @ (m * e)
            forward.append(a / a.sum())
        b = power(max(0, tokens - 1 - spots[-1][0])) @ np.ones(2)
        out = []
        for i in range(len(spots) - 1, -1, -1):
            p = forward[i] * b
            out.append(float(p[1] / p.sum()))
            if i:
                b = power(max(0, spots[i][0] - spots[i - 1][0] - 1)) @ ((m * into[i]) @ b)
                b = b / b.sum()
        return out[::-1]

    def judge(self, text: str | None) -> tuple[list[tuple[int, int, int, list[int]]], list[float]]:
        spots, tokens = self.read(text)
        return spots, self.marginals(spots, tokens)

    def score(self, marginals: list[float]) -> float:
        u = self.scale @ np.array([max(marginals, default=0.0), np.log1p(sum(marginals)), 1.0])
        return float(1 / (1 + np.exp(-np.clip(u, -30, 30))))

    def fit(self, flat: np.ndarray, owner: np.ndarray, tags: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> None:
        """Conditional log-likelihood of ``tags (n, width)``, by Adam on exact gradients.

        ``flat`` are the features of all tokens, and ``owner`` the number of the token of each.
        """
        n, width = tags.shape
        if not n:
            return
        size = len(self.weights)
        x = np.zeros(size + 1 + 4)
        mean, var = np.zeros_like(x), np.zeros_like(x)
        of_features = lambda p: np.bincount(flat, weights=p.reshape(-1)[owner], minlength=size)
        observed = np.zeros_like(x)
        observed[:size] = of_features(tags.astype(float))
        observed[size] = tags.sum()
        for i in range(2):
            for j in range(2):
                observed[size + 1 + 2 * i + j] = ((tags[:, :-1] == i) & (tags[:, 1:] == j)).sum()
        for step in range(1, rounds + 1):
            e = np.ones((n, width, 2))
            own = np.bincount(owner, weights=x[flat], minlength=n * width).reshape(n, width)
            e[:, :, 1] = np.exp(np.clip(x[size] + own, -30, 30))
            m = np.exp(x[size + 1 :].reshape(2, 2))
            f, b = np.zeros_like(e), np.ones_like(e)
            f[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, width):
                f[:, t] = f[:, t - 1] @ m * e[:, t]
                f[:, t] /= f[:, t].sum(axis=1, keepdims=True)
            for t in range(width - 2, -1, -1):
                b[:, t] = (b[:, t + 1] * e[:, t + 1]) @ m.T
                b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
            p = f * b
            p /= p.sum(axis=2, keepdims=True)
            both = f[:, :-1, :, None] * m * (e * b)[:, 1:, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            expected = np.zeros_like(x)
            expected[:size] = of_features(p[:, :, 1])
            expected[size] = p[:, :, 1].sum()
            expected[size + 1 :] = both.sum(axis=(0, 1)).reshape(-1)
            g = (observed - expected) / n - decay * x
            mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
            x = x + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        self.weights = x[:size]
        self.bias, self.moves = float(x[size]), x[size + 1 :].reshape(2, 2)

    def fit_scale(self, u: np.ndarray, y: np.ndarray, rounds: int = 40) -> None:
        """The document score: ridge logistic regression on (largest marginal, log of their sum, 1)."""
        w, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-4])
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
            h = (u * (p * (1 - p))[:, None]).T @ u + ridge
            w = w + np.clip(np.linalg.solve(h, u.T @ (y - p) - ridge @ w), -5, 5)
        self.scale = w


class _Powers:
    """Powers of a positive 2 x 2 matrix up to a factor, by squaring; kept."""

    def __init__(self, m: np.ndarray) -> None:
        self.squares, self.kept = [m / m.sum()], {0: np.eye(2)}

    def __call__(self, g: int) -> np.ndarray:
        if g not in self.kept:
            out, k, rest = np.eye(2), 0, g
            while rest:
                if k == len(self.squares):
                    s = self.squares[-1] @ self.squares[-1]
                    self.squares.append(s / s.sum())
                if rest & 1:
                    out = out @ self.squares[k]
                    out = out / out.sum()
                rest >>= 1
                k += 1
            self.kept[g] = out
        return self.kept[g]


@lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    # a word and its beginning may read the same: then only the beginning is needed
    plain = set(names)
    for k, name in enumerate(names):
        whole = name.endswith("$")
        body = name.removesuffix("$")
        if not (whole and body in plain):
            a.add_word(body, (k, len(body), whole))
    a.make_automaton()
    return a


forgets(_automaton.cache_clear)


def ragged(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` and ``owner`` of an array of windows, each a list of tokens' lists of features."""
    tokens = features.flatten()
    lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
    return tokens.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(tokens)), lengths)


_WINDOWS = pa.schema([("features", pa.list_(pa.list_(pa.int32()))), ("tags", pa.list_(pa.int32()))])


def _windows(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, kind="toxicity"):
        made = [w for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in field.windows(text, y == 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*made)) or [[], []], _WINDOWS)], schema=_WINDOWS)


def _judge(batches: Iterator[pa.RecordBatch], field: Field, carried: bool) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    for batch in slices(batches, kind="toxicity"):
        scores, spans = [], []
        for text in texts_of(batch, carried):
            spots, m = field.judge(text)
            scores.append(field.score(m))
            spans.append([{"start": s, "end": e, "p": p} for (_, s, e, _), p in zip(spots, m) if p >= 0.5])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["row", "score", "spans"])


def _marginals(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, kind="toxicity"):
        made = [field.judge(t)[1] for t in batch.column(0).to_pylist()]
        top = [[max(m), float(sum(m))] if m else [] for m in made]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(top, pa.list_(pa.float64()))], ["y", "m"])


def train(docs: DataFrame, labels: DataFrame, rows: Column, column: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on at most ``sample_docs`` documents of each label, taken in hash order."""
    known = (
        labels.where(rows & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    )
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for y in (0, 1)]
    # at most 2 * sample_docs ids
    picked = F.broadcast(ids[0].unionByName(ids[1]))
    sample = settle(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("text", "y"), "toxicity-sample")
    counted = sample.mapInArrow(_count, "y int, mark long, found array<string>")
    counted = settle(counted, "toxicity-words")
    sizes = {r.y: r.n for r in counted.select("y", "mark").distinct().groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    names = (
        counted.select("y", "mark", F.explode("found").alias("name"))
        .distinct()
        .groupBy("name")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        .where((F.col("t") >= max(MIN_DOCS, MIN_SHARE * toxic)) & (rate("t", toxic) >= MIN_RATIO * rate("c", other)))
        .orderBy(F.desc("t"), "name")
    )
    field = Field([r.name for r in names.collect()])
    if field.names:
        windows = sample.mapInArrow(lambda it: _windows(it, field), "features array<array<int>>, tags array<int>")
        drawn = windows.orderBy(F.xxhash64("features", "tags")).limit(MAX_WINDOWS).toArrow().combine_chunks()
        if drawn.num_rows:
            features, tags = (drawn.column(i).combine_chunks() for i in (0, 1))
            field.fit(*ragged(features), tags.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
    judged = sample.mapInArrow(lambda it: _marginals(it, field), "y int, m array<double>").collect()
    u = np.array([[r.m[0], np.log1p(r.m[1]), 1.0] if r.m else [0.0, 0.0, 1.0] for r in judged]).reshape(-1, 3)
    field.fit_scale(u, np.array([r.y for r in judged], float))
    return field


def tag(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the kept columns), ``score`` and ``spans(start, end, p)`` of every row.

    Spans are code points of the text.  Null and empty texts have no spans and the score of a text
    without evidence; very long texts are read whole, a step for each token with features; null and
    repeated doc_ids are scored row by row; an empty table gives no rows; kept columns sit in a struct,
    so no name can clash.
    """
    rows, carried = with_text(docs, keep), carries(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _judge(it, field, carried), f"row {kind}, score double, spans array<struct<start:bigint,end:bigint,p:double>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc() % FOLDS == HELD_OUT
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (
        tag(docs, field)
        .select(F.col("row.doc_id").alias("doc_id"), "score", "spans")
        .select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= REJECT_AT, 1).otherwise(0).alias("predicted"), "spans")
    )
