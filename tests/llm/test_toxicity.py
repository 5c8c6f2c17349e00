import itertools
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm.common import table
from logweave.llm.toxicity import WIDTH, Field, lowered, op3_toxicity, ragged, tag, train
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, score string, spans int"


def field(moves=((0.3, -0.7), (-0.2, 0.9)), bias=-1.1):
    f = Field(["idiot$", "lowe", "clown$", "clow"])
    f.weights = np.array([2.5, 1.5, 0.4, 0.3, 0.8, -0.6])
    f.bias, f.moves = bias, np.array(moves)
    return f


def brute(f, text):
    """Marginals of every token by summing over all tag sequences."""
    tokens = text.split()
    score = [f.bias] * len(tokens)
    for i, _, _, ks in f.spots(text):
        score[i] += sum(f.weights[k] for k in ks)
    total, each = 0.0, np.zeros(len(tokens))
    for tags in itertools.product((0, 1), repeat=len(tokens)):
        w = np.exp(sum(s for s, t in zip(score, tags) if t) + sum(f.moves[a][b] for a, b in zip(tags, tags[1:])))
        total += w
        each += w * np.array(tags)
    return each / total


@pytest.mark.parametrize("text", ["idiot", "an idiot here", "a b c loweish, d\ne Idiot. clown f", "clowning x x x x x", "x  idiot  idiot", "xidiot idiots lowe"])
def test_marginals_are_exact(text):
    f = field()
    spots, got = f.judge(text)
    want = brute(f, text)
    assert got == pytest.approx([want[i] for i, *_ in spots])


def test_spots():
    f = field()
    text = "An IDIOT! xlowe, Loweisch—clown"
    # own features, then those of the context: 4 after, 5 before a token with own ones
    assert [(i, text[s:e], ks) for i, s, e, ks in f.spots(text)] == [(0, "An", [5]), (1, "IDIOT", [0]), (2, "xlowe", [4, 5]), (3, "Loweisch—clown", [1, 2, 3])]
    assert [(i, text2[s:e]) for text2 in ["a  --\n\n(idiot) "] for i, s, e, _ in f.spots(text2)] == [(1, "--"), (2, "idiot")]
    assert lowered("İdiot") == "İdiot" and len(lowered("aİb")) == 3
    assert f.spots(None) == [] and Field([]).judge("idiot") == ([], [])


def test_long_text_is_stable():
    f = field()
    m = f.judge("word " * 20_000 + "idiot" + " word" * 20_000)[1]
    assert len(m) == 3 and all(0 < p < 1 for p in m) and max(m) == m[1]
    start = time.process_time()
    assert len(f.judge("idiot-" * 100_000)[1]) == 1 and len(f.judge("idiot " * 100_000)[1]) == 100_000
    assert time.process_time() - start < 30


def test_labels_of_tokens():
    f = field()
    (near, tags), *_ = f.windows("a b idiot you big clown c d e f", True)
    assert tags == [0, 0, 0, 1, 1, 1, 1] and near[WIDTH // 2] == [0]
    assert all(not any(t) for _, t in f.windows("a b idiot you big clown c d e f", False))
    far = f.windows("idiot a b c d clown", True)
    assert far[0][1][WIDTH // 2 :] == [1, 0, 0, 0]
    assert len(f.windows(None, True)) == 1


def test_fit_learns_tags():
    rng = np.random.default_rng(0)
    f = Field(["bad$", "odd$"])
    features = [[[int(k)] if (k := rng.integers(0, 3)) < 2 else [] for _ in range(WIDTH)] for _ in range(400)]
    tags = np.array([[int(ks == [0]) for ks in window] for window in features])
    f.fit(*ragged(pa.array(features, pa.list_(pa.list_(pa.int32())))), tags)
    assert f.weights[0] + f.bias > 2 and f.weights[1] + f.bias < -2 and (f.weights[2:] == 0).all()


def test_gradient_against_brute_force():
    """Weights of a tiny problem against a grid of tag sequences: the fit raises the exact likelihood."""
    rng = np.random.default_rng(3)
    windows = [[[int(x) for x in np.flatnonzero(rng.random(4) < 0.4)] for _ in range(WIDTH)] for _ in range(12)]
    tags = rng.integers(0, 2, (12, WIDTH))

    def likelihood(f):
        total = 0.0
        for ks, want in zip(windows, tags):
            score = [f.bias + sum(f.weights[k] for k in own) for own in ks]
            weight = lambda t: np.exp(sum(s for s, y in zip(score, t) if y) + sum(f.moves[a][b] for a, b in zip(t, t[1:])))  # noqa: E731, B023
            total += np.log(weight(want) / sum(weight(t) for t in itertools.product((0, 1), repeat=WIDTH)))
        return total / len(windows)

    f = Field(["a$", "b$"])
    before = likelihood(f)
    flat, owner = ragged(pa.array(windows, pa.list_(pa.list_(pa.int32()))))
    f.fit(flat, owner, tags, decay=0.0, rounds=400, rate=0.05)
    best = likelihood(f)
    assert best > before
    for k in range(4):  # no step along any weight does better
        for step in (-0.05, 0.05):
            f.weights[k] += step
            assert likelihood(f) <= best + 1e-4
            f.weights[k] -= step


def test_document_scores_from_marginals():
    f = field()
    f.scale = np.array([1.5, 0.7, -2.0])
    for text in ["an idiot here", "fine words", "", None, "idiot clown lowe idiot"]:
        m = brute(f, text or "") if (text or "").split() else np.zeros(0)
        spots, got = f.judge(text)
        own = [m[i] for i, *_ in spots]
        u = 1.5 * max(own, default=0.0) + 0.7 * np.log1p(sum(own)) - 2.0
        assert f.score(got) == pytest.approx(1 / (1 + np.exp(-u)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    y = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [d for d in y if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    hit = [got[d].predicted == y[d] for d in held]
    toxic = [got[d].predicted for d in held if y[d]]
    clean = [got[d].predicted for d in held if not y[d]]
    print("accuracy", np.mean(hit), "recall", np.mean(toxic), "false", np.mean(clean))
    assert np.mean(hit) > 0.97 and np.mean(toxic) > 0.86 and np.mean(clean) < 0.02
    assert any(r.spans for r in got.values())


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(None, "an idiot", "", 1), (1, None, "", 1), (2, "", "", 1), (2, "", "", 1)], SCHEMA)
    got = tag(docs, field()).collect()
    assert sorted((r.row.doc_id or 0, len(r.spans) >= 0) for r in got) == [(0, True), (1, True), (2, True), (2, True)]
    assert tag(spark.createDataFrame([], SCHEMA), field()).collect() == []
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    f = train(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in tag(docs, f).collect())
    assert train(spark.createDataFrame([], SCHEMA), labels.limit(0), F.lit(True)).names == []
