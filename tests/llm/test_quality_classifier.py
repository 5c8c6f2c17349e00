import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm.common import table
from logweave.llm.quality_classifier import FEATURES, Discriminant, classify, features, op10_quality

SCHEMA = "doc_id long, text string, row string, score string, x int"


def test_difference_is_that_of_the_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + i for i in range(2)]
    model = Discriminant(np.array([200.0, 200.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), pool=0.0, ridge=0.0)
    for i in range(2):
        cov = np.cov(x[i].T, bias=True)
        d = x[0][:5] - x[i].mean(0)
        want = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
        z = (x[0][:5] - model.means[i]) / model.unit @ model.inverse[i]
        scale = np.log(model.unit).sum()
        assert -0.5 * ((z * z).sum(1) + model.logdet[i]) - scale == pytest.approx(want, rel=1e-4)


def test_flat_statistics_do_not_break_it():
    x = np.ones((10, 3))
    model = Discriminant(np.array([10.0, 10.0]), np.array([x.sum(0)] * 2), np.array([x.T @ x] * 2))
    model.fit_scale(np.ones((4, 3)), np.array([0.0, 1, 1, 1]))
    assert np.isfinite(model.score(np.zeros((2, 3)))).all()


def test_features():
    assert len(features(None)) == len(FEATURES) and np.isfinite(features("")).all() and np.isfinite(features("x " * 50_000)).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op10_quality(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    y = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    crc = lambda d: zlib.crc32(str(d).encode()) % 4
    assert all(r.held_out == (crc(d) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    held = [d for d in y if crc(d) == 2]
    good = np.array([got[d].score for d in held if y[d]])
    bad = np.array([got[d].score for d in held if not y[d]])
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    print("auc", auc, "good kept", (good >= 0.7).mean(), (good >= 0.5).mean(), "bad kept", (bad >= 0.7).mean(), (bad >= 0.5).mean())
    assert auc > 0.97 and (good >= 0.7).mean() > 0.97 and (bad >= 0.7).mean() < 0.2


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(None, "x", "", "", 1), (1, None, "", "", 1), (2, "", "", "", 1), (2, "", "", "", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = classify(docs, labels, F.lit(True)).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    assert classify(spark.createDataFrame([], SCHEMA), labels, F.lit(True)).collect() == []


def test_query_against_brute_force(spark):
    """Scores of the whole table from a model fitted with numpy, Gaussian densities written out."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    y = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = {d.doc_id: np.array(features(d.text)) for d in docs}
    ids = sorted(d for d in y if d in x)
    rows, labels = np.array([x[d] for d in ids]), np.array([y[d] for d in ids], float)
    groups = [rows[labels == k] for k in (0, 1)]
    means = [g.mean(0) for g in groups]
    scatters = [(g - m).T @ (g - m) for g, m in zip(groups, means)]
    pooled = sum(scatters) / len(rows)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    covs = []
    for g, s in zip(groups, scatters):
        own = (0.9 * s / len(g) + 0.1 * pooled) / np.outer(unit, unit)
        covs.append(0.98 * own + (0.02 * np.trace(own) / len(unit) + 1e-6) * np.eye(len(unit)))

    def density(v, k):
        z = (v - means[k]) / unit
        return -0.5 * (z @ np.linalg.solve(covs[k], z) + np.linalg.slogdet(covs[k])[1])

    squashed = lambda v: np.sign(d := density(v, 1) - density(v, 0)) * abs(d) ** 0.5
    u, w = np.array([[squashed(v), 1.0] for v in rows]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        w += np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + 1e-3 * np.eye(2), u.T @ (labels - p) - 1e-3 * w)
    got = {r.doc_id: r for r in op10_quality(spark, sf).collect()}
    for d, v in x.items():
        want = 1 / (1 + np.exp(-np.clip(squashed(v) * w[0] + w[1], -30, 30)))
        assert got[d].score == pytest.approx(want, abs=1e-5)
        assert got[d].predicted == int(got[d].score >= 0.7)
