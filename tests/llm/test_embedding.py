import numpy as np

from logweave.llm.common import table
from logweave.llm.embedding import MultiIndex, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, kept int"


def brute(rows, threshold=0.93):
    ok = [(i, e, lab) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    up, n = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for lab in {x[2] for x in ok}:
        mine = [x for x in ok if x[2] == lab]
        x = np.array([e for _, e, _ in mine], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hits = x @ x.T >= threshold
        for a, b in zip(*np.nonzero(hits)):
            if a != b:
                n[mine[a][0]] += 1
                p, q = top(mine[a][0]), top(mine[b][0])
                up[max(p, q)] = min(p, q)
    return {i: (n[i], top(i)) for i, *_ in rows}


def clusters(seed=3, n=900, d=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 300):  # partners spread over the cosines, some below the threshold
        c = rng.uniform(0.9, 1)
        u = x[i] / np.linalg.norm(x[i])
        v = rng.normal(size=d)
        v -= v @ u * u
        x[300 + i] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    centre = rng.normal(size=d)
    x[600:750] = centre + 0.08 * rng.normal(size=(150, d))
    x[750:800] = x[7]
    return [(i, [float(c) for c in np.float32(v)], i % 2 if i < 300 else (i - 300) % 2 if i < 600 else 0) for i, v in enumerate(x)]


def test_against_brute_force(spark):
    rows = clusters()
    want = brute(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), chunk=40).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    alike = sum((got[i].n_links, got[i].component_id) == w for i, w in want.items())
    assert alike >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[800].n_links == want[800][0]


def test_cells_are_in_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = MultiIndex.fit(x, 400)
    index.visits = 9
    own, visited = index.cells(x)
    first, second = index.distances(x)
    for i in range(50):
        sums = np.add.outer(first[i], second[i]).ravel()
        assert np.allclose(sums[visited[i]], np.sort(sums)[:9]) and visited[i][0] == own[i]


def test_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors).collect()} == want


def test_nulls_repeats_empty(spark):
    nan = float("nan")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [1.0, 0.0], None), (6, [], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0),
            (8, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0], 1)]
    got = near_vectors(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)
    assert seen == [(0, 3, 7, False), *[(i, 0, i, True) for i in range(1, 7)], (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
