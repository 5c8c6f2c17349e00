import random

import numpy as np
import pytest

from logweave.llm.common import table
from logweave.llm import near_copies
from logweave.llm.bktree import BKTree
from logweave.llm.near_copies import BANDS, RADIUS, alike, bucket_links, fingerprint, hashes, keep_one, path_links, shingles, signature

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Ids that stay, by exact Jaccard over all pairs that share a shingle."""
    sets, up, seen = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        near = {j for x in s or {None} for j in seen.get(x, ())}
        for x in s or {None}:
            seen.setdefault(x, []).append(i)
        for j in near:
            if alike(s, sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def copy_of(words, cut):
    """Words with the last ``cut`` shingles replaced: Jaccard (n - cut) / (n + cut) of n shingles."""
    return " ".join(words[: len(words) - cut] + [f"new{cut}x{i}" for i in range(cut)])


def test_shingles_and_signature():
    assert shingles("A b\nc d e f") == {b"a b c d e", b"b c d e f"} and shingles("One two") == {b"one two"}
    assert shingles(None) == shingles(" \n") == set() and alike(set(), set())
    assert len(signature("one two three four five six")[2]) == BANDS and len(signature(" ")[2]) == 0
    assert signature("One  two")[0] == signature("one two")[0]


def test_bands_meet_as_often_as_computed():
    """Rows agree with the probability of the similarity, so bands miss a pair at 0.8 with 3 in a million."""
    rng, agree, missed, pairs = random.Random(7), 0, 0, 1500
    for i in range(pairs):
        words = [f"w{rng.getrandbits(40)}" for _ in range(202)]
        a, b = (signature(x)[2] for x in (" ".join(words), copy_of(words, 22)))
        agree += int((a == b).sum())
        missed += not (a == b).any()
    assert missed == 0 and agree / (pairs * BANDS) == pytest.approx(0.8**5, abs=0.015)


@pytest.mark.parametrize("cut, jaccard, stays", [(10, 0.9, [0]), (21, 0.81, [0]), (22, 0.8, [0]), (24, 0.78, [0, 1])])
def test_known_jaccard(spark, cut, jaccard, stays):
    words = [f"w{i}" for i in range(202)]  # 198 shingles; 22 others make exactly 176 of 220
    docs = [(0, " ".join(words)), (1, copy_of(words, cut))]
    a, b = (shingles(t) for _, t in docs)
    assert round(len(a & b) / len(a | b), 2) == jaccard
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(docs, SCHEMA)).collect()) == stays


def test_chains_beyond_the_hubs(spark):
    rng, docs = random.Random(3), []
    for g in range(12):  # each step is near the one before it, the ends are far apart
        words = [f"g{g}w{i}" for i in range(150)]
        for step in range(9):
            docs.append((len(docs), " ".join(words)))
            at = step * 15
            words[at : at + 5] = [f"g{g}s{step}n{i}" for i in range(5)]
    rng.shuffle(docs)
    want = brute(docs)
    assert len(want) == 12
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(docs, SCHEMA)).collect()) == want


def test_bucket_links_compare_all_pairs():
    rng, texts = random.Random(5), []
    for g in range(40):
        words = [f"g{g % 4}w{i}" for i in range(120)]
        for _ in range(15):  # in part near copies, in part just below the threshold
            at = rng.sample(range(120), rng.randrange(1, 6))
            texts.append(" ".join(f"r{rng.random()}" if i in at else w for i, w in enumerate(words)))
    ids = list(range(len(texts)))
    links = bucket_links(ids, ids, [hashes(t) for t in texts])
    assert all(alike(shingles(texts[a]), shingles(texts[b])) for a, b in links)
    want = brute(list(zip(ids, texts)))
    assert len(want) > 4 and len(links) == len(ids) - len(want)


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    got = keep_one(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(r.doc_id for r in got) == brute([(r.doc_id, r.text) for r in rows.values()]) and all(rows[r.doc_id] == r for r in got)


def test_nulls_blanks_repeats_empty(spark):
    docs = [(4, None), (3, ""), (9, "\n "), (None, " "), (None, "only null here now"), (3, "")]
    rows = keep_one(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in rows) == [(-1, "only null here now"), (3, "")]
    assert keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def bits(a, b):
    return (a ^ b).bit_count()


def test_fingerprint_of_distinct_shingles():
    for text in ["", "one", "a b c d e f g", "word " * 300, "A b\nc d e f " * 40]:
        h = [int(x) for x in hashes(text)]
        assert fingerprint(hashes(text)) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    once, often = "a b c d e f g a b c d", "a b c d e f g " * 50  # repeats do not weigh
    assert shingles(once) == shingles(often) and signature(once)[3] == signature(often)[3] == fingerprint(hashes(once))


@pytest.mark.parametrize("common, left, right", [(4, 0, 1), (8, 1, 1), (12, 1, 2), (16, 2, 2), (48, 6, 6), (176, 22, 22), (176, 0, 44)])
def test_radius_holds_pairs_at_the_threshold(common, left, right):
    """Sets of exactly 0.8: the worst sizes differ in 12 bits of 64 on average, others in 10."""
    rng, apart = np.random.default_rng(common), []
    for _ in range(2000):
        h = np.unique(rng.integers(0, 1 << 64, common + left + right, np.uint64, endpoint=False))
        rng.shuffle(h)
        apart.append(bits(fingerprint(h[: common + left]), fingerprint(np.concatenate((h[:common], h[common + left :])))))
    assert max(apart) <= RADIUS and 8 < np.mean(apart) < 13


def test_every_link_comes_out_of_a_tree(spark):
    """A smaller radius loses just the links beyond it: there is no way around the trees."""
    docs, groups = [], 30
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(202)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, copy_of(words, 20))]
    marks = [fingerprint(hashes(t)) for _, t in docs]
    far = [bits(marks[2 * g], marks[2 * g + 1]) for g in range(groups)]
    frame = spark.createDataFrame(docs, SCHEMA)
    for radius in (0, 9, RADIUS):
        want = sorted(d for d, _ in docs if d % 2 == 0 or far[d // 2] > radius)
        assert sorted(r.doc_id for r in keep_one(frame, radius).collect()) == want
    assert 0 < sum(x <= 9 for x in far) < groups


def test_bucket_links_within_the_radius():
    rng, texts = random.Random(9), []
    for g in range(60):
        words = [f"g{g % 20}w{i}" for i in range(120)]
        texts.append(" ".join(f"r{rng.random()}" if rng.random() < 0.01 else w for w in words))
    sets, ids = [hashes(t) for t in texts], list(range(len(texts)))
    marks = [fingerprint(s) for s in sets]
    for radius in (0, 6, 12, RADIUS):
        links = bucket_links(ids, ids, sets, radius)
        near = {(a, b) for a in ids for b in ids if a < b and bits(marks[a], marks[b]) <= radius and alike(shingles(texts[a]), shingles(texts[b]))}
        assert {(min(x), max(x)) for x in links} <= near
        assert groups_of(ids, links) == groups_of(ids, near)


def groups_of(ids, links):
    up = dict(zip(ids, ids))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in ids]


def test_trees_are_searched_for_many_points_as_for_one():
    rng = random.Random(6)
    points = [rng.getrandbits(64) for _ in range(40)]
    points += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in points * 5] + [0, (1 << 64) - 1]
    tree = BKTree()
    nodes = [tree.add(p) for p in points]
    for radius in (0, 2, 9, RADIUS, 64):
        met = tree.met(np.array(points, np.uint64), radius)[:, nodes]
        assert (met == [[bits(p, q) <= radius for q in points] for p in points]).all()
        assert [sorted(tree.within(p, radius)) for p in points[:20]] == [sorted({n for n, q in zip(nodes, points) if bits(p, q) <= radius}) for p in points[:20]]
    assert BKTree().met(np.zeros(3, np.uint64), 2).shape == (3, 0) and tree.met(np.zeros(0, np.uint64), 2).shape == (0, len(tree.points))


def test_path_links():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    points = [(-i, 100, base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for i in range(300)]
    links = path_links(points)
    assert len(links) <= 2 * len(points) and all(a < b for a, b in links)
    assert {a for a, _ in links} == {-i for i in range(1, 300)}  # each meets one before it
    assert sum(b == 0 for _, b in links) == 299  # and the first
    assert path_links([(1, 100, base), (2, 79, base), (3, 80, base)]) == [(1, 3)]
    assert path_links([(1, 9, 0), (2, 9, (1 << RADIUS + 1) - 1)]) == [] and path_links([]) == []


def test_divided_trees(spark, monkeypatch):
    """Parts of a shard share its first point, and what they leave apart is compared whole."""
    monkeypatch.setattr(near_copies, "PART", 3)
    docs = []
    for g in range(3):  # chains, as above
        words = [f"g{g}w{i}" for i in range(150)]
        for step in range(9):
            docs.append((len(docs), " ".join(words)))
            words[step * 15 : step * 15 + 5] = [f"g{g}s{step}n{i}" for i in range(5)]
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(docs, SCHEMA)).collect()) == brute(docs) == [0, 9, 18]
