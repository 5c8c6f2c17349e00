import random

import numpy as np
import xxhash

from logweave.llm.bktree import BKTree, tree_links
from logweave.llm.components import components
from logweave.llm.common import table
from logweave.llm.simhash import fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    """{doc_id: least reachable doc_id} from (doc_id, text)."""
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            up[top(i)] = top(i + 1 + j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_fingerprints():
    for text in ["", None, " \n\t", "One", "one TWO", "Ünd É three four", "a\x0bb\x0cc d e f", "word " * 300]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_tree_finds_all_within():
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(200)]
    points += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in points]
    tree = BKTree()
    nodes = {p: tree.add(p) for p in points}
    for p in points[:80]:
        assert sorted(tree.within(p, 2)) == sorted({n for q, n in nodes.items() if (p ^ q).bit_count() <= 2})


def test_tree_links_span():
    chain = [0, 3, 15, 63, 255, 7 << 40]
    assert len(tree_links(chain, 2)) == 4


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300) if i % 40] + [(1000, 2000 + i) for i in range(500)] + [(5, 5), (None, 3)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(found[2000 + i] == 1000 for i in range(500)) and found[1000] == 1000
    assert all(found[a] == found[b] for a, b in links if a is not None and a != b)
    assert len({found[i] for i in range(1, 301)}) == 8 and all(r <= n for n, r in found.items())
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert sum(d != c for d, c in want.items()) > 50


def test_links_by_few_bits(spark):
    base = " ".join(f"w{i % 61}x{i * i % 89}" for i in range(900))
    docs = [(i, base + f" tail{i}", "x", "y") for i in range(40)] + [(90, "short"), (91, "SHORT")]
    docs = [(*d, "x", "y")[:4] for d in docs]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute([d[:2] for d in docs])
    assert len(set(got.values())) < 20


def test_nulls_blanks_repeats_empty(spark):
    docs = [(4, None, "", ""), (3, "", "", ""), (9, "\n ", "", ""), (None, " ", "", ""), (None, "only null here now", "", ""), (3, "", "", "")]
    rows = near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (4, 3), (9, 3)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    docs = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, "")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in docs], SCHEMA)).collect()}
    assert got == brute(docs) and got[4] == 3
