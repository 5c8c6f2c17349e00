import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from hypothesis import given
from hypothesis import strategies as st

from logweave.llm.common import table
from logweave.llm.sharding import KEY_BITS, Atoms, apart, fits, minimax_cuts, op2_sharding, plan, shard

SCHEMA = "doc_id long, text string, cell int, shard string"


def least_capacity(sizes, shards):
    """By trying every capacity."""
    for c in range(max(sizes), sum(sizes) + 1):
        used, room = 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c


@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 6))
def test_capacity_is_the_least(sizes, shards):
    capacity, cuts = minimax_cuts(sizes, shards)
    assert capacity == least_capacity(sizes, shards)
    assert cuts[-1] == len(sizes) and len(cuts) <= shards and cuts == sorted(set(cuts))
    assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)) <= capacity


def test_no_sizes():
    assert minimax_cuts([], 3) == (0, []) and apart([], 3) == []


def test_no_shard_runs_empty():
    assert minimax_cuts([5, 1, 1, 1, 1, 1], 4)[1] == [1, 3, 5, 6]
    assert len(minimax_cuts([10] + [1] * 60, 8)[1]) == 8


def test_giants_stand_apart():
    assert apart([1, 50, 1, 1, 20, 1], 4) == [1, 4] and apart([3, 3, 3], 3) == [] and apart([100], 1) == []


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    by_id = {d[0]: d[1] for d in docs}
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        body = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        homes[body].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    return {k: sum(r.size for r in rows if r.shard == k) for k in slots}


def test_equal_sizes(spark):
    docs = [(i, "x" * (i % 97) + f" {i}", 1, "a") for i in range(3000)]
    sizes = check(shard(spark.createDataFrame(docs, SCHEMA), 10).collect(), docs, 10)
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 10


def test_hot_group_nulls_ties(spark):
    docs = [(i, "the same text", 0, "") for i in range(900)] + [(1000 + i, f"own {i}", 0, "") for i in range(900)]
    docs += [(None, None, 0, ""), (None, "", 0, ""), (7000, None, None, None), (7001, "é" * 5000, 0, "")]
    rows = shard(spark.createDataFrame(docs, SCHEMA), 4).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in rows if r.size == 16}) == 1
    assert len({r.shard for r in rows if r.doc_id is not None and r.doc_id < 900}) == 1


def test_repeated_rows(spark):
    docs = [(5, "same", 0, "")] * 50
    assert sorted(r.slot for r in shard(spark.createDataFrame(docs, SCHEMA), 4).collect()) == list(range(50))


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA), 4).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_same_shards_for_any_layout(spark, parts):
    docs = [(i, f"text {i % 40} " * (i % 11), 0, "") for i in range(400)]
    rows = shard(spark.createDataFrame(docs, SCHEMA).repartition(parts), 5).collect()
    assert {r.doc_id: r.shard for r in rows} == {r.doc_id: r.shard for r in shard(spark.createDataFrame(docs, SCHEMA), 5).collect()}


def group_key(text):
    return int(hashlib.sha1((text or "").encode()).hexdigest()[: KEY_BITS // 4], 16)


def brute_plan(sizes, shards):
    """Keys of the giants, the least capacity of the others and their sizes in key order."""
    rest, giants = dict(sizes), set()
    while rest and len(giants) + 1 < shards and max(rest.values()) * (shards - len(giants)) > sum(rest.values()):
        key = min(rest, key=lambda k: (-rest[k], k))
        giants.add(key)
        del rest[key]
    ordered = [rest[k] for k in sorted(rest)]
    low, high = max(ordered, default=0), sum(ordered)
    prefix = [0, *accumulate(ordered)]
    while low < high:  # every capacity from below would do as well, one by one
        middle = (low + high) // 2
        low, high = (low, middle) if fits(prefix, middle, shards - len(giants)) is not None else (middle + 1, high)
    return giants, low


@pytest.mark.parametrize("atoms, part_rows", [(4, 50), (64, 100), (1 << 16, 1 << 20)])
def test_query_has_the_least_capacity_over_groups(spark, atoms, part_rows):
    rng = random.Random(atoms)
    docs = [(i, "w" * rng.randrange(400) + f" {rng.randrange(3000)}", 1, "a") for i in range(4000)]
    docs += [(10_000 + i, "a text with a third of all rows " * 4, 1, "a") for i in range(2000)] + [(20_000, "y" * 300_000, 0, "")]
    sizes = Counter()
    for _, text, *_ in docs:
        sizes[group_key(text)] += len(text) + 16
    giants, capacity = brute_plan(sizes, 12)
    rows = shard(spark.createDataFrame(docs, SCHEMA), 12, atoms, part_rows).collect()
    made = check(rows, docs, 12)
    home = {group_key(d[1]): None for d in docs}
    text_of = {d[0]: d[1] for d in docs}
    for r in rows:
        home[group_key(text_of[r.doc_id])] = r.shard
    assert {home[k] for k in giants} == set(range(len(giants))) and len(giants) == 2
    others = [n for k, n in made.items() if k >= len(giants)]
    assert max(others) <= capacity and len(others) <= 12 - len(giants)
    # contiguous in key order
    order = [home[k] for k in sorted(home) if k not in giants]
    assert order == sorted(order)


@pytest.mark.parametrize("atoms", [2, 8, 128, 1024])
def test_plan_finds_the_least_capacity(spark, atoms):
    rng = random.Random(atoms)
    for shards in (2, 5, 9):
        sizes = {rng.randrange(1 << KEY_BITS): rng.choice([1, 5, 40, 200]) for _ in range(300)}
        groups = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], "key long, bytes long, rows long").cache()
        giants, starts, capacity = plan(groups, shards, atoms)
        assert (set(giants), capacity) == brute_plan(sizes, shards)
        groups.unpersist()


def test_only_runs_near_cuts_are_opened():
    runs = [(i << (KEY_BITS - 10), 10, 1000 + i % 7, 50) for i in range(1 << 10)]
    opened = sum((b - a + 1) >> (KEY_BITS - 10) for a, b in Atoms(runs, 8, 40).open_ranges())
    assert 0 < opened < 60
    # runs of several groups here and there: still one stretch a cut at most
    mixed = [(i << (KEY_BITS - 12), 12, rng.randrange(20, 4000), rng.choice([1, 1, 1, 2])) for rng in [random.Random(1)] for i in range(1 << 12)]
    assert 0 < len(Atoms(mixed, 40, 4000).open_ranges()) <= 39


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    made = check(op2_sharding(spark, sf).collect(), docs, 40)
    sizes = Counter()
    for _, text in docs:
        sizes[group_key(text)] += len((text or "").encode()) + 16
    giants, capacity = brute_plan(sizes, 40)
    assert max(n for k, n in made.items() if k >= len(giants)) <= capacity
