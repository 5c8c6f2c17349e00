import pytest
from pyspark.sql import functions as F

from logweave.operators import logs as L
from logweave.operators.caching import cache_trace, coalesce_invalidations


def test_replay_overwrites_the_tail(spark):
    rows = [(i, i, 1) for i in range(1, 11)] + [(11, 6, 2), (12, 7, 2)]
    got = L.replay(spark.createDataFrame(rows, "pos long, idx long, term long"), stride=4).orderBy("idx").collect()
    assert [(r.idx, r.term) for r in got] == [(i, 1) for i in range(1, 6)] + [(6, 2), (7, 2)]


@pytest.mark.parametrize("s", [1, 2, 3, 100])
def test_gaps(spark, s):
    rows = spark.createDataFrame([(1,), (2,), (5,), (6,)], "idx long")
    assert [(r.idx, r.previous) for r in L.gaps(rows, stride=s).collect()] == [(5, 2)]


def test_quorum(spark):
    for matches, want in (([5, 9, 7], 7), ([1, 2, 3, 4], 2), ([4], 4), ([3, 8, 9, 1, 5], 5)):
        assert spark.range(1).select(L.quorum_index(F.array(*map(F.lit, matches))).alias("x")).first().x == want


READS = "uri string, t long, read_id long, ok boolean, version long, ttl int"


def labels(spark, reads, gone=()):
    made = cache_trace(spark.createDataFrame([("u", *r) for r in reads], READS), spark.createDataFrame([("u", t) for t in gone], "uri string, t long"))
    return [(r.label, r.served, r.age) for r in made.orderBy("t").collect()]


def test_ttl_bound_is_strict(spark):
    assert labels(spark, [(0, 1, True, 1, 5), (4999, 2, True, 1, 5), (5000, 3, True, 1, 5), (9999, 4, True, 2, 5), (10_000, 5, True, 2, 5)]) == [
        ("Miss", 1, 0), ("Hit", 1, 4), ("RefreshHit", 1, 0), ("Hit", 1, 4), ("Miss", 2, 0)]


def test_refusals_leave_the_old_entry(spark):
    got = labels(spark, [(0, 1, True, 1, 1), (2000, 2, False, None, 1), (3000, 3, True, 1, 1)])
    assert got == [("Miss", 1, 0), ("Miss", None, None), ("RefreshHit", 1, 0)]


def test_no_answer_serves_the_old_entry(spark):
    got = labels(spark, [(0, 1, None, None, 1), (10, 2, True, 1, 1), (500, 3, None, None, 1), (5000, 4, None, None, 1)])
    assert got == [("Error", None, None), ("Miss", 1, 0), ("Hit", 1, 0), ("Stale", 1, 4)]


def test_invalidation_drops(spark):
    assert labels(spark, [(0, 1, True, 1, 60), (50, 2, True, 2, 60), (70, 3, True, 2, 60)], [40])[1:] == [("Miss", 2, 0), ("Hit", 2, 0)]
    assert [x[0] for x in labels(spark, [(0, 1, True, 1, 60), (40, 2, True, 1, 60)], [40])] == ["Miss", "Miss"]


def test_batches(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 50, "b"), (0, 30, "a"), (0, 51, "c")], "queue int, t long, path string")
    got = sorted((r.batch, r.paths, r.requests) for r in coalesce_invalidations(rows).collect())
    assert got == [(0, ["a", "b"], 3), (51, ["c"], 1)]


def test_percentiles_by_rank(spark):
    from logweave.operators.ranks import percentiles

    rows = [(g, float((i * 37) % n)) for g, n in (("a", 100), ("b", 1), ("c", 7)) for i in range(n)] + [("d", 5.0)] * 9
    got = {r.g: (r.p50, r.p99, r.max, r.n) for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for g in "abcd":
        xs = sorted(v for k, v in rows if k == g)
        assert got[g] == (*[xs[min(len(xs) - 1, int(len(xs) * p))] for p in (0.5, 0.99)], xs[-1], len(xs))
