"""Folds over strides, windows cut at gaps, as-of joins by strides and cells of ranks, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators.ranks import percentiles
from logweave.operators.sequential import anchored_window, as_of, segments
from logweave.operators.strides import max_before, min_after, scan, sum_before


def test_scans_in_two_levels(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.randrange(100)) for k in "ab" for s in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    fan = lambda fold, merge, back=False: {(r.k, r.s): r.o for r in scan(df, ["k"], "s", "v", "o", fold, merge, back, fan=8).collect()}
    small = fan(F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    least = fan(F.min, F.least, True)
    for k, s, _ in rows:
        before = [v for k2, s2, v in rows if k2 == k and s2 < s]
        after = [v for k2, s2, v in rows if k2 == k and s2 > s]
        assert small[k, s] == sum(before) and least[k, s] == min(after, default=None)
    for f in (sum_before, max_before, min_after):
        assert f(df.limit(0), [], "s", "v", "o").collect() == []


@pytest.mark.parametrize("stride", [7, 1000])
def test_segments_begin_after_gaps(spark, stride):
    rng = random.Random(stride)
    rows = sorted({(k, rng.randrange(3000)) for k in "ab" for _ in range(150)})
    got = {(r.k, r.t): r.s for r in segments(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 12, "s", stride).collect()}
    last, want = {}, {}
    for k, t in rows:
        want[k, t] = t if k not in last or t - last[k] > 12 else want[k, last[k]]
        last[k] = t
    assert got == want


def test_windows_cut_at_gaps_are_the_same(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(2000)) for k in "ab" for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t long")
    plain, cut = (sorted(map(tuple, anchored_window(df, ["k"], "t", 9, cut=c).collect())) for c in (False, True))
    assert plain == cut
    with pytest.raises(ValueError):
        anchored_window(df.withColumn("skip", F.lit(False)), ["k"], "t", 9, skip="skip", cut=True)


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_by_strides(spark, strict):
    rng = random.Random(strict)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randrange(500), i) for i in range(200)], "k string, t long, i long")
    right = spark.createDataFrame([(k, t, 10 * t) for k in "abc" for t in rng.sample(range(500), 25)], "k string, t long, v long")
    rows = [sorted(map(tuple, as_of(left, right, ["k"], "t", ["v"], strict, stride).collect())) for stride in (None, 3, 64, 10_000)]
    assert rows[0] == rows[1] == rows[2] == rows[3]
    versions = [(r.k, r.t, r.v) for r in right.collect()]
    for k, t, i, at, v in map(tuple, as_of(left, right, ["k"], "t", ["v"], strict, 64).collect()):
        want = max(((t2, v2) for k2, t2, v2 in versions if k2 == k and (t2 < t or (t2 == t and not strict))), default=(None, None))
        assert (at, v) == want


def test_percentiles_of_heavy_tails(spark):
    rng = random.Random(9)
    rows = [(g, math.exp(rng.gauss(0, 6))) for g in "ab" for _ in range(500)] + [("a", float("inf"))] * 3 + [("b", -1e300), ("b", 0.0), ("c", 5.0)] + [("c", 5.0)] * 7
    got = {r.g: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g in "abc":
        xs = sorted(v for k, v in rows if k == g)
        pick = lambda p: xs[min(len(xs) - 1, math.floor(len(xs) * p))]  # noqa: E731, B023
        assert (got[g].p0, got[g].p50, got[g].p95, got[g].p100, got[g].max, got[g].n) == (pick(0), pick(0.5), pick(0.95), pick(1.0), xs[-1], len(xs))
    assert percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p50": 0.5}).collect() == []
