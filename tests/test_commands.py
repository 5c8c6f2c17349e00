import random

import pytest

from logweave.operators import commands as C
from logweave.operators.sequential import anchored_window, as_of, dense_index

SCHEMA = "shard int, log_index long, op string, key string, has_expected boolean, expected long, request_id string, cacheable boolean, ttl int, ts_ms long, event_id long"


def log(spark, *rows):
    """(op, key, expected or None, request id, index or None)"""
    made, at = [], 0
    for op, key, expected, request, *index in rows:
        at = index[0] if index else at + 1
        made.append((0, at, op, key, expected is not None, expected or 0, request, True, 30, at * 10, at))
    return spark.createDataFrame(made, SCHEMA)


def outcomes(spark, *rows, window=100_000):
    return [(r.status, r.version) for r in C.apply(log(spark, *rows), window).orderBy("log_index").collect()]


def test_put_delete_delete(spark):
    assert outcomes(spark, ("PUT", "k", None, ""), ("DELETE", "k", None, ""), ("DELETE", "k", None, "")) == [("OK", 1), ("OK", 2), ("NOT_FOUND", 0)]


def test_version_survives_delete(spark):
    got = outcomes(spark, ("PUT", "k", None, ""), ("DELETE", "k", None, ""), ("PUT", "k", None, ""), ("PUT", "k", 1, ""))
    assert got == [("OK", 1), ("OK", 2), ("OK", 3), ("MISMATCH", 3)]


def test_create_if_absent(spark):
    got = outcomes(spark, *[(op, "k", e, "") for op, e in (("PUT", 0), ("PUT", 0), ("DELETE", None), ("PUT", 2), ("PUT", 0))])
    assert got == [("OK", 1), ("MISMATCH", 1), ("OK", 2), ("MISMATCH", 0), ("OK", 3)]


def test_failed_comparison_changes_nothing(spark):
    rows = log(spark, ("PUT", "k", None, ""), ("PUT", "k", 1, ""), ("PUT", "k", 1, ""))
    r = C.state(C.fold(C.executed(C.with_anchors(rows)))).first()
    assert (r.version, r.value, r.deleted) == (2, 2, False)


def test_duplicate_request(spark):
    assert outcomes(spark, ("PUT", "k", 0, "r1"), ("PUT", "k", 0, "r1")) == [("OK", 1), ("OK", 1)]


def test_mismatch_is_remembered_and_empty_ids_are_not(spark):
    got = outcomes(spark, ("PUT", "k", 5, "a"), ("PUT", "k", None, ""), ("PUT", "k", 5, "a"), ("PUT", "k", None, ""))
    assert got == [("MISMATCH", 0), ("OK", 1), ("MISMATCH", 0), ("OK", 2)]


def test_window_edge(spark):
    got = outcomes(spark, ("PUT", "k", None, "id", 1), ("PUT", "k", None, "id", 11), ("PUT", "k", None, "id", 12), window=10)
    assert got == [("OK", 1), ("OK", 1), ("OK", 2)]


def test_snapshot_round_trip(spark):
    rows = log(spark, ("PUT", "a", None, "r1"), ("PUT", "b", None, "r2"), ("DELETE", "b", None, "r3"), ("PUT", "b", None, "r4"), ("PUT", "a", None, "r1"))
    a = C.with_anchors(rows)
    first = C.state(C.fold(C.executed(a).where("log_index <= 3")))
    tail = {r.log_index: (r.status, r.version) for r in C.resume(first, C.executed(a).where("log_index > 3")).collect()}
    assert tail == {4: ("OK", 3)}


def test_unknown_operation(spark):
    with pytest.raises(Exception, match="unknown operation"):
        C.fold(log(spark, ("MERGE", "k", None, ""))).collect()


def simulate(rows, window):
    seen, keys, out = {}, {}, []
    for r in rows:
        if r[6] and r[6] in seen and r[1] - seen[r[6]][0] <= window:
            out.append((r[1], *seen[r[6]]))
            continue
        version, live = keys.get(r[3], (0, False))
        visible = version if live else 0
        if r[4] and r[5] != visible:
            res = ("MISMATCH", visible)
        elif r[2] == "DELETE" and not live:
            res = ("NOT_FOUND", 0)
        else:
            keys[r[3]] = (version + 1, r[2] == "PUT")
            res = ("OK", version + 1)
        if r[6]:
            seen[r[6]] = (r[1], *res)
        out.append((r[1], r[1], *res))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_simulator(spark, seed):
    rng = random.Random(seed)
    rows = [
        (0, i, rng.choice(["PUT", "PUT", "DELETE"]), f"k{rng.randrange(6)}", rng.random() < 0.4, rng.randrange(5), rng.choice(["", f"r{rng.randrange(30)}"]), True, 1, i, i)
        for i in sorted(rng.sample(range(1, 4000), 900))
    ]
    got = C.apply(spark.createDataFrame(rows, SCHEMA), 40).collect()
    assert sorted((r.log_index, r.anchor, r.status, r.version) for r in got) == simulate(rows, 40)


def test_closed_form_equals_the_fold(spark):
    rng = random.Random(9)
    rows = log(spark, *[(rng.choice(["PUT", "DELETE"]), f"k{rng.randrange(9)}", None, "") for _ in range(500)])
    pick = lambda df: sorted((r.log_index, r.status, r.version) for r in df.collect())
    assert pick(C.unconditional_versions(rows)) == pick(C.fold(rows))


def test_anchored_window(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 5, 10, 11, 20, 21, 30)], "k string, t long")
    got = lambda **a: [r.anchor for r in anchored_window(rows, ["k"], "t", 10, **a).orderBy("t").collect()]
    assert got() == [0, 0, 0, 11, 11, 11, 30] and got(strict=True) == [0, 0, 10, 10, 20, 20, 30]


def test_dense_index(spark):
    rows = spark.createDataFrame([(i % 2, i * 3) for i in range(200)], "k int, o long")
    got = sorted((r.k, r.o, r.n) for r in dense_index(rows, ["k"], "o", "n", stride=50).collect())
    assert [n for k, _, n in got if k == 0] == list(range(1, 101)) and [n for k, _, n in got if k == 1] == list(range(1, 101))


def test_as_of_is_strictly_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 9, 3)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 20), ("a", 7, 30)], "k string, t long, v int")
    assert sorted((r.id, r.v, r.t_right) for r in as_of(left, right, ["k"], "t", ["v"]).collect() if r.k == "a") == [(1, 10, 1), (2, 20, 5)]
    assert [r.v for r in as_of(left, right, ["k"], "t", ["v"], strict=False).collect() if r.id == 1] == [20]
    assert [r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect() if r.k == "b"] == [None]
