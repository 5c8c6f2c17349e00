from logweave.plans import bases as B
from logweave.streaming.apply import apply_stream

SF = "/root/testdata/sf0.001"
COLUMNS = ["shard", "log_index", "key", "op", "has_expected", "expected", "request_id"]


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive out of order, and the query is stopped and started again between them."""
    batch = B.results(spark, SF)
    want = sorted((r.shard, r.log_index, r.anchor, r.status, r.version) for r in batch.collect())
    rows = B.cmds(spark, SF).select(*COLUMNS)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = rows.schema
    for low, high in ((100, 200), (0, 100), (200, 10**6)):
        rows.where((rows.log_index > low) & (rows.log_index <= high)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = apply_stream(stream, B.DEDUP).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted((r.shard, r.log_index, r.anchor, r.status, r.version) for r in spark.read.parquet(out).collect())
    assert got == want


def test_invalidation_sink(spark):
    from logweave.streaming.sinks import invalidate, with_retries

    calls, pauses = [], []

    def purge(paths):
        calls.append(sorted(paths))
        if len(calls) < 3:
            raise OSError("busy")

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "path string")
    invalidate(with_retries(purge, sleep=pauses.append))(rows, 0)
    assert calls == [["a", "b"]] * 3 and pauses == [0.1, 0.2]
    calls.clear()
    import pytest

    with pytest.raises(OSError, match="busy"):
        invalidate(purge, per_call=1)(rows, 1)
    assert len(calls) == 2


def test_invalidation_from_executors(spark, tmp_path):
    import pytest

    from logweave.streaming.sinks import invalidate_from_executors

    folder = str(tmp_path)

    def purge(paths):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(paths))

    rows = spark.createDataFrame([(f"p{i % 50}",) for i in range(200)] + [(None,)], "path string")
    invalidate_from_executors(purge, per_call=7)(rows, 0)
    calls = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert sorted(x for c in calls for x in c) == sorted(f"p{i}" for i in range(50)) and max(map(len, calls)) <= 7

    def refuse(paths):
        raise OSError("busy")

    with pytest.raises(Exception, match="busy"):
        invalidate_from_executors(refuse)(rows, 1)


class Value:
    """State of one key, for machines that are fed by hand."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    """Timer values and an expired timer at a time."""

    def __init__(self, at):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: at


def test_cache_entries_are_forgotten_by_timers():
    import pandas as pd

    from logweave.streaming.cache import CacheMachine

    machine, handle = CacheMachine(1000), Handle()
    machine.init(handle)

    def read(t, now):
        rows = pd.DataFrame([(t, 1, t, True, 4, 1)], columns=["t", "kind", "read_id", "ok", "version", "ttl"])
        return [r.label for made in machine.handleInputRows(("u",), iter([rows]), At(now)) for r in made.itertuples()]

    assert read(0, 50) == ["Miss"] and read(500, 60) == ["Hit"] and read(2000, 900) == ["RefreshHit"]
    assert handle.timers == [1050, 1900]
    assert [len(x) for x in machine.handleExpiredTimer(("u",), At(1050), At(1050))] == [0] and machine.entry.exists()
    list(machine.handleExpiredTimer(("u",), At(1900), At(1900)))
    assert not machine.entry.exists() and read(2500, 2000) == ["Miss"]


def test_small_bounds_equal_batch(spark, tmp_path, monkeypatch):
    """Early rows that go to state, outcomes given on in parts: a machine fed by hand."""
    import pandas as pd

    from logweave.streaming import apply

    monkeypatch.setattr(apply, "EARLY", 3)
    monkeypatch.setattr(apply, "GIVEN_ON", 5)

    rows = sorted((r.log_index, r.shard, r.key, r.op, r.has_expected, r.expected, r.request_id) for r in B.cmds(spark, SF).where("shard = 0 AND log_index <= 120").collect())
    want = {r.log_index: (r.anchor, r.status, r.version) for r in B.results(spark, SF).where("shard = 0 AND log_index <= 120").collect()}
    machine = apply.ShardMachine(B.DEDUP)
    machine.init(Handle())
    import random

    shuffled = rows[40:] + rows[:40]
    random.Random(1).shuffle(shuffled)
    got, most = {}, 0
    for part in (shuffled[:70], shuffled[70:]):
        frames = [pd.DataFrame(part[i : i + 9], columns=["log_index", "shard", "key", "op", "has_expected", "expected", "request_id"]) for i in range(0, len(part), 9)]
        for made in machine.handleInputRows((0,), iter(frames), None):
            most = max(most, len(made))
            got |= {int(r.log_index): (int(r.anchor), r.status, int(r.version)) for r in made.itertuples()}
    assert got == want and not machine.pending and most <= 5 + len(rows)


def test_cache_stream_equals_batch(spark, tmp_path):
    """Events in time order over several files, the query stopped and started between them."""
    from logweave.operators.caching import cache_trace
    from logweave.plans import cache_queries as Q
    from logweave.streaming.cache import EVENTS, cache_stream, events

    w = Q.writes(spark, SF)
    reads, gone = Q.reads(spark, SF, w), Q.invalidations(w, Q.DELAY_MS)
    order = lambda rows: sorted(map(str, rows))
    want = order((r.uri, r.t, r.read_id, r.label, r.served, r.age, r.asked_origin) for r in cache_trace(reads, gone).collect())
    rows = events(reads, gone).cache()
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ends = [0, 300_000, 600_000, 10**9]
    for low, high in zip(ends, ends[1:]):
        rows.where((rows.t >= low) & (rows.t < high)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        q = cache_stream(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
    got = order((r.uri, r.t, r.read_id, r.label, r.served, r.age, r.asked_origin) for r in spark.read.parquet(out).collect())
    assert got == want and len(want) > 20
    rows.unpersist()
