import pytest
from pyspark.sql import functions as F

from logweave.operators import commands as C
from logweave.operators.workload import parse_mix, workload
from logweave.plans import bases as B
from logweave.plans.telemetry_queries import parse_lines
from logweave.sources import snapshots, telemetry_files as T

SF = "/root/testdata/sf0.001"


def test_mix():
    assert parse_mix("get=80, put=15,delete=5") == [("get", 0.8), ("put", 0.95), ("delete", 1.0)]
    with pytest.raises(ValueError):
        parse_mix("")


def test_workload_shares(spark):
    w = workload(spark, 40_000, 100, "get=75,put=25", seed=3, partitions=4)
    n = {r.op: r["count"] for r in w.groupBy("op").count().collect()}
    assert abs(n["get"] / 40_000 - 0.75) < 0.02 and n.keys() == {"get", "put"}
    assert w.select("key").distinct().count() == 100
    assert w.exceptAll(workload(spark, 40_000, 100, "get=75,put=25", seed=3, partitions=4)).count() == 0


@pytest.mark.parametrize("keys,s", [(50, 1.1), (20_000, 1.2), (20_000, 1.0)])
def test_zipf(spark, keys, s):
    n = 60_000
    got = {r.key: r["count"] / n for r in workload(spark, n, keys, "get=1", zipf=s, partitions=4).groupBy("key").count().collect()}
    total = sum((r + 1) ** -s for r in range(keys))
    for rank in (0, 1, 9):
        assert abs(got[f"task:{rank}:status"] - (rank + 1) ** -s / total) < 0.01
    beyond = sum(v for k, v in got.items() if int(k.split(":")[1]) >= 2000)
    assert abs(beyond - sum((r + 1) ** -s for r in range(2000, keys)) / total) < 0.01


def test_runs_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [("local-a", 1, 10.0, 5, 0, 0.5, {"get": (1.0, 2.0, 3.0, 4.0, 5)}, 3, 4, 0, 0.0, None), ("local-a", 2, 10.0, 6, 1, 0.5, None, 0, 0, 0, 0.0, None), ("b", 3, 1.0, 1, 0, 1.0, None, 0, 0, 0, 0.0, None)]
    for r in rows:
        T.append_runs(spark.createDataFrame([r], T.RUN_SCHEMA), path)
    assert not any('"stale_reads"' in line.value for line in spark.read.text(path).collect())
    runs = T.read_runs(spark, path)
    assert sorted((r.name, r.clients, r.stale_reads) for r in runs.collect()) == [("b", 3, 0), ("local-a", 1, 0), ("local-a", 2, 0)]
    assert {r.name: r.clients for r in T.latest_runs(runs, "clients", "local-").collect()} == {"a": 2, "b": 3}
    assert {(r.name, r.clients): r.hit_ratio for r in T.hit_and_stale_ratios(runs).collect()}[("local-a", 1)] == 0.75


def test_metrics_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([('up{node="a",zone="x y"} 1',), ("# TYPE up gauge",), ("total 2.5",)], "line string")
    T.write_metrics(lines, str(tmp_path / "m"))
    got = {r.name: (r.labels, r.value) for r in parse_lines(T.read_metrics(spark, str(tmp_path / "m"))).collect()}
    assert got == {"up": ({"node": "a", "zone": "x y"}, 1.0), "total": ({}, 2.5)}


def test_batches(spark):
    rows = T.batches(spark.range(45).withColumn("k", F.lit(1)), ["k"], "id")
    assert sorted(r["count"] for r in rows.groupBy("batch").count().collect()) == [5, 20, 20]


def test_snapshot_files(spark, tmp_path):
    at, path = 150, str(tmp_path / "snap")
    anchored = B.anchored(spark, SF).persist()
    first = C.state(C.fold(C.executed(anchored).where(F.col("log_index") <= at)))
    snapshots.write_snapshot(first, anchored, path, at, B.DEDUP)
    records, requests = snapshots.read_snapshot(spark, path)
    assert records.count() == first.count() and requests.count() > 0
    resumed = C.resume(records, C.executed(anchored).where(F.col("log_index") > at))
    whole = C.fold(C.executed(anchored)).where(F.col("log_index") > at)
    pick = lambda df: sorted((r.shard, r.log_index, r.status, r.version) for r in df.collect())
    assert pick(resumed) == pick(whole)
    anchored.unpersist()
