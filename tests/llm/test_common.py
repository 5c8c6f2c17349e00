import os

import pyarrow as pa

from logweave import shared
from logweave.llm import common


def test_settled_rows_stay_the_same(spark):
    from pyspark.sql import functions as F

    df = common.settle(spark.range(50).withColumn("r", F.rand()), "random")
    assert sorted(df.collect()) == sorted(df.collect()) and df.schema.simpleString() == "struct<id:bigint,r:double>"
    assert common.settle(spark.range(0), "none").count() == 0


def test_purge_deletes_what_was_settled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert common.settle(spark.range(3), "x").count() == 3
    assert os.listdir(tmp_path / spark.sparkContext.applicationId)
    common.purge(spark)
    assert not (tmp_path / spark.sparkContext.applicationId).exists()


def test_shared_folder_is_that_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert common.shared_dir(spark) == (named or common.shared_dir(spark)).rstrip("/")


def test_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(10))})
    assert [b.num_rows for b in common.slices(iter([batch, batch.slice(0, 0)]), 4)] == [4, 4, 2]
