import pytest

from logweave import shared


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    """What ``shared_dir`` asks a session."""

    def __init__(self, master, **values):
        self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})
        self.sparkContext = self
        self.master, self.applicationId = master, "app"

    def getCheckpointDir(self):
        return None


def test_a_cluster_names_its_folder():
    assert shared.shared_dir(Session("yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(master))
    assert shared.shared_dir(Session("local[2]")).startswith("file:///")


def test_write_whole(tmp_path):
    shared.write_whole(f"file://{tmp_path}/x", b"one")
    shared.write_whole(f"{tmp_path}/x", b"two", 3)
    assert (tmp_path / "x").read_bytes() == b"two" and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_release_keeps_what_is_still_read(spark):
    import os

    here = lambda df: [f.removeprefix("file://") for f in df.inputFiles()]
    outside = shared.settle(spark.range(3), "outside")
    with shared.recording():
        first, second = shared.settle(spark.range(4), "one"), shared.settle(spark.range(5), "two")
    files = here(first) + here(second)
    shared.release(spark, first.select("id"))
    assert first.count() == 4 and outside.count() == 3
    assert [os.path.exists(f) for f in files] == [True] * len(here(first)) + [False] * (len(files) - len(here(first)))
    shared.release(spark)
    assert not any(map(os.path.exists, files)) and outside.count() == 3
