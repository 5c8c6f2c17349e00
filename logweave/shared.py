"""The folder that driver and executors share, steps written to it, and files on mounted and remote stores."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder (one machine, so it is shared); a
    cluster has none that could be guessed, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, keeps a step that is read more than once from running twice, and
    fixes the rows (and any generated ids) for every later reader, so a lost executor costs
    only the tasks that it held.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    if _recording:
        _recorded.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_recorded: list[str] = []
_recording: list[bool] = []


@contextmanager
def recording() -> Iterator[None]:
    """What is settled in here may be deleted by a later ``release``."""
    _recording.append(True)
    try:
        yield
    finally:
        _recording.pop()


def release(spark: SparkSession, *used: DataFrame) -> None:
    """Delete recorded steps, but for those that ``used`` still read.

    For the beginning of a stage whose input has been written: nothing else needs the steps before.
    """
    files = [f for df in used for f in df.inputFiles()]
    for path in _recorded[:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            _recorded.remove(path)
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all that it holds, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Delete all that this application has settled; frames that read it are of no use afterwards."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def mounted(path: str) -> str | None:
    """The path if it is on a mounted file system."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def open_file(path: str, mode: str):
    """A file to write, or to read by position; other stores go through Arrow's file systems."""
    if (local := mounted(path)) is not None:
        return open(local, mode)
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_output_stream(inner) if "w" in mode else fs.open_input_file(inner)


def make_folder(folder: str) -> None:
    if (local := mounted(folder)) is not None:
        os.makedirs(local, exist_ok=True)


def rename(old: str, new: str) -> None:
    """Give a complete file its name; on mounted file systems an older one is replaced at once."""
    if (local := mounted(old)) is not None:
        os.replace(local, mounted(new))
    else:
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(old)
        fs.move(inner, FileSystem.from_uri(new)[1])


def write_whole(path: str, body: bytes, attempt: int = 0) -> None:
    """Write a file that appears under its name only when complete, so a repeated task replaces it."""
    folder, name = path.rsplit("/", 1)
    temp = f"{folder}/.{name}.{attempt}"
    with open_file(temp, "wb") as f:
        f.write(body)
    rename(temp, path)
