"""What the operators of this subpackage share: tables, the shared folder, materialised steps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..shared import purge, remove, settle, shared_dir, shared_path  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: list[str] = []
_caches: list[Callable[[], None]] = []


def forgets(release: Callable[[], None]) -> None:
    """Register what frees a module's caches in a worker."""
    _caches.append(release)


def hold(kind: str) -> None:
    """Say at the start of a task what its caches are for; others' caches are freed.

    Python workers outlive stages, and the caches of several operators together would not fit.
    """
    if _held == [kind]:
        return
    if _held:
        for release in _caches:
            release()
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # give the memory back to the system
    _held[:] = [kind]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage whose Arrow batches are 4 MB at most, unless the session says otherwise, and
    whose executors have this package.

    By default a batch has up to 64 MB of texts, on both sides of each worker's socket.
    """

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        if spark.conf.get(_BATCH, None) in ("64MB", "67108864", "67108864b"):
            spark.conf.set(_BATCH, "4m")
        return query(spark, *args)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, kind: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that a worker holds few texts as Python strings at once.

    ``kind`` names the caches that the task uses (see ``hold``).
    """
    hold(kind)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``row`` (a struct of the kept columns) and ``text``, which is null where the row carries it."""
    text = F.lit(None).cast("string") if carries(docs, keep) else F.col("text").cast("string")
    return docs.select(F.struct(*keep).alias("row"), text.alias("text"))


def carries(docs: DataFrame, keep: tuple[str, ...]) -> bool:
    return "text" in keep and docs.schema["text"].dataType.simpleString() == "string"


def texts_of(batch: pa.RecordBatch, carried: bool) -> list[str | None]:
    """The texts of a batch of ``with_text``."""
    return (batch.column(0).field("text") if carried else batch.column(1)).to_pylist()


def doc_crc(column: str = "doc_id"):
    """crc32 of a document's id as decimal text: the folds of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sha256_hex(value):
    return F.sha2(value.cast("binary"), 256)
