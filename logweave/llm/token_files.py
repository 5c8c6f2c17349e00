"""Operator 7, token ids as flat binary files with 64-bit document offsets, memory-mapped.

A dataset is a folder of parts in ascending doc_id order and a manifest::

    part-00000.tokens    ids, unsigned 16-bit (vocabularies up to 65,536) or 32-bit, little-endian
    part-00000.offsets   unsigned 64-bit: where each document begins in the part, and the end
    part-00000.docs      signed 64-bit doc_ids (null: the least value)
    index.json           id width, and each part's documents, tokens and bases

A document's global place is its part's base (a prefix sum over parts) plus its offset.  Rows are
dealt by ranges of doc_id and sorted within a range, each task writes one part, and a part appears
under its name only when complete, so a task that is run again replaces its own part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import make_folder, mounted, open_file, rename
from .common import hold, shared_path, slices, table
from .encoding import BYTE_BPE, library_encoder, tokenizer_path

END_ID = 2
NULL_ID = -(1 << 63)
KINDS = ("tokens", "offsets", "docs")
_META = "part int, docs long, tokens long"
#: Bytes of ids in one batch of the reader, and of 32-bit ids in one write.
READ_BYTES = 4 << 20
WRITE_BYTES = 4 << 20
#: Bytes of input that a part is made of, about, where there is more than fills the session's partitions.
PART_BYTES = 256 << 20


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int | None, kind: str):
    hold(tokenizer)
    context = TaskContext.get()
    part = context.partitionId()
    encoder = library_encoder(tokenizer, True)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    make_folder(folder)
    name = f"{folder}/part-{part:05d}"
    temp = f"{folder}/.part-{part:05d}-{context.attemptNumber()}-{context.taskAttemptId()}"
    docs = tokens = 0
    files = {k: open_file(f"{temp}.{k}", "wb") for k in KINDS}
    try:
        files["offsets"].write(np.zeros(1, "<u8").tobytes())
        for batch in slices(batches, 1024, tokenizer):
            files["docs"].write(batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            held, size = [], 0
            for n, ids in enumerate(encoder.texts(batch.column(1).to_pylist()), 1):
                held += (ids, end)
                size += len(ids)
                if size >= WRITE_BYTES or n == batch.num_rows:
                    ends = tokens + np.cumsum([(len(a) + len(b)) // 4 for a, b in zip(held[::2], held[1::2])], dtype="<u8")
                    files["tokens"].write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
                    files["offsets"].write(ends.astype("<u8").tobytes())
                    tokens, docs = int(ends[-1]), docs + len(ends)
                    held, size = [], 0
    finally:
        for f in files.values():
            f.close()
    for k in KINDS:
        rename(f"{temp}.{k}", f"{name}.{k}")
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["part", "docs", "tokens"])


def parts_for(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts that the bytes of the tables below ask for (as the planner knows them, without a pass over
    them), and no fewer than the session's shuffle partitions."""
    leaves = docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)  # sources without a size say the largest number
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // part_bytes))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, vocab: int = 50_257, parts: int | None = None) -> dict:
    """Encode ``docs(doc_id, text, ...)`` into ``folder`` (one that all executors share).

    Returns the manifest, which is also written.  Null texts count as empty (only the end id); very
    long texts are encoded in blocks; null doc_ids come first; repeated doc_ids stay, in the order of their texts' hashes; an empty table
    gives empty parts; other columns are not read.
    """
    n = parts or parts_for(docs)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
        # a doc_id that many rows share (null, say) is still dealt to many tasks
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    # one row a part
    found = sorted(dealt.mapInArrow(lambda it: _write_part(it, folder, tokenizer, end_id, kind), _META).collect())
    bases = [0, *accumulate(r.tokens for r in found)]
    firsts = [0, *accumulate(r.docs for r in found)]
    manifest = {
        "ids": kind,
        "documents": firsts[-1],
        "tokens": bases[-1],
        "parts": [{"part": r.part, "docs": r.docs, "tokens": r.tokens, "token_base": b, "doc_base": d} for r, b, d in zip(found, bases, firsts)],
    }
    make_folder(folder)
    with open_file(f"{folder}/index.json", "wb") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    with open_file(f"{folder}/index.json", "rb") as f:
        return json.loads(f.read())


class Ranged:
    """A flat array in a store that can't be mapped: stretches are read when they are asked for."""

    def __init__(self, path: str, kind: str) -> None:
        self.file, self.kind = open_file(path, "rb"), np.dtype(kind)

    def __getitem__(self, part: slice) -> np.ndarray:
        size = self.kind.itemsize
        self.file.seek(part.start * size)
        return np.frombuffer(self.file.read((part.stop - part.start) * size), self.kind)


def _mapped(path: str, kind: str, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    if (local := mounted(path)) is not None:
        return np.memmap(local, kind, "r", shape=(count,))
    return Ranged(path, kind)[0:count]


class TokenFiles:
    """A dataset opened on one machine: documents by their global number, without reading the rest."""

    def __init__(self, folder: str) -> None:
        self.folder, self.manifest = folder, read_manifest(folder)

    def __len__(self) -> int:
        return self.manifest["documents"]

    def document(self, number: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, global start and ids of the document ``number`` in order."""
        p = next(p for p in self.manifest["parts"] if p["doc_base"] <= number < p["doc_base"] + p["docs"])
        ids, offsets, tokens = _maps(self.folder, self.manifest["ids"], p)
        i = number - p["doc_base"]
        return None if ids[i] == NULL_ID else int(ids[i]), p["token_base"] + int(offsets[i]), tokens[int(offsets[i]) : int(offsets[i + 1])]


def _maps(folder: str, kind: str, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | Ranged]:
    """doc_ids, offsets and ids of a part; ids that can't be mapped are read by stretches."""
    name = f"{folder}/part-{p['part']:05d}"
    tokens = _mapped(f"{name}.tokens", kind, p["tokens"]) if mounted(name) is not None or not p["tokens"] else Ranged(f"{name}.tokens", kind)
    return _mapped(f"{name}.docs", "<i8", p["docs"]), _mapped(f"{name}.offsets", "<u8", p["docs"] + 1), tokens


def _read_part(batches: Iterator[pa.RecordBatch], folder: str, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            if not p["docs"]:
                continue
            docs, offsets, tokens = _maps(folder, kind, p)
            at = 0
            while at < p["docs"]:
                # as many whole documents as fill a batch
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + np.uint64(READ_BYTES // 4), "right")) - 1)
                low, high = int(offsets[at]), int(offsets[to])
                body = pa.py_buffer(tokens[low:high].astype("<u4").tobytes())
                cuts = ((offsets[at : to + 1] - offsets[at]) * np.uint64(4)).astype("<i4")
                ids = docs[at:to]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                        pa.array(offsets[at:to].astype(np.int64) + p["token_base"]),
                        pa.array((offsets[at + 1 : to + 1] - offsets[at:to]).astype(np.int64)),
                        pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), body]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                at = to


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids are unsigned 32-bit little-endian."""
    manifest = read_manifest(folder)
    kind, schema = manifest["ids"], "doc_id long, start long, n_tokens long, ids binary"
    parts = [(p["part"], p["docs"], p["tokens"], p["token_base"]) for p in manifest["parts"]]
    # one task a part, which gets its own entry of the manifest only
    rows = spark.createDataFrame(parts, "part int, docs long, tokens long, token_base long").repartition(max(1, len(parts)))
    return rows.mapInArrow(lambda it: _read_part(it, folder, kind), schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(BYTE_BPE))
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
