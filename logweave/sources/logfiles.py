"""Segmented, checksummed log files and snapshot files as DataFrames, and writers for them.

Files are read through Spark's ``binaryFile`` source, so they may be in any store that it reads; one
segment is one row and is parsed by the task that holds it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import replay
from ..shared import make_folder, write_whole

# File formats.
SNAPSHOT_MAGIC = b"EKVSNAP1"
HEADER = struct.Struct("<IIB")  # length, crc32c of type and data, type
MAX_RECORD = 256 << 20
ENTRY, HARD_STATE = 1, 2
SEGMENT_NAME = r"^([0-9a-f]{16})-([0-9a-f]{16})$"
CASTAGNOLI = 0x82F63B78


def _crc_table() -> np.ndarray:
    """CRC register after one byte, for each value of the byte and a register of zeros."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(CASTAGNOLI), out >> 1).astype(np.uint32)
    return out


_TABLE = _crc_table()
#: Longer messages are summed in lanes of so many bytes, side by side.
LANE = 512


def _registers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers after each message, all messages a byte further at a time."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, crc = starts[order], lengths[order], first[order].copy()
    # so many messages are longer than j
    longer = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for j, n in enumerate(longer.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ data[starts[:n] + j]) & 0xFF] ^ crc[:n] >> 8
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _shift_tables() -> list[list[int]]:
    """What LANE bytes of zeros do to a register, by each of its four bytes (the map is linear)."""
    bits = _registers(np.zeros(LANE, np.uint8), np.zeros(32, np.int64), np.full(32, LANE), np.uint32(1) << np.arange(32, dtype=np.uint32)).tolist()
    tables = []
    for k in range(4):
        row = [0]
        for i in range(8):
            row += [x ^ bits[8 * k + i] for x in row]
        tables.append(row)
    return tables


_SHIFT = _shift_tables()


def crc32c_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each stretch of ``data``, in numpy: stretches, and lanes of long ones, side by side."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    head = np.where(lengths > LANE, (lengths - 1) % LANE + 1, lengths)  # the rest are whole lanes
    out = _registers(data, starts, head, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    lanes = (lengths - head) // LANE
    if lanes.any():
        at = np.concatenate([s + LANE * np.arange(n) for s, n in zip((starts + head).tolist(), lanes.tolist())]).astype(np.int64)
        made = iter(_registers(data, at, np.full(len(at), LANE), np.zeros(len(at), np.uint32)).tolist())
        a, b, c, d = _SHIFT
        for i in np.flatnonzero(lanes).tolist():
            x = int(out[i])
            for _ in range(int(lanes[i])):
                x = a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24] ^ next(made)
            out[i] = x
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))[0])


def framed(records: list[tuple[int, bytes]]) -> bytes:
    """(type, data) records as they stand in a file."""
    bodies = [bytes([kind]) + data for kind, data in records]
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    sums = crc32c_many(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lengths) - lengths, lengths).tolist() if bodies else []
    return b"".join(HEADER.pack(len(data), crc, kind) + data for (kind, data), crc in zip(records, sums))


def frame(kind: int, data: bytes) -> bytes:
    return framed([(kind, data)])


def frames(body: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, type, data) of each sound record; a torn or damaged tail gives (offset, -1, None)."""
    found, at = [], 0
    while len(body) - at >= HEADER.size:
        length, crc, kind = HEADER.unpack_from(body, at)
        if length > MAX_RECORD or len(body) - at - HEADER.size < length:
            break
        found.append((at, length, crc, kind))
        at += HEADER.size + length
    if found:
        starts, lengths, sums, _ = map(np.array, zip(*found))
        # the type stands right before the data, and both are summed
        sound = crc32c_many(np.frombuffer(body, np.uint8), starts + HEADER.size - 1, lengths + 1) == sums.astype(np.uint32)
        for (offset, length, _, kind), good in zip(found, sound.tolist()):
            if not good:
                yield offset, -1, None
                return
            yield offset, kind, body[offset + HEADER.size : offset + HEADER.size + length]
    if at < len(body):
        yield at, -1, None


def segment_name(seq: int, tag: int) -> str:
    return f"{seq:016x}-{tag:016x}.wal"


def snapshot_bytes(meta: bytes, data: bytes) -> bytes:
    body = SNAPSHOT_MAGIC + struct.pack("<I", len(meta)) + meta + struct.pack("<Q", len(data)) + data
    return body + struct.pack("<I", crc32c(body))


def parse_snapshot(body: bytes) -> tuple[bytes, bytes]:
    """Metadata and data of a snapshot file; ValueError if anything is amiss."""
    head = len(SNAPSHOT_MAGIC)
    if len(body) < head + 16 or body[:head] != SNAPSHOT_MAGIC or crc32c(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("damaged snapshot file")
    (n,) = struct.unpack_from("<I", body, head)
    at = head + 4 + n
    if at + 8 > len(body) - 4 or struct.unpack_from("<Q", body, at)[0] != len(body) - 4 - at - 8:
        raise ValueError("damaged snapshot file")
    return body[head + 4 : at], body[at + 8 : -4]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_message(fields: Iterable[tuple[int, int | bytes | str]]) -> bytes:
    """Protocol-buffer wire form of (number, value) fields; zero and empty values are left out."""
    out = b""
    for number, v in fields:
        if isinstance(v, str):
            v = v.encode()
        if isinstance(v, bytes):
            out += _varint(number << 3 | 2) + _varint(len(v)) + v if v else b""
        elif v:
            out += _varint(number << 3) + _varint(int(v) & (1 << 64) - 1)
    return out


def decode_message(body: bytes) -> dict[int, list[int | bytes]]:
    """Fields by number, each with all its values."""
    out: dict[int, list[int | bytes]] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = body[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(body):
        key = varint()
        if key & 7 == 0:
            v: int | bytes = varint()
        elif key & 7 == 2:
            n = varint()
            v, at = body[at : at + n], at + n
        else:
            raise ValueError(f"wire type {key & 7} is not used here")
        out.setdefault(key >> 3, []).append(v)
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["seq", "tag", "path", "offset", "type", "data"]
    for batch in batches:
        for seq, tag, path, last, body in zip(*[c.to_pylist() for c in batch.columns]):
            rows = []
            for offset, kind, data in frames(body):
                if kind < 0:
                    # the tail of the last segment may be torn by a crash, any other place may not
                    if not last:
                        raise ValueError(f"record at byte {offset} of {path} does not match its checksum")
                    break
                rows.append((seq, tag, path, offset, kind, data))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()))], names)


def segments(spark: SparkSession, folder: str) -> list[tuple[int, int, str, int]]:
    """(seq, tag, path, length) of a folder's segments by seq; a foreign ``.wal`` name is an error.

    Names are listed through the file system itself, as readers pass over empty files and the last
    segment may be one.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if name.endswith(".wal"):
            if (m := re.match(SEGMENT_NAME, name.removesuffix(".wal"))) is None:
                raise ValueError(f"{name} is not named like a segment")
            out.append((int(m[1], 16), int(m[2], 16), f.getPath().toString(), f.getLen()))
    return sorted(out)


def list_segments(spark: SparkSession, folder: str) -> DataFrame:
    """``seq, tag, path, length`` of the segments of a folder."""
    return spark.createDataFrame(segments(spark, folder), "seq long, tag long, path string, length long")


def read_wal(spark: SparkSession, folder: str, min_seq: int = 0) -> DataFrame:
    """Records ``seq, tag, path, offset, type, data`` of all segments from ``min_seq`` on.

    Segments before that are not opened.
    """
    found = segments(spark, folder)
    paths = [p for seq, _, p, n in found if seq >= min_seq and n]
    schema = "seq long, tag long, path string, offset long, type int, data binary"
    if not paths:
        return spark.createDataFrame([], schema)
    number = lambda i: F.conv(F.regexp_extract("path", r"([0-9a-f]{16})-([0-9a-f]{16})\.wal$", i), 16, 10).cast("bigint")
    files = spark.read.format("binaryFile").load(paths).select(number(1).alias("seq"), number(2).alias("tag"), "path", "content")
    marked = files.select("seq", "tag", "path", (F.col("seq") == found[-1][0]).alias("last"), "content")
    return marked.mapInArrow(_records, schema)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["seq", "offset", "kind", "idx", "term", "entry_type", "voted_for", "payload"]
    for batch in batches:
        rows = []
        for seq, offset, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
            f = {k: v[-1] for k, v in decode_message(data).items()}
            if kind == ENTRY:
                rows.append((seq, offset, "entry", f.get(1, 0), f.get(2, 0), "NOOP" if f.get(3) else "NORMAL", None, f.get(4, b"")))
            elif kind == HARD_STATE:
                rows.append((seq, offset, "hard_state", None, f.get(1, 0), None, f.get(2, b"").decode(), None))
            else:
                raise ValueError(f"unknown record type {kind}")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, kinds)], names)


def log_entries(records: DataFrame) -> DataFrame:
    """Records as entries and hard states, in file order by (seq, offset)."""
    return records.select("seq", "offset", "type", "data").mapInArrow(
        _decoded, "seq long, offset long, kind string, idx long, term long, entry_type string, voted_for string, payload binary"
    )


def load_log(spark: SparkSession, folder: str, snapshot_index: int = 0, min_seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entries after a snapshot as a replay leaves them, and the last hard state.

    An entry replaces its index and everything after; a gap is an error.
    """
    rows = log_entries(read_wal(spark, folder, min_seq))
    hard = rows.where("kind = 'hard_state'").agg(F.max_by(F.struct("term", "voted_for"), F.struct("seq", "offset")).alias("h")).where("h IS NOT NULL").select("h.*")
    # positions grow with (seq, offset): segments are far below 2^40 bytes
    entries = rows.where((F.col("kind") == "entry") & (F.col("idx") > snapshot_index)).withColumn("pos", F.shiftleft(F.col("seq"), 40) + F.col("offset"))
    kept = replay(entries, stride=1 << 40)
    # a replay leaves indexes that grow, so they are contiguous if there are as many as the last says
    n = kept.agg(F.count("*").alias("n"), F.max("idx").alias("last")).first()
    if n.n and n.last - snapshot_index != n.n:
        raise ValueError(f"entries are missing: {n.n} follow index {snapshot_index}, yet the last has index {n.last}")
    return kept.select("idx", "term", "entry_type", "payload"), hard


def write_segments(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(seq, pos, tag, type, data)`` as a segment file for each ``seq``, records by ``pos``.

    Returns ``seq, path, bytes`` of the files.  A segment is one task's at a time and bounded by the
    caller's rotation; files appear when complete, so a task that is run again replaces its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        key, held = None, []
        out: list[tuple[int, str, int]] = []

        def close() -> None:
            if key is not None:
                path, body = f"{folder}/{segment_name(*key)}", framed(held)
                write_whole(path, body, attempt)
                out.append((key[0], path, len(body)))

        for batch in batches:
            for seq, tag, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
                if key is None or seq != key[0]:
                    close()
                    key, held = (seq, tag), []
                held.append((kind, data))
        close()
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["seq", "path", "bytes"])

    rows = records.repartition("seq").sortWithinPartitions("seq", "pos").select("seq", "tag", "type", "data")
    return rows.mapInArrow(write, "seq long, path string, bytes long")


def entry_bytes(idx: int, term: int, payload: bytes, noop: bool = False) -> bytes:
    return encode_message([(1, idx), (2, term), (3, int(noop)), (4, payload)])


def hard_state_bytes(term: int, voted_for: str) -> bytes:
    return encode_message([(1, term), (2, voted_for)])


def snapshot_name(last_index: int, last_term: int) -> str:
    return f"snap-{last_index:016x}-{last_term:016x}.snap"


def write_snapshot_file(folder: str, last_index: int, last_term: int, min_segment: int, data: bytes, attempt: int = 0) -> str:
    path = f"{folder}/{snapshot_name(last_index, last_term)}"
    make_folder(folder)
    write_whole(path, snapshot_bytes(encode_message([(1, last_index), (2, last_term), (3, min_segment)]), data), attempt)
    return path


def snapshot_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's snapshots, the newest last: names of fixed width sort as numbers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(path)]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if re.match(r"^snap-.*\.snap$", p.getName())]


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """``path, last_index, last_term, min_segment, data`` of the newest snapshot of a folder.

    Only that file is opened.  A damaged newest snapshot is an error: an older one would forget
    acknowledged writes.
    """
    schema = "path string, last_index long, last_term long, min_segment long, data binary"
    found = snapshot_files(spark, folder)
    if not found:
        return spark.createDataFrame([], schema)
    picked = spark.read.format("binaryFile").load(found[-1:]).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(*[c.to_pylist() for c in batch.columns]):
                meta, data = parse_snapshot(body)
                f = {k: v[-1] for k, v in decode_message(meta).items()}
                values = [path, f.get(1, 0), f.get(2, 0), f.get(3, 0), data]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["path", "last_index", "last_term", "min_segment", "data"])

    return picked.mapInArrow(parse, schema)


def encode_command(op: str, key: str, value: bytes = b"", expected: int | None = None, request_id: str = "", cacheable: bool = False, ttl: int = 0, ts_ms: int = 0) -> bytes:
    return encode_message(
        [(1, int(op == "DELETE")), (2, key), (3, value), (4, int(expected is not None)), (5, expected or 0), (6, request_id), (7, int(cacheable)), (8, ttl), (9, ts_ms)]
    )


def commands(entries: DataFrame, shard: int = 0) -> DataFrame:
    """The command log of replayed entries: no-ops keep their index and reach no state."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "log_index", "key", "op", "value", "has_expected", "expected", "request_id", "cacheable", "ttl", "ts_ms"]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
        for batch in batches:
            rows = []
            for idx, body in zip(*[c.to_pylist() for c in batch.columns]):
                f = {k: v[-1] for k, v in decode_message(body).items()}
                text = lambda i: f.get(i, b"").decode()
                rows.append((shard, idx, text(2), "DELETE" if f.get(1) else "PUT", f.get(3, b""), bool(f.get(4)), f.get(5, 0), text(6), bool(f.get(7)), f.get(8, 0), f.get(9, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 11, kinds)], names)

    return entries.where("entry_type = 'NORMAL'").select("idx", "payload").mapInArrow(
        decode,
        "shard int, log_index long, key string, op string, value binary, has_expected boolean, expected long, request_id string, cacheable boolean, ttl int, ts_ms long",
    )
