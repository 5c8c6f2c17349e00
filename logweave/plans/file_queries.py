"""Queries over real log, snapshot and result files: each writes its files and reads them back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workload import workload
from ..shared import shared_path
from ..sources import logfiles as S
from ..sources import telemetry_files as T
from . import bases as B
from .bases import sql, table
from .log_queries import WAL, wal_log
from .telemetry_queries import runs

CATALOG: dict = {}
#: Positions of a segment, and where the snapshot of the tail queries stands.
ROTATE = 500


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def write_log(spark, sf) -> str:
    """The replayed log's records as segment files; a hard state follows some entries."""
    wal = wal_log(spark, sf).withColumn("seq", F.floor(F.col("pos") / ROTATE) + 1)
    tags = wal.groupBy("seq").agg(F.min_by("idx", "pos").alias("tag"))
    rows = wal.join(tags, "seq").select("seq", "pos", "tag", "idx", "term", "hard_state")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, pos, tag, idx, term, hard in zip(*[c.to_pylist() for c in batch.columns]):
                out.append((seq, 2 * pos, tag, S.ENTRY, S.entry_bytes(idx, term, b"e%d" % pos)))
                if hard:
                    out.append((seq, 2 * pos + 1, tag, S.HARD_STATE, S.hard_state_bytes(term, f"n{pos % 3 + 1}")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], ["seq", "pos", "tag", "type", "data"])

    folder = shared_path(spark, "wal")
    S.write_segments(rows.mapInArrow(encode, "seq long, pos long, tag long, type int, data binary"), folder).write.format("noop").mode("overwrite").save()
    return folder


def _varint(n: str) -> str:
    return f"(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 ELSE 4 END)"


# a header of 9 bytes, then fields: a byte of number and kind, and a varint or a length and text
_FRAMES = WAL + f""", frames AS (SELECT pos // {ROTATE} + 1 AS seq, pos, idx, term, 9 + 1 + {_varint("idx")} + 1 + {_varint("term")} + 2 + length('e' || pos) AS entry_bytes,
 CASE WHEN hard_state THEN 9 + 1 + {_varint("term")} + 4 ELSE 0 END AS hard_bytes FROM wal)"""


def wal_files(spark, sf):
    """The segments as listed, with what their records say."""
    folder = write_log(spark, sf)
    records = S.log_entries(S.read_wal(spark, folder)).groupBy("seq").agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "hard_state").alias("hard_states"), F.max("idx").alias("last_idx"))
    return S.list_segments(spark, folder).join(records, "seq").select("seq", "tag", F.col("length").alias("bytes"), "records", "hard_states", "last_idx")


add("wal_files", wal_files, sql(_FRAMES, """SELECT seq, arg_min(idx, pos) AS tag, CAST(sum(entry_bytes + hard_bytes) AS BIGINT) AS bytes, count(*) + count(*) FILTER (WHERE hard_bytes > 0) AS records,
count(*) FILTER (WHERE hard_bytes > 0) AS hard_states, max(idx) AS last_idx FROM frames GROUP BY seq"""))


def wal_bytes(spark, sf):
    """Bytes of the log on disk, by the listing alone."""
    return S.list_segments(spark, write_log(spark, sf)).agg(F.count("*").alias("segments"), F.sum("length").alias("bytes"))


add("wal_bytes", wal_bytes, sql(_FRAMES, "SELECT count(DISTINCT seq) AS segments, CAST(sum(entry_bytes + hard_bytes) AS BIGINT) AS bytes FROM frames"))


def wal_replay_files(spark, sf):
    """Entries that a load of the files leaves."""
    kept, _ = S.load_log(spark, write_log(spark, sf))
    return kept.select("idx", "term", F.col("payload").cast("string").alias("payload"))


add("wal_replay_files", wal_replay_files, sql(WAL, "SELECT idx, term, 'e' || pos AS payload FROM kept"))


def wal_hard_state(spark, sf):
    _, hard = S.load_log(spark, write_log(spark, sf))
    return hard


add("wal_hard_state", wal_hard_state, sql(WAL, "SELECT arg_max(term, pos) AS term, arg_max('n' || (pos % 3 + 1), pos) AS voted_for FROM wal WHERE hard_state HAVING count(*) > 0"))


def wal_tail_files(spark, sf):
    """Entries after a snapshot in the middle of the log: segments that it covers are not opened."""
    folder = write_log(spark, sf)
    found = S.segments(spark, folder)
    at = found[len(found) // 2][1]  # the snapshot ends where the middle segment began
    # the first entry of a segment that began at or before the next index replaced all that is earlier
    first = max((seq for seq, tag, *_ in found if tag <= at + 1), default=0)
    kept, _ = S.load_log(spark, folder, snapshot_index=at, min_seq=first)
    return kept.select("idx", "term", F.col("payload").cast("string").alias("payload"))


add("wal_tail_files", wal_tail_files, sql(_FRAMES, """SELECT idx, term, 'e' || pos AS payload FROM kept WHERE idx > (
SELECT tag FROM (SELECT seq, arg_min(idx, pos) AS tag, row_number() OVER (ORDER BY seq) - 1 AS n, count(*) OVER () AS all_ FROM frames GROUP BY seq) WHERE n = all_ // 2)"""))

#: Log positions between snapshots of a shard.
EVERY = 400


def snapshot_file_roundtrip(spark, sf):
    """Snapshots of every shard at several positions as files; the newest of each is read back.

    A snapshot holds how many commands each key had up to its position.
    """
    rows = B.cmds(spark, sf).select("shard", "key", "log_index")
    ends = rows.groupBy("shard").agg(F.max("log_index").alias("last"))
    steps = F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("last") / EVERY))
    due = ends.where(F.col("last") >= EVERY).select("shard", F.explode(F.transform(steps, lambda i: i * EVERY)).alias("at"))
    # a key's counts at all positions are one running sum, not one scan a snapshot
    step = rows.groupBy("shard", "key", (F.ceil(F.col("log_index") / EVERY) * EVERY).alias("at")).agg(F.count("*").alias("n"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("shard", "key").orderBy("at"))
    grid = rows.select("shard", "key").distinct().join(due, "shard")
    state = grid.join(step, ["shard", "key", "at"], "left").withColumn("n", upto).where("n > 0")
    folder = shared_path(spark, "snapshots")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            made = []
            for shard, at, keys, counts in zip(*[c.to_pylist() for c in batch.columns]):
                parts = [S.encode_message([(1, k), (2, n)]) for k, n in zip(keys, counts)]
                body = b"".join(len(p).to_bytes(4, "little") + p for p in parts)
                made.append(S.write_snapshot_file(f"{folder}/{shard}", at, 1 + at // 1000, at // ROTATE, body, attempt))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    # the keys of one shard: what a snapshot file holds by definition
    pairs = F.array_sort(F.collect_list(F.struct("key", "n")))
    bodies = state.groupBy("shard", "at").agg(pairs.alias("p")).select("shard", "at", "p.key", "p.n")
    shards = [r.shard for r in bodies.mapInArrow(write, "path string").select(F.element_at(F.split("path", "/"), -2).cast("int").alias("shard")).distinct().collect()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, last, segment, body in zip(*[c.to_pylist() for c in batch.columns]):
                at = 0
                while at < len(body):
                    size = int.from_bytes(body[at : at + 4], "little")
                    f = S.decode_message(body[at + 4 : at + 4 + size])
                    out.append((shard, last, segment, f[1][-1].decode(), f[2][-1]))
                    at += 4 + size
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], ["shard", "last_index", "min_segment", "key", "n"])

    schema = "shard int, last_index long, min_segment long, key string, n long"
    found: DataFrame = spark.createDataFrame([], schema)
    for shard in sorted(shards):  # one small file a shard
        newest = S.read_snapshots(spark, f"{folder}/{shard}").select(F.lit(shard).alias("shard"), "last_index", "min_segment", "data")
        found = found.unionByName(newest.mapInArrow(decode, schema))
    return found


add("snapshot_file_roundtrip", snapshot_file_roundtrip, sql(B.CMDS, f"""SELECT c.shard, l.at AS last_index, l.at // {ROTATE} AS min_segment, key, count(*) AS n FROM cmds c
JOIN (SELECT shard, max(log_index) // {EVERY} * {EVERY} AS at FROM cmds GROUP BY shard) l ON l.shard = c.shard AND log_index <= l.at GROUP BY ALL"""))


def obsolete_snapshots(spark, sf):
    """Snapshots that a newer one of the shard makes unnecessary, from names alone."""
    at = B.cmds(spark, sf).where(F.col("log_index") % EVERY == 0).select("shard", F.col("log_index").alias("last_index"))
    newer = F.max("last_index").over(Window.partitionBy("shard"))
    return at.withColumn("newest", newer).where("last_index < newest").select("shard", "last_index", "newest")


add("obsolete_snapshots", obsolete_snapshots, sql(B.CMDS, f"""SELECT shard, last_index, newest FROM (SELECT shard, log_index AS last_index, max(log_index) OVER (PARTITION BY shard) AS newest FROM cmds WHERE log_index % {EVERY} = 0) WHERE last_index < newest"""))


def jsonl_roundtrip(spark, sf):
    """Runs appended to a file of JSON lines in two goes, read back; the last of each name counts."""
    made = runs(spark, sf).select("name", "clients", "ops", "errors", F.when(F.col("errors") > 0, F.col("ops")).otherwise(0).alias("cache_hits"), F.col("event_id").cast("double").alias("duration_s"))
    made = made.withColumns({c: F.col(c).cast("bigint") for c in ("ops", "errors", "cache_hits")})
    path = shared_path(spark, "runs")
    for part in (0, 1):
        T.append_runs(made.where(F.col("duration_s") % 2 == part), path)
    return T.latest_runs(T.read_runs(spark, path), "duration_s", "run-").select("name", "clients", "ops", "errors", "cache_hits", "stale_reads", F.col("duration_s").cast("bigint").alias("event_id"))


add("jsonl_roundtrip", jsonl_roundtrip, sql(B.RAW, """SELECT concat('clients-', user_id % 20) AS name, arg_max(CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 100 ELSE 500 END, event_id) AS clients,
CAST(arg_max(k * 100 + 7, event_id) AS BIGINT) AS ops, CAST(arg_max(k % 3, event_id) AS BIGINT) AS errors, CAST(arg_max(CASE WHEN k % 3 > 0 THEN k * 100 + 7 ELSE 0 END, event_id) AS BIGINT) AS cache_hits,
CAST(0 AS BIGINT) AS stale_reads, max(event_id) AS event_id FROM raw GROUP BY 1"""))

KEYS, SEED = 1000, 7


def workload_mix(spark, sf):
    """As many generated requests as there are events, by operation and key."""
    n = table(spark, sf, "events").count()
    return workload(spark, n, KEYS, cacheable=0.25, seed=SEED).groupBy("op", "key").agg(F.count("*").alias("n"))


_DRAW = "CAST(('0x' || substr(md5(concat('{0}-', i)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
add("workload_mix", workload_mix, f"""SELECT CASE WHEN u < 0.8::DOUBLE THEN 'get' WHEN u < 0.95::DOUBLE THEN 'put' ELSE 'delete' END AS op,
CASE WHEN (r % 1000) / 1000.0 < 0.25 THEN concat('config:item:', r) ELSE concat('task:', r, ':status') END AS key, count(*) AS n
FROM (SELECT {_DRAW.format(SEED)} AS u, CAST(floor({_DRAW.format(SEED + 1)} * {KEYS}) AS BIGINT) AS r FROM range((SELECT count(*) FROM events)) t(i)) GROUP BY 1, 2""")
