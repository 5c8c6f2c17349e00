"""Base relations of the queries, each as a DataFrame and as the same SQL for the oracle.

Commands, reads and samples are derived from ``events`` with whole-number arithmetic, so both
engines start from equal rows.  Trace time is ``event_id`` seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms, shard_of
from ..operators import commands as C
from ..operators.sequential import dense_index

SHARDS = 3
DEDUP = 500
NAMESPACES = ("config:",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    key = F.when(u % 5 == 0, F.concat(F.lit("config:item:"), u % 40)).otherwise(F.concat(F.lit("task:"), u % 13, F.lit(":status")))
    return raw(spark, sf_dir).withColumn("key", key)


def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands without their log positions."""
    k = F.col("k")
    return keyed(spark, sf_dir).where("event_type <> 'view'").select(
        shard_of("key", SHARDS).alias("shard"),
        "key",
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.col("event_type").isin("signup", "purchase").alias("has_expected"),
        F.when(F.col("event_type") == "purchase", k % 8).otherwise(0).cast("bigint").alias("expected"),
        F.when(k == 99, "").otherwise(F.concat(F.lit("r"), F.col("user_id") % 10, F.lit("-"), k)).alias("request_id"),
        (k % 3 != 0).alias("cacheable"),
        k.alias("ttl"),
        epoch_ms("ts").alias("ts_ms"),
        "event_id",
    )


def cmds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log; positions are dense within a shard."""
    return dense_index(unplaced(spark, sf_dir), ["shard"], "event_id", "log_index")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands without expected versions."""
    return cmds(spark, sf_dir).where(~F.col("has_expected"))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_anchors(cmds(spark, sf_dir), DEDUP)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply(cmds(spark, sf_dir), DEDUP)


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold(C.executed(anchored(spark, sf_dir)))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state(executed(spark, sf_dir))


def fnv_sql(text: str) -> str:
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), "
        "lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
    )


RAW = "raw AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"
KEYED = RAW + """,
keyed AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN concat('config:item:', user_id % 40)
                         ELSE concat('task:', user_id % 13, ':status') END AS key FROM raw)"""
CMDS = f"""{KEYED},
names AS (SELECT key, CAST({fnv_sql("key")} % {SHARDS} AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM keyed)),
cmds AS (SELECT n.shard, e.key, row_number() OVER (PARTITION BY n.shard ORDER BY e.event_id) AS log_index,
                CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
                event_type IN ('signup', 'purchase') AS has_expected,
                CAST(CASE WHEN event_type = 'purchase' THEN k % 8 ELSE 0 END AS BIGINT) AS expected,
                CASE WHEN k = 99 THEN '' ELSE concat('r', user_id % 10, '-', k) END AS request_id,
                k % 3 <> 0 AS cacheable, k AS ttl, epoch_us(ts) // 1000 AS ts_ms, event_id
         FROM keyed e JOIN names n ON n.key = e.key WHERE event_type <> 'view')"""
PLAIN = CMDS + ", plain AS (SELECT * FROM cmds WHERE NOT has_expected)"
ANCHORED = f"""{CMDS},
ided AS (SELECT *, row_number() OVER (PARTITION BY shard, request_id ORDER BY log_index) AS rn FROM cmds WHERE request_id <> ''),
walk AS (SELECT shard, request_id, rn, log_index, log_index AS anchor FROM ided WHERE rn = 1
         UNION ALL
         SELECT i.shard, i.request_id, i.rn, i.log_index, CASE WHEN i.log_index - w.anchor <= {DEDUP} THEN w.anchor ELSE i.log_index END
         FROM walk w JOIN ided i ON i.shard = w.shard AND i.request_id = w.request_id AND i.rn = w.rn + 1),
anchored AS (SELECT c.*, COALESCE(w.anchor, c.log_index) AS anchor FROM cmds c LEFT JOIN walk w ON w.shard = c.shard AND w.log_index = c.log_index)"""
EXECUTED = f"""{ANCHORED},
todo AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY log_index) AS rn FROM anchored WHERE log_index = anchor),
done AS (SELECT DISTINCT shard, key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS log_index, CAST(0 AS BIGINT) AS ver, false AS live, '' AS status, CAST(0 AS BIGINT) AS version FROM todo
         UNION ALL
         SELECT shard, key, rn, log_index,
                CASE WHEN status = 'OK' THEN ver + 1 ELSE ver END,
                CASE WHEN status = 'OK' THEN op = 'PUT' ELSE live END,
                status,
                CASE status WHEN 'OK' THEN ver + 1 WHEN 'MISMATCH' THEN CASE WHEN live THEN ver ELSE 0 END ELSE 0 END
         FROM (SELECT t.shard, t.key, t.rn, t.log_index, t.op, d.ver, d.live,
                      CASE WHEN t.has_expected AND t.expected <> CASE WHEN d.live THEN d.ver ELSE 0 END THEN 'MISMATCH'
                           WHEN t.op = 'PUT' OR d.live THEN 'OK' ELSE 'NOT_FOUND' END AS status
               FROM done d JOIN todo t ON t.shard = d.shard AND t.key = d.key AND t.rn = d.rn + 1)),
executed AS (SELECT t.*, d.status, d.version FROM todo t JOIN done d ON d.shard = t.shard AND d.key = t.key AND d.rn = t.rn)"""
RESULTS = EXECUTED + """,
results AS (SELECT a.*, e.status, e.version FROM anchored a JOIN executed e ON e.shard = a.shard AND e.log_index = a.anchor)"""


def state_cte(source: str, name: str = "state") -> str:
    return f"""{name} AS (SELECT shard, key,
       CASE WHEN arg_max(op, log_index) = 'PUT' THEN arg_max(event_id, log_index) END AS value,
       max(version) AS version, arg_max(op, log_index) = 'DELETE' AS deleted,
       arg_max(cacheable, log_index) FILTER (WHERE op = 'PUT') AS cacheable,
       arg_max(ttl, log_index) FILTER (WHERE op = 'PUT') AS ttl,
       arg_max(ts_ms, log_index) AS updated_ms
       FROM {source} WHERE status = 'OK' GROUP BY shard, key)"""


STATE = EXECUTED + ",\n" + state_cte("executed")


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
