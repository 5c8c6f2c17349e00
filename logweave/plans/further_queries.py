"""Queries for the smaller rows: projections, classifications, histories, metric families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import commands as C
from ..shared import settle
from ..sources.telemetry_files import batches
from . import bases as B
from .bases import sql, table
from .service_queries import NODES

CATALOG: dict = {}


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def read_projection(spark, sf):
    """What a read returns: time in RFC 3339 without trailing zeros, and as a header's date."""
    ms = F.col("updated_ms")
    fraction = F.when(ms % 1000 == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("0"))))
    at = F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return C.live(B.state(spark, sf)).select("key", F.col("value").cast("string").alias("value"), "version", at.alias("updated_at"), X.http_date(ms).alias("last_modified"))


add("read_projection", read_projection, sql(B.STATE, """SELECT key, CAST(value AS VARCHAR) AS value, version, concat(strftime(make_timestamp(updated_ms * 1000), '%Y-%m-%dT%H:%M:%S'),
CASE WHEN updated_ms % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(updated_ms % 1000 AS VARCHAR), 3, '0'), '0') END, 'Z') AS updated_at,
strftime(make_timestamp(updated_ms * 1000), '%a, %d %b %Y %H:%M:%S GMT') AS last_modified FROM state WHERE NOT deleted"""))


def cache_fill(spark, sf):
    """Responses that a cache keeps: 200, a positive max-age, no no-store."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 404).otherwise(200).alias("code"), (F.col("o_orderkey") % 4).alias("h"))
    header = F.when(F.col("h") == 0, "no-store").when(F.col("h") == 1, "public, max-age=0").when(F.col("h") == 2, "max-age=9, no-store").otherwise("public, max-age=30")
    keep = (F.col("code") == 200) & (X.max_age(header) > 0) & (F.instr(header, "no-store") == 0)
    return o.groupBy("code", header.alias("header"), keep.alias("kept")).agg(F.count("*").alias("n"))


add("cache_fill", cache_fill, """SELECT code, header, code = 200 AND header = 'public, max-age=30' AS kept, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 404 ELSE 200 END AS code,
CASE o_orderkey % 4 WHEN 0 THEN 'no-store' WHEN 1 THEN 'public, max-age=0' WHEN 2 THEN 'max-age=9, no-store' ELSE 'public, max-age=30' END AS header FROM orders) GROUP BY 1, 2, 3""")

_CODES = (200, 304, 400, 403, 404, 412, 413, 421, 500, 503)


def client_error_classes(spark, sf):
    """Answers that are final for a client, that redirect it, and that it tries again."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), F.col("k") % 10 + 1)
    kind = (
        F.when(code == 200, "success")
        .when(code.isin(404, 412, 403), "definitive")
        .when(code == 421, "redirect")
        .otherwise("retry")
    )
    return B.raw(spark, sf).groupBy(code.alias("code"), kind.alias("kind")).agg(F.count("*").alias("n"))


add("client_error_classes", client_error_classes, sql(B.RAW, f"""SELECT code, CASE WHEN code = 200 THEN 'success' WHEN code IN (404, 412, 403) THEN 'definitive' WHEN code = 421 THEN 'redirect' ELSE 'retry' END AS kind, count(*) AS n
FROM (SELECT [{', '.join(map(str, _CODES))}][k % 10 + 1] AS code FROM raw) GROUP BY 1, 2"""))


def metric_batches(spark, sf):
    """Series of the wanted metrics in batches of twenty, per node."""
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("node"), "s_suppkey", F.element_at(F.array(*map(F.lit, ("requests_total", "go_threads", "wal_size_bytes"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("name"))
    wanted = s.where(F.col("name").isin("requests_total", "wal_size_bytes"))
    return batches(wanted, ["node"], "s_suppkey").groupBy("node", "batch").agg(F.count("*").alias("data"), F.min("s_suppkey").alias("first"))


add("metric_batches", metric_batches, """SELECT node, (rn - 1) // 20 AS batch, count(*) AS data, min(s_suppkey) AS first FROM (SELECT s_nationkey % 3 AS node, s_suppkey, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey) AS rn
FROM supplier WHERE s_suppkey % 3 <> 1) GROUP BY 1, 2""")


def metric_help(spark, sf):
    """Help text before the first line of each family, the histogram suffixes cut off."""
    lines = table(spark, sf, "nation").select(
        F.concat(F.element_at(F.array(*map(F.lit, ("latency_bucket", "latency_sum", "latency_count", "requests_total", "up"))), F.col("n_nationkey") % 5 + 1), F.lit('{node="'), F.col("n_nationkey"), F.lit('"} 1')).alias("line")
    )
    family = F.regexp_replace(F.regexp_extract("line", r"^([^{ ]+)", 1), "(_bucket|_sum|_count)$", "")
    first = lines.groupBy(family.alias("family")).agg(F.min("line").alias("line"))
    texts = spark.createDataFrame([("latency", "Seconds a request."), ("requests_total", "Requests.")], "family string, help string")
    return first.join(texts, "family", "left").select("family", "line", F.when(F.col("help").isNotNull(), F.concat(F.lit("# HELP "), "family", F.lit(" "), "help")).alias("help"))


add("metric_help", metric_help, """SELECT family, min(line) AS line, max(CASE family WHEN 'latency' THEN '# HELP latency Seconds a request.' WHEN 'requests_total' THEN '# HELP requests_total Requests.' END) AS help FROM
(SELECT concat(name, '{node="', n_nationkey, '"} 1') AS line, regexp_replace(name, '(_bucket|_sum|_count)$', '') AS family FROM
(SELECT n_nationkey, ['latency_bucket', 'latency_sum', 'latency_count', 'requests_total', 'up'][n_nationkey % 5 + 1] AS name FROM nation)) GROUP BY family""")


def peer_lists(spark, sf):
    """The other members from each node's view."""
    all_ = F.array(*map(F.lit, NODES))
    return spark.createDataFrame([(n,) for n in NODES], "node string").select("node", F.array_join(F.array_sort(F.array_except(all_, F.array("node"))), ",").alias("peers"))


add("peer_lists", peer_lists, "SELECT * FROM (VALUES ('n1', 'n2,n3'), ('n2', 'n1,n3'), ('n3', 'n1,n2')) v(node, peers)")


def ack_times(spark, sf):
    """Latest acknowledgement of each peer as replies come in, some of them late."""
    replies = B.raw(spark, sf).select(F.col("user_id").alias("peer"), "event_id", (X.epoch_ms("ts") - F.col("k") * 60_000).alias("sent"))
    return replies.withColumn("acked", F.max("sent").over(Window.partitionBy("peer").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)))


add("ack_times", ack_times, sql(B.RAW, """SELECT peer, event_id, sent, max(sent) OVER (PARTITION BY peer ORDER BY event_id) AS acked FROM (SELECT user_id AS peer, event_id, epoch_us(ts) // 1000 - k * 60000 AS sent FROM raw)"""))


def history_stamps(spark, sf):
    """Strictly increasing stamps per client: at least one more than the stamp before.

    ``max(t - n) + n`` over the rows so far is that fold in closed form.
    """
    w = Window.partitionBy("client").orderBy("event_id")
    calls = B.raw(spark, sf).select(F.col("user_id").alias("client"), "event_id", F.floor(F.col("event_id") / 400).alias("clock"))
    n = F.row_number().over(w)
    return calls.withColumn("_n", n).withColumn("stamp", F.max(F.col("clock") - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).drop("_n")


add("history_stamps", history_stamps, sql(B.RAW, """SELECT client, event_id, clock, max(clock - n) OVER (PARTITION BY client ORDER BY event_id) + n AS stamp
FROM (SELECT user_id AS client, event_id, event_id // 400 AS clock, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM raw)"""))


def _history(spark, sf):
    """Writes with call and return, and reads that may have been answered by an old replica."""
    w = B.executed(spark, sf).where("status = 'OK'").join(B.raw(spark, sf).select("event_id", "k"), "event_id")
    writes = w.select("key", (F.col("event_id") * 1000).alias("call"), (F.col("event_id") * 1000 + F.col("k") * 100).alias("ret"), "version")
    reads = B.keyed(spark, sf).where("event_type = 'view' AND k <> 13").select("key", F.col("event_id").alias("read_id"), (F.col("event_id") * 1000).alias("call"), (F.col("event_id") * 1000 - F.col("k") % 5 * 40_000).alias("seen_at"))
    return writes, reads


def history_audit(spark, sf):
    """Reads that returned less than a version acknowledged before they were called.

    Reads whose outcome is unknown are dropped; both the version seen and the version owed are
    running maxima over one union, not interval joins.
    """
    writes, reads = _history(spark, sf)

    def upto(time, at, name):
        r = reads.select("key", "read_id", F.col(at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("version"))
        rows = r.unionByName(writes.select("key", F.lit(None).cast("bigint").alias("read_id"), F.col(time).alias("t"), F.lit(1).alias("side"), "version"))
        w = Window.partitionBy("key").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.coalesce(F.max("version").over(w), F.lit(0))).where("side = 0").select("read_id", name)

    both = reads.select("key", "read_id").join(upto("call", "seen_at", "seen"), "read_id").join(upto("ret", "call", "owed"), "read_id")
    return both.groupBy("key").agg(F.count("*").alias("reads"), F.count_if(F.col("seen") < F.col("owed")).alias("violations"))


add("history_audit", history_audit, sql(B.EXECUTED + """,
writes AS (SELECT e.key, e.event_id * 1000 AS call, e.event_id * 1000 + r.k * 100 AS ret, e.version FROM executed e JOIN raw r ON r.event_id = e.event_id WHERE e.status = 'OK'),
reads AS (SELECT key, event_id AS read_id, event_id * 1000 AS call, event_id * 1000 - k % 5 * 40000 AS seen_at FROM keyed WHERE event_type = 'view' AND k <> 13),
judged AS (SELECT r.key, r.read_id, coalesce((SELECT max(version) FROM writes w WHERE w.key = r.key AND w.call < r.seen_at), 0) AS seen, coalesce((SELECT max(version) FROM writes w WHERE w.key = r.key AND w.ret < r.call), 0) AS owed FROM reads r)""",
    "SELECT key, count(*) AS reads, count(*) FILTER (WHERE seen < owed) AS violations FROM judged GROUP BY key"))
add(
    "unknown_outcomes",
    lambda s, d: B.raw(s, d).groupBy("event_type").agg(F.count_if(F.col("k") == 13).alias("unknown"), F.count("*").alias("calls")),
    sql(B.RAW, "SELECT event_type, count(*) FILTER (WHERE k = 13) AS unknown, count(*) AS calls FROM raw GROUP BY event_type"),
)


def history_precedence(spark, sf):
    """Pairs that contradict real time, by key: of two calls that don't overlap, the later one must not
    return less than the earlier one, and a later write must make more.

    Each kind is a running maximum over the calls that had returned before a call began, in one union
    of returns and calls, so no pair of calls is ever a row.
    """
    writes, reads = _history(spark, sf)
    writes = settle(writes, "writes")
    w = Window.partitionBy("key").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    asked = reads.select("key", "read_id", F.col("seen_at").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("version"))
    made = writes.select("key", F.lit(None).cast("bigint").alias("read_id"), F.col("call").alias("t"), F.lit(1).alias("side"), "version")
    seen = asked.unionByName(made).withColumn("version", F.coalesce(F.max("version").over(w), F.lit(0))).where("side = 0").select("key", "read_id", "version")
    calls = seen.select("key", (F.col("read_id") * 1000).alias("call"), (F.col("read_id") * 1000 + F.col("read_id") % 7 * 900).alias("ret"), "version", F.lit("read").alias("op"))
    calls = settle(calls.unionByName(writes.select("key", "call", "ret", "version", F.lit("write").alias("op"))), "calls")
    # a return counts for calls that begin after it: at equal times the call comes first
    begun = calls.select("key", F.col("call").alias("t"), F.lit(0).alias("side"), "op", "version", F.lit(None).cast("bigint").alias("by_read"), F.lit(None).cast("bigint").alias("by_write"))
    done = lambda op: F.when(F.col("op") == op, F.col("version"))
    ended = calls.select("key", F.col("ret").alias("t"), F.lit(1).alias("side"), "op", "version", done("read").alias("by_read"), done("write").alias("by_write"))
    ordered = begun.unionByName(ended).withColumns({c: F.max(c).over(w) for c in ("by_read", "by_write")}).where("side = 0")
    read, write, own = F.col("op") == "read", F.col("op") == "write", F.col("version")
    return ordered.groupBy("key").agg(
        F.count("*").alias("calls"), F.count_if(read & (own < F.col("by_write"))).alias("write_read"), F.count_if(read & (own < F.col("by_read"))).alias("read_read"),
        F.count_if(write & (own <= F.col("by_write"))).alias("write_write"), F.count_if(write & (own <= F.col("by_read"))).alias("read_write"),
    )


add("history_precedence", history_precedence, sql(B.EXECUTED + """,
writes AS (SELECT e.key, e.event_id * 1000 AS call, e.event_id * 1000 + r.k * 100 AS ret, e.version FROM executed e JOIN raw r ON r.event_id = e.event_id WHERE e.status = 'OK'),
reads AS (SELECT key, event_id AS read_id, event_id * 1000 - k % 5 * 40000 AS seen_at FROM keyed WHERE event_type = 'view' AND k <> 13),
calls AS (SELECT key, read_id * 1000 AS call, read_id * 1000 + read_id % 7 * 900 AS ret, coalesce((SELECT max(version) FROM writes w WHERE w.key = r.key AND w.call < r.seen_at), 0) AS version, 'read' AS op FROM reads r
 UNION ALL SELECT key, call, ret, version, 'write' FROM writes),
judged AS (SELECT key, op, version, (SELECT max(version) FROM calls x WHERE x.key = c.key AND x.op = 'read' AND x.ret < c.call) AS by_read, (SELECT max(version) FROM calls x WHERE x.key = c.key AND x.op = 'write' AND x.ret < c.call) AS by_write FROM calls c)""",
    """SELECT key, count(*) AS calls, count(*) FILTER (WHERE op = 'read' AND version < by_write) AS write_read, count(*) FILTER (WHERE op = 'read' AND version < by_read) AS read_read,
 count(*) FILTER (WHERE op = 'write' AND version <= by_write) AS write_write, count(*) FILTER (WHERE op = 'write' AND version <= by_read) AS read_write FROM judged GROUP BY key"""))
