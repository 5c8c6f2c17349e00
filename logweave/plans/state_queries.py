"""Queries over the command log and the state that it folds to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import commands as C
from ..shared import settle, shared_path
from ..sources.snapshots import read_snapshot, write_snapshot
from . import bases as B
from .bases import sql

CATALOG: dict = {}


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def key_shards(spark, sf):
    return B.keyed(spark, sf).select("key").distinct().select("key", X.fnv1a32("key").alias("hash"), X.shard_of("key", B.SHARDS).alias("shard"))


add("key_shards", key_shards, sql(B.KEYED, f"SELECT key, {B.fnv_sql('key')} AS hash, CAST({B.fnv_sql('key')} % 3 AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM keyed)"))


def shard_distribution(spark, sf):
    n = B.unplaced(spark, sf).groupBy("shard").agg(F.count("*").alias("commands"), F.countDistinct("key").alias("keys"))
    return n.withColumn("share", F.round(F.col("commands") / F.sum("commands").over(Window.partitionBy()), 6))


add("shard_distribution", shard_distribution, sql(B.CMDS, """SELECT shard, commands, keys, round(commands / sum(commands) OVER (), 6) AS share
FROM (SELECT shard, count(*) AS commands, count(DISTINCT key) AS keys FROM cmds GROUP BY shard)"""))


def key_versions(spark, sf):
    return C.unconditional_versions(B.plain(spark, sf)).select("shard", "key", "log_index", "op", "status", "version")


_PLAIN_DONE = B.PLAIN + """, marked AS (SELECT *, op = 'PUT' OR coalesce(lag(op) OVER w, 'DELETE') = 'PUT' AS ok FROM plain WINDOW w AS (PARTITION BY shard, key ORDER BY log_index)),
versions AS (SELECT *, CASE WHEN ok THEN 'OK' ELSE 'NOT_FOUND' END AS status,
  CAST(CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY shard, key ORDER BY log_index) ELSE 0 END AS BIGINT) AS version FROM marked)"""
add("key_versions", key_versions, sql(_PLAIN_DONE, "SELECT shard, key, log_index, op, status, version FROM versions"))


def delete_outcomes(spark, sf):
    return key_versions(spark, sf).where("op = 'DELETE'").groupBy("key", "status").agg(F.count("*").alias("n"))


add("delete_outcomes", delete_outcomes, sql(_PLAIN_DONE, "SELECT key, status, count(*) AS n FROM versions WHERE op = 'DELETE' GROUP BY key, status"))

_ANCHOR_COLUMNS = ["shard", "log_index", "request_id", "anchor"]
add("dedup_window", lambda s, d: B.anchored(s, d).select(*_ANCHOR_COLUMNS), sql(B.ANCHORED, "SELECT shard, log_index, request_id, anchor FROM anchored"))


def dup_requests(spark, sf):
    a = B.anchored(spark, sf)
    return C.duplicates(a).select(*_ANCHOR_COLUMNS).withColumn("distance", F.col("log_index") - F.col("anchor"))


add("dup_requests", dup_requests, sql(B.ANCHORED, "SELECT shard, log_index, request_id, anchor, log_index - anchor AS distance FROM anchored WHERE log_index <> anchor"))
add(
    "executed_requests",
    lambda s, d: C.executed(B.anchored(s, d)).select("shard", "log_index", "request_id", "key", "op"),
    sql(B.ANCHORED, "SELECT shard, log_index, request_id, key, op FROM anchored WHERE log_index = anchor"),
)
_RESULT = ["shard", "log_index", "key", "op", "anchor", "status", "version"]
add("apply_results", lambda s, d: B.results(s, d).select(*_RESULT), sql(B.RESULTS, f"SELECT {', '.join(_RESULT)} FROM results"))


def write_outcomes(spark, sf):
    """HTTP status and JSON body of every write."""
    code = F.when(F.col("status") == "OK", 200).when(F.col("status") == "MISMATCH", 412).otherwise(404)
    error = F.when(F.col("status") == "MISMATCH", "version_mismatch").when(F.col("status") == "NOT_FOUND", "not_found")
    body = F.to_json(F.struct(error.alias("error"), "key", "version"))
    return B.results(spark, sf).select("shard", "log_index", code.alias("http_status"), body.alias("body"))


add("write_outcomes", write_outcomes, sql(B.RESULTS, """SELECT shard, log_index,
 CASE status WHEN 'OK' THEN 200 WHEN 'MISMATCH' THEN 412 ELSE 404 END AS http_status,
 concat('{', CASE status WHEN 'MISMATCH' THEN '"error":"version_mismatch",' WHEN 'NOT_FOUND' THEN '"error":"not_found",' ELSE '' END, '"key":"', key, '","version":', version, '}') AS body FROM results"""))


def cas_winners(spark, sf):
    """Create-if-absent attempts and winners by key and the version that they made."""
    e = B.executed(spark, sf).where("has_expected AND expected = 0")
    won = F.col("status") == "OK"
    return e.groupBy("shard", "key").agg(F.count("*").alias("attempts"), F.count_if(won).alias("winners"), F.countDistinct(F.when(won, F.col("version"))).alias("won_versions"))


add("cas_winners", cas_winners, sql(B.EXECUTED, """SELECT shard, key, count(*) AS attempts, count(*) FILTER (WHERE status = 'OK') AS winners,
 count(DISTINCT version) FILTER (WHERE status = 'OK') AS won_versions FROM executed WHERE has_expected AND expected = 0 GROUP BY shard, key"""))


def version_monotonicity(spark, sf):
    """Steps of the version from one success on a key to the next; any step but 1 is a fault."""
    ok = B.executed(spark, sf).where("status = 'OK'")
    before = F.lag("version", 1, 0).over(Window.partitionBy("shard", "key").orderBy("log_index"))
    return ok.withColumn("step", F.col("version") - before).groupBy("shard", "key").agg(F.count("*").alias("writes"), F.count_if(F.col("step") != 1).alias("faults"))


add("version_monotonicity", version_monotonicity, sql(B.EXECUTED, """SELECT shard, key, count(*) AS writes, count(*) FILTER (WHERE step <> 1) AS faults
FROM (SELECT *, version - lag(version, 1, 0) OVER (PARTITION BY shard, key ORDER BY log_index) AS step FROM executed WHERE status = 'OK') GROUP BY shard, key"""))


def error_classification(spark, sf):
    """Expected outcomes are no errors; mismatches and absences are final for the client."""
    kind = F.when(F.col("status") == "OK", "success").otherwise("expected")
    return B.results(spark, sf).groupBy("op", "status").agg(F.count("*").alias("n")).select("op", "status", kind.alias("kind"), F.lit(False).alias("retryable"), "n")


add("error_classification", error_classification, sql(B.RESULTS, """SELECT op, status, CASE WHEN status = 'OK' THEN 'success' ELSE 'expected' END AS kind, false AS retryable, count(*) AS n FROM results GROUP BY op, status"""))

_STATE = "shard, key, value, version, deleted, cacheable, ttl, updated_ms"
add("key_state", lambda s, d: B.state(s, d), sql(B.STATE, f"SELECT {_STATE} FROM state"))
add("snapshot_state", lambda s, d: B.state(s, d).withColumn("size", F.octet_length("key")), sql(B.STATE, f"SELECT {_STATE}, CAST(octet_length(encode(key)) AS INTEGER) AS size FROM state"))
add(
    "live_keys",
    lambda s, d: C.live(B.state(s, d)).select("key", "value", "version", "updated_ms"),
    sql(B.STATE, "SELECT key, value, version, updated_ms FROM state WHERE NOT deleted"),
)
add(
    "live_key_count",
    lambda s, d: B.state(s, d).groupBy("shard").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("records")),
    sql(B.STATE, "SELECT shard, count(*) FILTER (WHERE NOT deleted) AS live, count(*) AS records FROM state GROUP BY shard"),
)
POINT = "task:1:status"


def point_lookup(spark, sf):
    """One key: only commands that share a request id with its own are deduplicated, and only its own folded."""
    shard = B.cmds(spark, sf).where(F.col("shard") == X.shard_of(F.lit(POINT), B.SHARDS))
    ids = shard.where(F.col("key") == POINT).select("request_id").distinct()
    own = C.with_anchors(shard.join(ids, "request_id", "left_semi"), B.DEDUP)
    return C.live(C.state(C.fold(C.executed(own).where(F.col("key") == POINT)))).select("key", "value", "version", X.etag("version").alias("etag"))


add("point_lookup", point_lookup, sql(B.STATE, f"""SELECT key, value, version, concat('"v', version, '"') AS etag FROM state WHERE NOT deleted AND key = '{POINT}'"""))

HALF = 600


def snapshot_restore_roundtrip(spark, sf):
    """State after a snapshot at a log position, written and read back, and the tail folded on from it.

    The tail is deduplicated by the requests that the snapshot remembers: what it executed before is
    not executed again.
    """
    path = shared_path(spark, "snapshot")
    log = settle(B.cmds(spark, sf), "commands")
    head = settle(C.with_anchors(log.where(F.col("log_index") <= HALF), B.DEDUP), "anchored")
    write_snapshot(C.state(C.fold(C.executed(head))), head, path, HALF, B.DEDUP)
    first, remembered = read_snapshot(spark, path)
    # remembered requests stand at their own positions, so windows that began before the snapshot go on
    old = remembered.select("shard", "request_id", F.col("anchor").alias("log_index"), F.lit(True).alias("_old"))
    both = log.where(F.col("log_index") > HALF).withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True)
    rest = C.with_anchors(both, B.DEDUP).where(~F.col("_old")).drop("_old")
    tail = C.resume(first, C.executed(rest))
    new = C.state(tail).select("shard", "key", F.struct("value", "version", "deleted", "cacheable", "ttl", "updated_ms").alias("n"))
    # a key that the tail deletes keeps its restored policy
    merged = first.join(new, ["shard", "key"], "full")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(c)).otherwise(F.col(f"n.{c}"))
    keep = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(c))
    return merged.select("shard", "key", *[(keep(c) if c in ("cacheable", "ttl") else pick(c)).alias(c) for c in ("value", "version", "deleted", "cacheable", "ttl", "updated_ms")])


add("snapshot_restore_roundtrip", snapshot_restore_roundtrip, sql(B.STATE, f"SELECT {_STATE} FROM state"))
add("recover_state", lambda s, d: C.live(snapshot_restore_roundtrip(s, d)).select("shard", "key", "value", "version"), sql(B.STATE, "SELECT shard, key, value, version FROM state WHERE NOT deleted"))

EVERY = 250


def snapshot_points(spark, sf):
    """Log positions at which a snapshot is due, one in every so many applied entries."""
    return B.cmds(spark, sf).where(F.col("log_index") % EVERY == 0).select("shard", "log_index", (F.col("log_index") / EVERY).cast("bigint").alias("snapshot"))


add("snapshot_points", snapshot_points, sql(B.CMDS, f"SELECT shard, log_index, log_index // {EVERY} AS snapshot FROM cmds WHERE log_index % {EVERY} = 0"))
add(
    "log_slice",
    lambda s, d: B.cmds(s, d).where(F.col("log_index").between(101, 400)).select("shard", "log_index", "op", "key"),
    sql(B.CMDS, "SELECT shard, log_index, op, key FROM cmds WHERE log_index > 100 AND log_index <= 400"),
)


def cacheable_namespace(spark, sf):
    return B.state(spark, sf).groupBy(X.in_namespaces("key", B.NAMESPACES).alias("in_namespace")).agg(F.count("*").alias("keys"))


add("cacheable_namespace", cacheable_namespace, sql(B.STATE, "SELECT key LIKE 'config:%' AS in_namespace, count(*) AS keys FROM state GROUP BY 1"))


def cache_admission(spark, sf):
    """Answer of the cache path for each key: namespace first, then existence, then policy."""
    answer = (
        F.when(~X.in_namespaces("key", B.NAMESPACES), "403 namespace")
        .when(F.col("deleted"), "404 not_found")
        .when(~F.col("cacheable"), "403 not_cacheable")
        .otherwise("200")
    )
    return B.state(spark, sf).select("key", answer.alias("answer"))


_ADMIT = "CASE WHEN NOT key LIKE 'config:%' THEN '403 namespace' WHEN deleted THEN '404 not_found' WHEN NOT cacheable THEN '403 not_cacheable' ELSE '200' END"
add("cache_admission", cache_admission, sql(B.STATE, f"SELECT key, {_ADMIT} AS answer FROM state"))


def versioned_read(spark, sf):
    """Reads that name a version: only the current one is served."""
    asked = F.lit("2")
    return C.live(B.state(spark, sf)).select("key", "version", F.when(asked.try_cast("bigint") == F.col("version"), 200).otherwise(404).alias("http_status"))


add("versioned_read", versioned_read, sql(B.STATE, "SELECT key, version, CASE WHEN version = 2 THEN 200 ELSE 404 END AS http_status FROM state WHERE NOT deleted"))


def conditional_read(spark, sf):
    """If-None-Match with the etag of an even guess at the version."""
    guess = X.etag(F.col("version") - F.col("version") % 2)
    return C.live(B.state(spark, sf)).select("key", X.etag("version").alias("etag"), F.when(guess == X.etag("version"), 304).otherwise(200).alias("http_status"))


add("conditional_read", conditional_read, sql(B.STATE, """SELECT key, concat('"v', version, '"') AS etag, CASE WHEN version % 2 = 0 THEN 304 ELSE 200 END AS http_status FROM state WHERE NOT deleted"""))


def cache_headers(spark, sf):
    ttl = X.clamp_ttl("ttl")
    return C.live(B.state(spark, sf)).select(
        "key", X.cache_control("cacheable", ttl).alias("plain"), X.cache_control("cacheable", ttl, True).alias("versioned"), X.etag("version").alias("etag")
    )


_TTL = "CASE WHEN ttl = 0 THEN 30 ELSE least(greatest(ttl, 1), 300) END"
add("cache_headers", cache_headers, sql(B.STATE, f"""SELECT key, CASE WHEN cacheable THEN concat('public, max-age=', {_TTL}) ELSE 'no-store' END AS plain,
CASE WHEN cacheable THEN 'public, max-age=31536000, immutable' ELSE 'no-store' END AS versioned, concat('"v', version, '"') AS etag FROM state WHERE NOT deleted"""))
