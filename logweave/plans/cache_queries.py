"""Queries over the cache model: traces, staleness and invalidation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.caching import cache_steps, coalesce_invalidations, served
from ..operators.sequential import as_of
from ..shared import settle
from . import bases as B
from .bases import sql, table

CATALOG: dict = {}
DELAY_MS = 20_000
#: Time after which as-of joins divide a key.
STRIDE_MS = 1 << 24
PREFIX = "/v1/cache/"


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def writes(spark, sf):
    """Successful writes with their trace time, folded once and written: every use reads the result."""
    done = B.executed(spark, sf).where("status = 'OK'").select("key", (F.col("event_id") * 1000).alias("t"), "op", "version", "cacheable", "ttl")
    return settle(done, "writes")


def reads(spark, sf, w):
    """Cache reads with the origin's answer: the key's last write before the read; some get none."""
    asked = B.keyed(spark, sf).where("event_type = 'view'").select("key", (F.col("event_id") * 1000).alias("t"), F.col("event_id").alias("read_id"))
    asked = asked.where(X.in_namespaces("key", B.NAMESPACES))
    seen = as_of(asked, w, ["key"], "t", ["op", "version", "cacheable", "ttl"], stride=STRIDE_MS)
    ok = F.when(F.col("read_id") % 17 != 0, F.coalesce((F.col("op") == "PUT") & F.col("cacheable"), F.lit(False)))
    return seen.select(F.concat(F.lit(PREFIX), X.path_escape("key")).alias("uri"), "key", "t", "read_id", ok.alias("ok"), "version", X.clamp_ttl("ttl").alias("ttl"))


def invalidations(w, delay=0):
    """Every write in the namespace invalidates its path, cacheable or not."""
    own = w.where(X.in_namespaces("key", B.NAMESPACES))
    return own.select(F.concat(F.lit(PREFIX), X.path_escape("key")).alias("uri"), (F.col("t") + delay).alias("t"))


def steps(spark, sf, delay: int | None, w):
    gone = invalidations(w, delay or 0)
    return cache_steps(reads(spark, sf, w), gone.limit(0) if delay is None else gone)


def trace(spark, sf, delay: int | None = 0, w=None):
    """``delay`` None: every invalidation fails."""
    return served(steps(spark, sf, delay, writes(spark, sf) if w is None else w))


_WRITES = B.EXECUTED + """,
writes AS (SELECT key, event_id * 1000 AS t, op, version, cacheable, ttl FROM executed WHERE status = 'OK'),
asked AS (SELECT key, event_id * 1000 AS t, event_id AS read_id FROM keyed WHERE event_type = 'view' AND key LIKE 'config:%'),
reads AS (SELECT concat('/v1/cache/', a.key) AS uri, a.key, a.t, a.read_id, CASE WHEN a.read_id % 17 <> 0 THEN coalesce(w.op = 'PUT' AND w.cacheable, false) END AS ok, w.version,
  CASE WHEN coalesce(w.ttl, 0) = 0 THEN 30 ELSE least(greatest(w.ttl, 1), 300) END AS ttl
  FROM asked a ASOF LEFT JOIN writes w ON w.key = a.key AND w.t < a.t)"""


def _trace_sql(delay: int | None) -> str:
    some, delay = "false" if delay is None else "true", delay or 0
    return _WRITES + f""",
trace_rows AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY t, kind, read_id) AS rn FROM (
  SELECT uri, t, 1 AS kind, read_id, ok, version, ttl FROM reads UNION ALL
  SELECT concat('/v1/cache/', key), t + {delay}, 0, NULL, false, NULL, NULL FROM writes WHERE {some} AND key LIKE 'config:%')),
steps AS (SELECT DISTINCT uri, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS read_id, CAST(NULL AS BIGINT) AS ver, CAST(NULL AS BIGINT) AS fetched, CAST(NULL AS BIGINT) AS expires,
    CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS served, CAST(NULL AS BIGINT) AS age, false AS asked_origin FROM trace_rows
  UNION ALL
  SELECT r.uri, r.rn, r.t, r.read_id,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN s.ver WHEN r.ok THEN r.version ELSE s.ver END,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN s.fetched WHEN r.ok THEN r.t ELSE s.fetched END,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN s.expires WHEN r.ok THEN r.t + 1000 * r.ttl ELSE s.expires END,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN 'Hit' WHEN r.ok IS NULL AND s.ver IS NULL THEN 'Error' WHEN r.ok IS NULL THEN 'Stale' WHEN r.ok AND s.ver = r.version THEN 'RefreshHit' ELSE 'Miss' END,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN s.ver WHEN r.ok IS NULL THEN s.ver WHEN r.ok THEN r.version END,
    CASE WHEN r.kind = 0 THEN NULL WHEN s.ver IS NOT NULL AND r.t < s.expires THEN (r.t - s.fetched) // 1000 WHEN r.ok IS NULL THEN (r.t - s.fetched) // 1000 WHEN r.ok THEN 0 END,
    r.kind = 1 AND NOT (s.ver IS NOT NULL AND r.t < s.expires)
  FROM steps s JOIN trace_rows r ON r.uri = s.uri AND r.rn = s.rn + 1),
trace AS (SELECT uri, t, read_id, label, served, age, asked_origin FROM steps WHERE label IS NOT NULL)"""


_TRACE = "SELECT uri, t, read_id, label, served, age, asked_origin FROM trace"
add("cache_trace", lambda s, d: trace(s, d), sql(_trace_sql(0), _TRACE))
add("cache_trace_delayed", lambda s, d: trace(s, d, DELAY_MS), sql(_trace_sql(DELAY_MS), _TRACE))

add("cache_trace_failed_invalidation", lambda s, d: trace(s, d, None), sql(_trace_sql(None), _TRACE))


def edge_stats(spark, sf):
    """Counters of an edge whose invalidations are late, and of one whose invalidations fail."""
    w = writes(spark, sf)
    asked = invalidations(w).agg(F.count("*")).scalar()
    n = {k: F.sum(k) for k in ("hits", "misses", "refresh_hits", "origin_requests", "entries")}
    counted = {"hits": F.col("label") == "Hit", "misses": F.col("label") == "Miss", "refresh_hits": F.col("label") == "RefreshHit", "origin_requests": F.col("asked_origin")}
    last = F.max_by("held", F.struct("t", "kind", "read_id"))
    good, all_ = n["hits"] + n["refresh_hits"], n["hits"] + n["refresh_hits"] + n["misses"]
    ratio = F.round(F.when(all_ > 0, good / all_).otherwise(0.0), 6)

    def of(mode, delay, took, failed):
        # one row an entry's address, then one row
        by_uri = steps(spark, sf, delay, w).groupBy("uri").agg(*[F.count_if(c).alias(k) for k, c in counted.items()], last.cast("long").alias("entries"))
        return by_uri.agg(*[c.alias(k) for k, c in n.items()], ratio.alias("hit_ratio")).select(F.lit(mode).alias("mode"), "*", took.alias("invalidations"), failed.alias("failed_invalidations"))

    none = F.lit(0).cast("bigint")
    return of("late", DELAY_MS, asked, none).unionByName(of("failing", None, none, asked))


def _stats_sql(delay: int | None, mode: str) -> str:
    sent = "(SELECT count(*) FROM writes WHERE key LIKE 'config:%')"
    return _trace_sql(delay) + f""" SELECT '{mode}' AS mode, count(*) FILTER (WHERE label = 'Hit') AS hits, count(*) FILTER (WHERE label = 'Miss') AS misses, count(*) FILTER (WHERE label = 'RefreshHit') AS refresh_hits,
count(*) FILTER (WHERE asked_origin) AS origin_requests, (SELECT count(*) FROM (SELECT uri, arg_max(coalesce(ver, -1), rn) AS v FROM steps GROUP BY uri) WHERE v >= 0) AS entries,
round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE label IN ('Hit', 'RefreshHit')) / count(*) FILTER (WHERE label IN ('Hit', 'RefreshHit', 'Miss')) ELSE 0.0 END, 6) AS hit_ratio,
{"CAST(0 AS BIGINT)" if delay is None else sent} AS invalidations, {sent if delay is None else "CAST(0 AS BIGINT)"} AS failed_invalidations FROM trace"""


add("edge_stats", edge_stats, f"SELECT * FROM (WITH RECURSIVE {_stats_sql(DELAY_MS, 'late')}) UNION ALL SELECT * FROM (WITH RECURSIVE {_stats_sql(None, 'failing')})")


def cache_hit_ratio(spark, sf):
    """As a client counts: a refreshed entry is no hit."""
    hit = F.count_if(F.startswith(F.lower("label"), F.lit("hit")))
    return trace(spark, sf, DELAY_MS).groupBy("uri").agg(F.count("*").alias("reads"), hit.alias("hits"), F.round(hit / F.greatest(F.lit(1), F.count("*")), 6).alias("hit_ratio"))


add("cache_hit_ratio", cache_hit_ratio, sql(_trace_sql(DELAY_MS), """SELECT uri, count(*) AS reads, count(*) FILTER (WHERE label = 'Hit') AS hits, round(count(*) FILTER (WHERE label = 'Hit') / greatest(1, count(*)), 6) AS hit_ratio FROM trace GROUP BY uri"""))


def stale_reads(spark, sf):
    """Reads that served an older version than the latest acknowledged PUT before they began.

    ``staleness_ms`` counts from that latest PUT, ``stale_since_ms`` from the first PUT after the
    served version.
    """
    w = writes(spark, sf)
    served = trace(spark, sf, DELAY_MS, w).where("served IS NOT NULL").withColumn("key", F.replace("uri", F.lit(PREFIX), F.lit("")))
    served = served.withColumn("key", F.url_decode("key"))
    acks = w.where("op = 'PUT'").select("key", "t", F.col("version").alias("latest"))
    late = as_of(served, acks, ["key"], "t", ["latest"], stride=STRIDE_MS).where("latest > served")
    after = Window.partitionBy("key").orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, -1)
    put_t = F.when(F.col("op") == "PUT", F.col("t"))
    superseded = w.withColumn("since", F.last(put_t, ignorenulls=True).over(after)).select("key", F.col("version").alias("served"), "since")
    return late.join(superseded, ["key", "served"], "left").select(
        "key", "read_id", "served", "latest", (F.col("t") - F.col("t_right")).alias("staleness_ms"), (F.col("t") - F.col("since")).alias("stale_since_ms")
    )


_STALE = _trace_sql(DELAY_MS) + """,
served AS (SELECT replace(uri, '/v1/cache/', '') AS key, t, read_id, served FROM trace WHERE served IS NOT NULL),
acks AS (SELECT key, t, version AS latest FROM writes WHERE op = 'PUT'),
stale AS (SELECT s.key, s.read_id, s.served, a.latest, s.t - a.t AS staleness_ms,
  s.t - (SELECT min(b.t) FROM acks b WHERE b.key = s.key AND b.latest > s.served) AS stale_since_ms
  FROM served s ASOF JOIN acks a ON a.key = s.key AND a.t < s.t WHERE a.latest > s.served)"""
add("stale_reads", stale_reads, sql(_STALE, "SELECT key, read_id, served, latest, staleness_ms, stale_since_ms FROM stale"))


def staleness_summary(spark, sf):
    return stale_reads(spark, sf).groupBy("key").agg(F.count("*").alias("stale"), F.max("staleness_ms").alias("max_staleness_ms"), F.max("stale_since_ms").alias("max_stale_since_ms"))


add("staleness_summary", staleness_summary, sql(_STALE, "SELECT key, count(*) AS stale, max(staleness_ms) AS max_staleness_ms, max(stale_since_ms) AS max_stale_since_ms FROM stale GROUP BY key"))

PAUSE_MS = 5_000


def invalidation_batches(spark, sf):
    """Writes in cacheable namespaces, coalesced per shard queue; paths as one text."""
    w = B.executed(spark, sf).where("status = 'OK'").where(X.in_namespaces("key", B.NAMESPACES))
    paths = w.select(F.col("shard").alias("queue"), (F.col("event_id") * 1000).alias("t"), F.concat(F.lit(PREFIX), "key").alias("path"))
    return coalesce_invalidations(paths, PAUSE_MS).select("queue", "batch", "requests", F.array_join("paths", " ").alias("paths"))


add("invalidation_batches", invalidation_batches, sql(B.EXECUTED + f""",
q AS (SELECT shard AS queue, event_id * 1000 AS t, '/v1/cache/' || key AS path, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM executed WHERE status = 'OK' AND key LIKE 'config:%'),
b AS (SELECT queue, rn, t, path, t AS batch FROM q WHERE rn = 1 UNION ALL
  SELECT q.queue, q.rn, q.t, q.path, CASE WHEN q.t - b.batch <= {PAUSE_MS} THEN b.batch ELSE q.t END FROM b JOIN q ON q.queue = b.queue AND q.rn = b.rn + 1)""",
    "SELECT queue, batch, count(*) AS requests, string_agg(DISTINCT path, ' ' ORDER BY path) AS paths FROM b GROUP BY queue, batch"))


def invalidated_entries(spark, sf):
    """Entries that a path's invalidation drops: the path and its variants with a query string.

    The entry's URI is cut at its question mark, so this is an equi-join.
    """
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("uri"))
    entries = pages.withColumn("path", F.substring_index("uri", "?", 1))
    dropped = pages.where(F.col("page_id") % 10 == 0).select(F.substring_index("uri", "?", 1).alias("path")).distinct()
    return entries.join(dropped, "path").select("page_id", "path", "uri")


add("invalidated_entries", invalidated_entries, """WITH e AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS uri FROM pages),
d AS (SELECT DISTINCT split_part(uri, '?', 1) AS path FROM e WHERE page_id % 10 = 0)
SELECT e.page_id, d.path, e.uri FROM e JOIN d ON e.uri = d.path OR starts_with(e.uri, d.path || '?')""")
