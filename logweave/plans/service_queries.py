"""Queries over request bodies, headers, specifications and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from . import bases as B
from .bases import sql, table

CATALOG: dict = {}
MAX_BODY = 1 << 20
BODY_SCHEMA = "value string, request_id string, cache_policy struct<cacheable:boolean,ttl_seconds:int>"
NODES = ("n1", "n2", "n3")


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def bodies(spark, sf):
    """Write requests made from parts: key, body, request id header and expected version.

    Some bodies are no JSON, lack the value or hold one that is no text, have no policy or request
    id, or are over the limit; some expected versions are no whole numbers.
    """
    p, i = table(spark, sf, "part"), F.col("p_partkey")
    policy = F.when(F.col("p_size") % 4 != 3, F.concat(F.lit(',"cache_policy":{"cacheable":'), F.when(F.col("p_size") % 2 == 1, "true").otherwise("false"), F.lit(',"ttl_seconds":'), F.col("p_size") * 10 % 370, F.lit("}"))).otherwise("")
    request = F.when(i % 5 == 0, F.concat(F.lit(',"request_id":"b-'), i, F.lit('"'))).otherwise("")
    text = F.when(i % 97 == 5, F.rpad("p_name", MAX_BODY, "x")).otherwise(F.col("p_name"))
    value = F.when(i % 29 == 0, '"none":0').when(i % 31 == 0, '"value":5').when(i % 37 == 0, '"value":null').otherwise(F.concat(F.lit('"value":"'), text, F.lit('"')))
    body = F.when(i % 41 == 0, "{not json").when(i % 43 == 0, "{}").otherwise(F.concat(F.lit("{"), value, request, policy, F.lit("}")))
    key = F.when(i % 2 == 0, F.concat(F.lit("config:"), F.col("p_brand"))).otherwise(F.concat(F.lit("task:"), F.col("p_brand")))
    header = F.when(i % 3 == 0, F.concat(F.lit("h-"), i)).otherwise("")
    expected = F.when(i % 23 == 0, "-1").when(i % 19 == 0, "two").when(i % 7 == 0, (i % 5).cast("string")).otherwise("")
    return p.select("p_partkey", key.alias("key"), body.alias("body"), header.alias("header_id"), expected.alias("expected"))


BODIES = f"""bodies AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'config:' ELSE 'task:' END || p_brand AS key,
 p_partkey % 41 = 0 AS broken, p_partkey % 41 <> 0 AND p_partkey % 43 = 0 AS bare, p_partkey % 97 = 5 AND p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 37 <> 0 AS huge,
 p_partkey % 29 <> 0 AND p_partkey % 31 = 0 AND p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 AS no_text,
 CASE WHEN p_partkey % 43 = 0 OR p_partkey % 29 = 0 OR p_partkey % 37 = 0 THEN '' ELSE p_name END AS text,
 CASE WHEN p_partkey % 43 <> 0 AND p_size % 4 <> 3 THEN p_size % 2 = 1 END AS cacheable, CASE WHEN p_partkey % 43 <> 0 AND p_size % 4 <> 3 THEN p_size * 10 % 370 END AS ttl,
 CASE WHEN p_partkey % 43 <> 0 AND p_partkey % 5 = 0 THEN 'b-' || p_partkey ELSE '' END AS body_id, CASE WHEN p_partkey % 3 = 0 THEN 'h-' || p_partkey ELSE '' END AS header_id,
 CASE WHEN p_partkey % 23 = 0 THEN '-1' WHEN p_partkey % 19 = 0 THEN 'two' WHEN p_partkey % 7 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) ELSE '' END AS expected FROM part),
answers AS (SELECT *, CASE WHEN huge THEN '413 body_too_large' WHEN broken OR no_text THEN '400 bad_json' WHEN expected IN ('-1', 'two') THEN '400 bad_expected_version'
 WHEN coalesce(cacheable, false) AND NOT key LIKE 'config:%' THEN '400 namespace_not_cacheable' ELSE 'accepted' END AS answer FROM bodies)"""


def answered(spark, sf):
    """Every request with its parsed body and the answer, in the order in which a server checks."""
    kind = F.expr("schema_of_variant(variant_get(try_parse_json(body), '$.value', 'variant'))")
    j = F.when(F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID"), F.from_json("body", BODY_SCHEMA))
    number = F.coalesce(F.regexp_like("expected", F.lit("^[0-9]+$")), F.lit(False))
    answer = (
        F.when(F.octet_length("body") > MAX_BODY, "413 body_too_large")
        .when(F.expr("try_parse_json(body)").isNull() | F.col("j").isNull(), "400 bad_json")
        .when((F.col("expected") != "") & ~number, "400 bad_expected_version")
        .when(F.coalesce("j.cache_policy.cacheable", F.lit(False)) & ~X.in_namespaces("key", B.NAMESPACES), "400 namespace_not_cacheable")
        .otherwise("accepted")
    )
    return bodies(spark, sf).withColumn("j", j).withColumn("answer", answer)


def parse_put_bodies(spark, sf):
    """Bodies as commands: a missing value is empty; body id before header id before one made from the row."""
    request = X.first_non_empty("j.request_id", "header_id", F.concat(F.lit("auto-"), F.col("p_partkey")))
    return answered(spark, sf).where("answer = 'accepted'").select(
        "p_partkey", "key", F.coalesce("j.value", F.lit("")).alias("value"), request.alias("request_id"),
        F.coalesce("j.cache_policy.cacheable", F.lit(False)).alias("cacheable"), X.clamp_ttl("j.cache_policy.ttl_seconds").alias("ttl"),
        (F.col("expected") != "").alias("has_expected"), F.coalesce(F.col("expected").try_cast("bigint"), F.lit(0)).alias("expected"),
    )


_CLAMP = "CASE WHEN coalesce(ttl, 0) = 0 THEN 30 ELSE least(greatest(ttl, 1), 300) END"
add("parse_put_bodies", parse_put_bodies, sql(BODIES, f"""SELECT p_partkey, key, text AS value, coalesce(nullif(body_id, ''), nullif(header_id, ''), 'auto-' || p_partkey) AS request_id,
coalesce(cacheable, false) AS cacheable, CAST({_CLAMP} AS INTEGER) AS ttl, expected <> '' AS has_expected, CASE WHEN expected = '' THEN 0 ELSE CAST(expected AS BIGINT) END AS expected FROM answers WHERE answer = 'accepted'"""))


def put_validation(spark, sf):
    return answered(spark, sf).groupBy("answer").agg(F.count("*").alias("n"))


add("put_validation", put_validation, sql(BODIES, "SELECT answer, count(*) AS n FROM answers GROUP BY answer"))


def ttl_clamp(spark, sf):
    asked = (F.col("p_size") * 9 - 9).cast("int")
    return table(spark, sf, "part").groupBy(asked.alias("asked"), X.clamp_ttl(asked).alias("ttl")).agg(F.count("*").alias("n"))


add("ttl_clamp", ttl_clamp, """SELECT asked, CAST(CASE WHEN asked = 0 THEN 30 ELSE least(greatest(asked, 1), 300) END AS INTEGER) AS ttl, count(*) AS n
FROM (SELECT CAST(p_size * 9 - 9 AS INTEGER) AS asked FROM part) GROUP BY 1, 2""")


def route_class(spark, sf):
    """Only GET requests under the cache path can be answered from a cache."""
    kind = F.element_at(F.array(*map(F.lit, ("GET /v1/cache/", "PUT /v1/kv/", "GET /v1/kv/", "POST /v1/cache/"))), (F.col("page_id") % 4 + 1).cast("int"))
    line = table(spark, sf, "pages").select("page_id", F.concat(kind, F.substring_index("url", "/", -1)).alias("line"))
    return line.select("page_id", F.when(F.startswith("line", F.lit("GET /v1/cache/")), "cache").otherwise("pass").alias("route"))


add("route_class", route_class, "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'cache' ELSE 'pass' END AS route FROM pages")


def routing_outcome(spark, sf):
    """What a node does with a request, from who leads and how the request came."""
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 4).alias("leader"), (F.col("c_nationkey") % 3 == 0).alias("forwarded"), (F.col("c_acctbal") < 0).alias("no_forward")
    )
    out = (
        F.when(F.col("leader") == 0, "503 unavailable")
        .when(F.col("leader") == 1, "serve")
        .when(F.col("forwarded") | F.col("no_forward"), "421 not_leader")
        .otherwise("forward")
    )
    return c.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


add("routing_outcome", routing_outcome, """SELECT CASE WHEN c_custkey % 4 = 0 THEN '503 unavailable' WHEN c_custkey % 4 = 1 THEN 'serve'
WHEN c_nationkey % 3 = 0 OR c_acctbal < 0 THEN '421 not_leader' ELSE 'forward' END AS outcome, count(*) AS n FROM customer GROUP BY 1""")

_HEADERS = ("public, max-age=%", "no-store", "max-age=%, immutable", "public,max-age= x%", "public", "max-age=-%")


def parse_max_age(spark, sf):
    n = F.col("n_nationkey")
    header = F.replace(F.element_at(F.array(*map(F.lit, _HEADERS)), (n % 6 + 1).cast("int")), F.lit("%"), (n * 13).cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", X.max_age(header).alias("max_age"), (F.instr(header, "no-store") > 0).alias("no_store"))


add("parse_max_age", parse_max_age, """SELECT n_nationkey, CAST(CASE n_nationkey % 6 WHEN 0 THEN n_nationkey * 13 WHEN 2 THEN n_nationkey * 13 WHEN 5 THEN -(n_nationkey * 13) ELSE 0 END AS INTEGER) AS max_age,
n_nationkey % 6 = 1 AS no_store FROM nation""")


def x_cache_parse(spark, sf):
    """Cache label and age headers as a client reads them."""
    u = F.col("event_id") % 5
    label = F.element_at(F.array(*map(F.lit, ("Hit", "hit from edge", "RefreshHit", "Miss", "HIT"))), (u + 1).cast("int"))
    age = F.when(u == 3, "soon").otherwise((F.col("event_id") % 90).cast("string"))
    hit = F.startswith(F.lower(label), F.lit("hit"))
    return table(spark, sf, "events").groupBy(label.alias("label"), hit.alias("from_cache")).agg(F.count("*").alias("n"), F.sum(F.coalesce(age.try_cast("bigint"), F.lit(0))).alias("age_seconds"))


add("x_cache_parse", x_cache_parse, """SELECT label, label IN ('Hit', 'hit from edge', 'HIT') AS from_cache, count(*) AS n, CAST(sum(age) AS BIGINT) AS age_seconds FROM
(SELECT CASE event_id % 5 WHEN 0 THEN 'Hit' WHEN 1 THEN 'hit from edge' WHEN 2 THEN 'RefreshHit' WHEN 3 THEN 'Miss' ELSE 'HIT' END AS label, CASE WHEN event_id % 5 = 3 THEN 0 ELSE event_id % 90 END AS age FROM events) GROUP BY 1, 2""")


def parse_cluster_spec(spark, sf):
    """``id=raft|http,...`` per region as one row a member."""
    r = F.col("r_regionkey").cast("string")
    spec = F.array_join(F.transform(F.array(*map(F.lit, NODES)), lambda n: F.concat(n, F.lit("="), n, F.lit(".r"), r, F.lit(":7000|http://"), n, F.lit(".r"), r, F.lit(":8000"))), ", ")
    member = F.trim(F.col("member"))
    part = lambda i: F.regexp_extract(member, r"^([^=]+)=([^|]+)\|(.+)$", i)
    return table(spark, sf, "region").select("r_regionkey", F.explode(F.split(spec, ",")).alias("member")).select("r_regionkey", part(1).alias("id"), part(2).alias("raft"), part(3).alias("http"))


add("parse_cluster_spec", parse_cluster_spec, """SELECT r_regionkey, id, id || '.r' || r_regionkey || ':7000' AS raft, 'http://' || id || '.r' || r_regionkey || ':8000' AS http
FROM region, (VALUES ('n1'), ('n2'), ('n3')) v(id)""")


def parse_mix(spark, sf):
    """``get=80,put=15,delete=5`` as cumulative bounds of a draw."""
    n = F.col("n_nationkey")
    mix = F.concat(F.lit("get="), 80 - n, F.lit(", put="), 15 + n, F.lit(",delete=5"))
    rows = table(spark, sf, "nation").select("n_nationkey", F.posexplode(F.split(mix, ",")).alias("pos", "item"))
    share = F.split_part("item", F.lit("="), F.lit(2)).try_cast("int")
    from pyspark.sql import Window

    upto = F.sum("share").over(Window.partitionBy("n_nationkey").orderBy("pos"))
    return rows.select("n_nationkey", "pos", F.trim(F.split_part("item", F.lit("="), F.lit(1))).alias("op"), share.alias("share")).withColumn("upto", upto)


add("parse_mix", parse_mix, """SELECT n_nationkey, pos, op, share, CAST(sum(share) OVER (PARTITION BY n_nationkey ORDER BY pos) AS BIGINT) AS upto FROM (
SELECT n_nationkey, v.pos, v.op, CAST(CASE v.pos WHEN 0 THEN 80 - n_nationkey WHEN 1 THEN 15 + n_nationkey ELSE 5 END AS INTEGER) AS share
FROM nation, (VALUES (0, 'get'), (1, 'put'), (2, 'delete')) v(pos, op))""")


def retry_schedule(spark, sf):
    attempts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("attempt"))
    return attempts.select("attempt", X.backoff_ms("attempt").alias("client_ms"), F.when(F.col("attempt") < 4, X.backoff_ms("attempt", 100, 3)).alias("purge_ms"))


add("retry_schedule", retry_schedule, """SELECT n_nationkey AS attempt, CAST(20 * pow(2, least(n_nationkey, 5)) AS BIGINT) AS client_ms,
CASE WHEN n_nationkey < 4 THEN CAST(100 * pow(2, n_nationkey) AS BIGINT) END AS purge_ms FROM nation""")


def bench_keys(spark, sf):
    key = X.bench_key("c_custkey", 0.25)
    return table(spark, sf, "customer").select("c_custkey", key.alias("key"), X.shard_of(key, B.SHARDS).alias("shard"))


_BENCH = "CASE WHEN (c_custkey % 1000) / 1000.0 < 0.25 THEN concat('config:item:', c_custkey) ELSE concat('task:', c_custkey, ':status') END"
add("bench_keys", bench_keys, f"SELECT c_custkey, key, CAST({B.fnv_sql('key')} % 3 AS INTEGER) AS shard FROM (SELECT c_custkey, {_BENCH} AS key FROM customer)")


def preferred_leaders(spark, sf):
    """Shards round-robin over the sorted peers."""
    peers = F.array_sort(F.array(*map(F.lit, reversed(NODES))))
    return B.unplaced(spark, sf).select("shard").distinct().select("shard", F.element_at(peers, F.col("shard") % len(NODES) + 1).alias("leader"))


add("preferred_leaders", preferred_leaders, sql(B.CMDS, "SELECT DISTINCT shard, concat('n', shard % 3 + 1) AS leader FROM cmds"))


def leader_urls(spark, sf):
    """The address that each leader announced last; every nation is an announcement of some node."""
    n = F.col("n_nationkey")
    peers = table(spark, sf, "nation").groupBy(F.concat(F.lit("n"), n % 4 + 1).alias("leader")).agg(F.concat(F.lit("http://"), F.lower(F.max_by("n_name", n))).alias("url"))
    return preferred_leaders(spark, sf).join(peers, "leader", "left").select("shard", "leader", "url")


add("leader_urls", leader_urls, sql(B.CMDS, """SELECT DISTINCT shard, concat('n', shard % 3 + 1) AS leader, url FROM cmds LEFT JOIN
(SELECT n_nationkey % 4 AS node, 'http://' || lower(arg_max(n_name, n_nationkey)) AS url FROM nation GROUP BY 1) ON node = shard % 3"""))


def route_keys(spark, sf):
    """Key to shard to the leader that a client knows; the first node where it knows none."""
    keys = B.keyed(spark, sf).select("key").distinct().withColumn("shard", X.shard_of("key", B.SHARDS))
    known = preferred_leaders(spark, sf).where(F.col("shard") != 1)
    return keys.join(known, "shard", "left").select("key", "shard", F.coalesce("leader", F.lit("n1")).alias("node"))


add("route_keys", route_keys, sql(B.KEYED, f"""SELECT key, shard, CASE WHEN shard = 1 THEN 'n1' ELSE concat('n', shard % 3 + 1) END AS node
FROM (SELECT key, CAST({B.fnv_sql('key')} % 3 AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM keyed))"""))
