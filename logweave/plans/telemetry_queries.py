"""Queries over request samples, benchmark runs and metric series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.ranks import percentiles
from . import bases as B
from .bases import sql, table

CATALOG: dict = {}


def add(name, query, oracle=None):
    CATALOG[name] = (query, oracle)


def samples(spark, sf):
    """op, latency, error; the first day is warm-up and left out."""
    r = B.raw(spark, sf)
    start = r.agg(F.min("ts") + F.expr("INTERVAL 1 DAY")).scalar()
    return r.where(F.col("ts") >= start).select(F.col("event_type").alias("op"), F.col("value").alias("ms"), (F.col("k") == 0).alias("error"), "event_id", "user_id")


SAMPLES = B.RAW + """, samples AS (SELECT event_type AS op, value AS ms, k = 0 AS error, event_id, user_id FROM raw WHERE ts >= (SELECT min(ts) FROM raw) + INTERVAL 1 DAY)"""

add(
    "request_counters",
    lambda s, d: samples(s, d).groupBy("op", F.when(F.col("error"), 503).otherwise(200).alias("code")).agg(F.count("*").alias("n")),
    sql(SAMPLES, "SELECT op, CASE WHEN error THEN 503 ELSE 200 END AS code, count(*) AS n FROM samples GROUP BY 1, 2"),
)
_BOUNDS = ", ".join(f"({b})" for b in X.HISTOGRAM_BOUNDS)


def latency_histogram(spark, sf):
    return samples(spark, sf).groupBy("op", X.histogram_bucket(F.col("ms") / 1000).alias("le")).agg(F.count("*").alias("n"))


_LE = f"coalesce((SELECT min(b) FROM (VALUES {_BOUNDS}) v(b) WHERE ms / 1000 <= b), CAST('Infinity' AS DOUBLE))"
_HIST = SAMPLES + f", placed AS (SELECT op, CAST({_LE} AS DOUBLE) AS le FROM samples)"
add("latency_histogram", latency_histogram, sql(_HIST, "SELECT op, le, count(*) AS n FROM placed GROUP BY 1, 2"))


def histogram_cumulative(spark, sf):
    """Every bound with the number of samples at or below it, by op."""
    found = latency_histogram(spark, sf)
    bounds = found.select("op").distinct().select("op", F.explode(F.array(*map(F.lit, [*X.HISTOGRAM_BOUNDS, float("inf")]))).alias("le"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("op").orderBy("le"))
    return bounds.join(found, ["op", "le"], "left").select("op", "le", upto.alias("cumulative"))


add("histogram_cumulative", histogram_cumulative, sql(_HIST + f", bounds AS (SELECT DISTINCT op, b.le FROM placed, (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) v(b) UNION ALL SELECT CAST('Infinity' AS DOUBLE)) b)",
    "SELECT b.op, b.le, count(p.op) AS cumulative FROM bounds b LEFT JOIN placed p ON p.op = b.op AND p.le <= b.le GROUP BY b.op, b.le"))




def latency_by_op(spark, sf):
    """Percentiles of every op and of all together, by exact rank."""
    rows = samples(spark, sf).where("NOT error").select(F.explode(F.array("op", F.lit("all"))).alias("op"), "ms")
    return percentiles(rows, ["op"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def _pick(p):
    return f"list_sort(list(ms))[least(count(*) - 1, CAST(floor(count(*) * CAST({p} AS DOUBLE)) AS BIGINT)) + 1]"


_PCT = f"{_pick(0.5)} AS p50, {_pick(0.95)} AS p95, {_pick(0.99)} AS p99, max(ms) AS max, count(*) AS n"
add("latency_by_op", latency_by_op, sql(SAMPLES, f"SELECT coalesce(op, 'all') AS op, {_PCT} FROM samples WHERE NOT error GROUP BY GROUPING SETS ((op), ())"))


def latency_percentiles(spark, sf):
    """The same rule over the samples of each user."""
    return percentiles(samples(spark, sf), ["user_id"], "ms", {"p50": 0.5, "p95": 0.95})


add("latency_percentiles", latency_percentiles, sql(SAMPLES, f"SELECT user_id, {_pick(0.5)} AS p50, {_pick(0.95)} AS p95, max(ms) AS max, count(*) AS n FROM samples GROUP BY user_id"))


def throughput(spark, sf):
    n = F.count("*") - F.count_if("error")
    return samples(spark, sf).groupBy("op").agg(F.count("*").alias("ops"), F.count_if("error").alias("errors"), F.round(n / F.lit(10.0), 6).alias("ops_per_s"))


add("throughput", throughput, sql(SAMPLES, "SELECT op, count(*) AS ops, count(*) FILTER (WHERE error) AS errors, round((count(*) - count(*) FILTER (WHERE error)) / 10.0, 6) AS ops_per_s FROM samples GROUP BY op"))


def runs(spark, sf):
    """Benchmark runs: each name ran at several client counts and positions."""
    u = F.col("user_id")
    clients = F.element_at(F.array(*map(F.lit, (1, 10, 50, 100, 500))), (u % 5 + 1).cast("int"))
    return B.raw(spark, sf).select(F.concat(F.lit("run-clients-"), u % 20).alias("name"), "event_id", clients.alias("clients"), (F.col("k") * 100 + 7).alias("ops"), (F.col("k") % 3).alias("errors"), F.col("value").alias("p50"))


RUNS = B.RAW + """, runs AS (SELECT concat('run-clients-', user_id % 20) AS name, event_id, CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 100 ELSE 500 END AS clients,
 k * 100 + 7 AS ops, k % 3 AS errors, value AS p50 FROM raw),
latest AS (SELECT regexp_replace(name, '^run-', '') AS name, arg_max(clients, event_id) AS clients, arg_max(ops, event_id) AS ops, arg_max(errors, event_id) AS errors, arg_max(p50, event_id) AS p50, max(event_id) AS event_id FROM runs GROUP BY 1)"""


def latest_run_per_name(spark, sf):
    name = F.regexp_replace("name", "^run-", "")
    last = F.max_by(F.struct("clients", "ops", "errors", "p50", "event_id"), "event_id")
    return runs(spark, sf).groupBy(name.alias("name")).agg(last.alias("r")).select("name", "r.*")


add("latest_run_per_name", latest_run_per_name, sql(RUNS, "SELECT name, clients, ops, errors, p50, event_id FROM latest"))


def bench_summary(spark, sf):
    """One Markdown line a run."""
    r = latest_run_per_name(spark, sf)
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.col("ops") - F.col("errors"), F.lit(" | "), F.col("errors"), F.lit(" | "), F.col("clients"), F.lit(" |"))
    return r.select("name", line.alias("line"))


add("bench_summary", bench_summary, sql(RUNS, "SELECT name, concat('| ', name, ' | ', ops - errors, ' | ', errors, ' | ', clients, ' |') AS line FROM latest"))


def concurrency_curve(spark, sf):
    return latest_run_per_name(spark, sf).groupBy("clients").agg(F.max("ops").alias("best_ops"), F.count("*").alias("runs")).orderBy("clients")


add("concurrency_curve", concurrency_curve, sql(RUNS, "SELECT clients, max(ops) AS best_ops, count(*) AS runs FROM latest GROUP BY clients ORDER BY clients"))


def prometheus_lines(spark, sf):
    """Counter series of orders in text form, one line a series, help lines first."""
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("v"))
    labels = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    lines = n.select(F.concat(X.series_key(F.lit("requests_total"), labels), F.lit(" "), X.metric_number("v")).alias("line"))
    head = spark.createDataFrame([("# TYPE requests_total counter",)], "line string")
    return head.unionByName(lines).orderBy("line")


add("prometheus_lines", prometheus_lines, """SELECT '# TYPE requests_total counter' AS line UNION ALL
SELECT concat('requests_total{priority="', o_orderpriority, '",status="', o_orderstatus, '"} ', count(*)) FROM orders GROUP BY o_orderpriority, o_orderstatus""")


def parse_lines(lines):
    """name, labels and value of text-format lines; comments are skipped."""
    parsed = lines.where(~F.startswith("line", F.lit("#"))).select(
        F.regexp_extract("line", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1).alias("name"),
        F.map_from_arrays(
            F.regexp_extract_all("line", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), 1), F.regexp_extract_all("line", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), 2)
        ).alias("labels"),
        F.regexp_extract("line", r" ([^ ]+)$", 1).try_cast("double").alias("value"),
    )
    return parsed


def parse_prometheus(spark, sf):
    p = parse_lines(prometheus_lines(spark, sf)).where(F.col("name").isin("requests_total"))
    return p.select("name", F.element_at("labels", "priority").alias("priority"), F.element_at("labels", "status").alias("status"), "value")


add("parse_prometheus", parse_prometheus, "SELECT 'requests_total' AS name, o_orderpriority AS priority, o_orderstatus AS status, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2, 3")


def number_sql(n: str, scale: str) -> str:
    """The text of ``n * 10^scale`` for a positive whole number, by whole-number arithmetic alone."""
    digits, e = f"rtrim(CAST({n} AS VARCHAR), '0')", f"(length(CAST({n} AS VARCHAR)) - 1 + ({scale}))"
    return f"""CASE WHEN {e} >= length({digits}) - 1 AND {e} < 15 THEN rpad({digits}, CAST({e} + 1 AS INTEGER), '0')
 WHEN {e} < -4 OR {e} >= 6 THEN left({digits}, 1) || CASE WHEN length({digits}) > 1 THEN '.' || substr({digits}, 2) ELSE '' END || 'e' || CASE WHEN {e} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({e}) AS VARCHAR), CAST(greatest(2, length(CAST(abs({e}) AS VARCHAR))) AS INTEGER), '0')
 WHEN {e} < 0 THEN '0.' || repeat('0', CAST(-{e} - 1 AS INTEGER)) || {digits} ELSE left({digits}, CAST({e} + 1 AS INTEGER)) || '.' || substr({digits}, CAST({e} + 2 AS INTEGER)) END"""


def metric_numbers(spark, sf):
    """Numbers of all sizes in text form."""
    n, scale = F.col("o_orderkey") % 9973 + 1, F.col("o_custkey") % 29 - 9
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(n, F.lit("e"), scale).try_cast("double").alias("v"))
    return rows.select("o_orderkey", X.metric_number("v").alias("text"))


add("metric_numbers", metric_numbers, f"SELECT o_orderkey, {number_sql('n', 'scale')} AS text FROM (SELECT o_orderkey, o_orderkey % 9973 + 1 AS n, o_custkey % 29 - 9 AS scale FROM orders)")


def sample_durations(spark, sf):
    """Milliseconds of calls from their nanoseconds."""
    nanos = F.col("event_id") * 7919 + F.col("k") * 1_000_003
    return B.raw(spark, sf).select("event_id", X.duration_ms(nanos).alias("ms"))


add("sample_durations", sample_durations, sql(B.RAW, "SELECT event_id, ((event_id * 7919 + k * 1000003) // 1000) / 1000.0::DOUBLE AS ms FROM raw"))

HELP = {"request_seconds": "Time to answer.", "requests_total": "Requests by operation and code.", "shard_is_leader": "1 where this node leads.", "unused": "No series."}
_SUFFIX = "(_bucket|_sum|_count)$"


def exposition(lines, texts: dict[str, str] = HELP):
    """``line`` and its place ``(first, place)``: sorted lines, and each family's help before its first."""
    family = F.regexp_replace(F.regexp_extract("line", r"^([^{ ]+)", 1), _SUFFIX, "")
    named = lines.withColumn("family", family)
    texts = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    heads = named.groupBy("family").agg(F.min("line").alias("first")).withColumn("text", F.element_at(texts, F.col("family"))).where("text IS NOT NULL")
    heads = heads.select("first", F.lit(0).alias("place"), F.concat(F.lit("# HELP "), "family", F.lit(" "), "text").alias("line"))
    return heads.unionByName(named.select(F.col("line").alias("first"), F.lit(1).alias("place"), "line"))


def histogram_lines(cumulative, sums, name: str):
    """``_bucket``, ``_sum`` and ``_count`` lines of ``cumulative(op, le, cumulative)`` and ``sums(op, total)``."""
    le = X.label_value(F.when(F.col("le") == float("inf"), "+Inf").otherwise(X.metric_number("le")))
    op = F.concat(F.lit("op="), X.label_value("op"))
    buckets = cumulative.select(F.concat(F.lit(f"{name}_bucket{{"), op, F.lit(",le="), le, F.lit("} "), F.col("cumulative").cast("string")).alias("line"))
    counts = cumulative.where(F.col("le") == float("inf")).select(F.concat(F.lit(f"{name}_count{{"), op, F.lit("} "), F.col("cumulative").cast("string")).alias("line"))
    totals = sums.select(F.concat(F.lit(f"{name}_sum{{"), op, F.lit("} "), X.metric_number("total")).alias("line"))
    return buckets.unionByName(counts).unionByName(totals)


def metrics_exposition(spark, sf):
    """Counters, gauges and histograms of the samples as one text, help lines included."""
    counters = CATALOG["request_counters"][0](spark, sf)
    labels = F.create_map(F.lit("op"), F.col("op"), F.lit("code"), F.col("code").cast("string"))
    counters = counters.select(F.concat(X.series_key(F.lit("requests_total"), labels), F.lit(" "), F.col("n").cast("string")).alias("line"))
    shards = B.unplaced(spark, sf).select("shard").distinct()
    leads = F.create_map(F.lit("shard"), F.col("shard").cast("string"))
    gauges = shards.select(F.concat(X.series_key(F.lit("shard_is_leader"), leads), F.lit(" "), X.metric_number(X.bool_gauge(F.col("shard") % 2 == 0))).alias("line"))
    # summed in whole microseconds: the same in every order
    sums = samples(spark, sf).groupBy("op").agg((F.sum(F.floor(F.col("ms") * 1000)) / 1e6).alias("total"))
    made = counters.unionByName(gauges).unionByName(histogram_lines(histogram_cumulative(spark, sf), sums, "request_seconds"))
    return exposition(made).orderBy("first", "place")


_BOUND_TEXT = f"CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN '+Inf' WHEN le >= 1 AND le = floor(le) THEN CAST(CAST(le AS BIGINT) AS VARCHAR) ELSE CAST(le AS VARCHAR) END"
_HELP_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in HELP.items())
add("metrics_exposition", metrics_exposition, sql(_HIST + f""", bounds AS (SELECT DISTINCT op, b.le FROM placed, (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) v(b) UNION ALL SELECT CAST('Infinity' AS DOUBLE)) b),
upto AS (SELECT b.op, b.le, count(p.op) AS n FROM bounds b LEFT JOIN placed p ON p.op = b.op AND p.le <= b.le GROUP BY b.op, b.le),
totals AS (SELECT op, CAST(sum(CAST(floor(ms * 1000) AS BIGINT)) AS BIGINT) AS n FROM samples GROUP BY op),
lines AS (SELECT concat('requests_total{{code="', CASE WHEN error THEN 503 ELSE 200 END, '",op="', op, '"}} ', count(*)) AS line FROM samples GROUP BY op, error
 UNION ALL SELECT DISTINCT concat('shard_is_leader{{shard="', shard, '"}} ', 1 - shard % 2) FROM (SELECT CAST({B.fnv_sql("key")} % {B.SHARDS} AS INTEGER) AS shard FROM (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN concat('config:item:', user_id % 40) ELSE concat('task:', user_id % 13, ':status') END AS key FROM raw WHERE event_type <> 'view'))
 UNION ALL SELECT concat('request_seconds_bucket{{op="', op, '",le="', {_BOUND_TEXT}, '"}} ', n) FROM upto
 UNION ALL SELECT concat('request_seconds_count{{op="', op, '"}} ', n) FROM upto WHERE le = CAST('Infinity' AS DOUBLE)
 UNION ALL SELECT concat('request_seconds_sum{{op="', op, '"}} ', {number_sql("n", "-6")}) FROM totals),
named AS (SELECT line, regexp_replace(regexp_extract(line, '^([^{{ ]+)', 1), '(_bucket|_sum|_count)$', '') AS family FROM lines)""",
    f"SELECT line AS first, 1 AS place, line FROM lines UNION ALL SELECT min(line), 0, '# HELP ' || family || ' ' || text FROM named JOIN (VALUES {_HELP_VALUES}) h(name, text) ON name = family GROUP BY family, text"))
