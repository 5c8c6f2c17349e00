import pytest
from pyspark.sql import functions as F

from logweave.functions import scalars as X


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "task:4832:status", "schlüssel", "鍵😀"])
def test_hash(spark, text):
    assert one(spark, X.fnv1a32(F.lit(text))) == fnv(text)


def test_pinned_shard(spark):
    assert one(spark, X.shard_of(F.lit("task:4832:status"), 3)) == 1
    assert one(spark, X.shard_of(F.lit("any"), 1)) == 0 and one(spark, X.shard_of(F.lit("any"), 0)) == 0


def test_shares_are_even(spark):
    keys = spark.range(100_000).select(F.concat(F.lit("key-"), "id").alias("k"))
    n = [r["count"] for r in keys.groupBy(X.shard_of("k", 4)).count().collect()]
    assert len(n) == 4 and all(0.23 <= x / 100_000 <= 0.27 for x in n)


@pytest.mark.parametrize("n,p,want", [(100, 0.5, 51), (100, 0.99, 100), (1, 0.5, 1), (3, 0.95, 3), (4, 0.25, 2)])
def test_percentile_rank(spark, n, p, want):
    assert one(spark, X.rank_percentile(F.array(*[F.lit(float(i + 1)) for i in range(n)]), p)) == want


def test_percentile_of_nothing(spark):
    assert one(spark, X.rank_percentile(F.array().cast("array<double>"), 0.5)) == 0


@pytest.mark.parametrize("ttl,want", [(0, 30), (None, 30), (1, 1), (300, 300), (301, 300), (29, 29)])
def test_ttl(spark, ttl, want):
    assert one(spark, X.clamp_ttl(F.lit(ttl).cast("int"))) == want


@pytest.mark.parametrize("header,want", [("public, max-age=30", 30), ("no-store", 0), ("max-age=x", 0), ("max-age=5, immutable", 5), ("s-max-age=4", 0), ("", 0)])
def test_max_age(spark, header, want):
    assert one(spark, X.max_age(F.lit(header))) == want


@pytest.mark.parametrize("ms,want", [(0.0001, 0.0001), (0.00011, 0.00025), (10.0, 10.0), (10.5, float("inf")), (0.0, 0.0001)])
def test_bucket_bounds_are_inclusive(spark, ms, want):
    assert one(spark, X.histogram_bucket(F.lit(ms))) == want


def test_series_and_numbers(spark):
    labels = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, X.series_key(F.lit("m"), labels)) == 'm{a="1",b="2"}'
    assert one(spark, X.series_key(F.lit("m"), F.create_map().cast("map<string,string>"))) == "m"
    assert one(spark, X.metric_number(F.lit(3.0))) == "3" and one(spark, X.metric_number(F.lit(2.5))) == "2.5"


def test_strings(spark):
    assert one(spark, X.path_escape(F.lit("a b/c:é+"))) == "a%20b%2Fc:%C3%A9+"
    assert one(spark, X.etag(F.lit(3))) == '"v3"'
    assert one(spark, X.hex16(F.lit(255).cast("long"))) == "00000000000000ff"
    assert one(spark, X.first_non_empty(F.lit(""), F.lit(None), F.lit("x"))) == "x"
    assert [one(spark, X.backoff_ms(F.lit(a))) for a in (0, 1, 5, 9)] == [20, 40, 640, 640]
    assert one(spark, X.cache_control(F.lit(False), F.lit(3))) == "no-store"


def test_logs_compare_by_term_first(spark):
    c = lambda *v: X.up_to_date(*map(F.lit, v))
    assert one(spark, c(2, 1, 1, 9)) and not one(spark, c(1, 9, 2, 1)) and one(spark, c(1, 5, 1, 5)) and not one(spark, c(1, 4, 1, 5))


def shortest(v):
    """Digits and exponent as %g writes the shortest form."""
    import math
    from decimal import Decimal

    if math.isnan(v) or math.isinf(v):
        return "NaN" if math.isnan(v) else "+Inf" if v > 0 else "-Inf"
    if v == math.trunc(v) and abs(v) < 1e15:
        return str(int(v))
    sign, digits, exp = Decimal(repr(abs(v))).normalize().as_tuple()
    digits, exp = "".join(map(str, digits)), len(digits) + exp - 1
    if exp < -4 or exp >= 6:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    elif exp < 0:
        out = "0." + "0" * (-exp - 1) + digits
    else:
        out = digits[: exp + 1] + "." + digits[exp + 1 :]
    return "-" * (v < 0) + out


def test_metric_numbers(spark):
    import random

    from logweave.functions.scalars import metric_number

    rng = random.Random(4)
    values = [0.0, 1.0, -1.0, 1e15, 1.5e15, 1e14 + 1, 0.0001, 0.00001, 0.00012, 123456.5, 1234567.5, -0.25, 1e300, float("inf"), -float("inf"), float("nan"), 100.25]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 20) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", metric_number("v").alias("s")).collect()
    assert [r.s for r in rows] == [shortest(r.v) for r in rows]


def test_http_date_duration_gauge(spark):
    from email.utils import formatdate

    from logweave.functions.scalars import bool_gauge, duration_ms, http_date, label_value

    times = [0, 1_700_000_000_123, 951_782_400_000, 4_102_444_799_999, 1_709_164_800_000]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", http_date("t").alias("d")).collect()
    assert [r.d for r in rows] == [formatdate(r.t // 1000, usegmt=True) for r in rows]
    row = spark.createDataFrame([(1_234_567, 'a"b\\c\nd', True)], "n long, s string, f boolean").select(duration_ms("n"), label_value("s"), bool_gauge("f")).first()
    assert tuple(row) == (1.234, '"a\\"b\\\\c\\nd"', 1.0)
