"""Scalar functions as column builders: everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a parameters.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
# Bounds of the latency histogram, in seconds; the last bucket is +Inf.
HISTOGRAM_BOUNDS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# Time to live of cached entries, in seconds.
TTL_DEFAULT, TTL_MIN, TTL_MAX = 30, 1, 300
IMMUTABLE_SECONDS = 31_536_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a over the UTF-8 bytes, as a non-negative long."""
    # pairs of hex digits, made once; a lambda over positions would encode the text for every byte
    pairs = F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-8")), F.lit("(..)"), 1)
    step = lambda h, pair: (h.bitwiseXOR(F.conv(pair, 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK))
    return F.aggregate(pairs, F.lit(FNV_OFFSET).cast("long"), step)


def shard_of(key: Column | str, shards: int) -> Column:
    """The shard of a key; all keys are in shard 0 if there is one shard or none, and null keys.

    Never null, so that joins on it need no filter that hashes every key once more.
    """
    return F.lit(0) if shards <= 1 else F.coalesce((fnv1a32(key) % shards).cast("int"), F.lit(0))


def etag(version: Column | str) -> Column:
    return F.concat(F.lit('"v'), col(version).cast("string"), F.lit('"'))


def clamp_ttl(ttl: Column | str) -> Column:
    """0 (or none) means the default; other values are kept within bounds."""
    t = col(ttl)
    return F.when(F.coalesce(t, F.lit(0)) == 0, TTL_DEFAULT).otherwise(F.least(F.greatest(t, F.lit(TTL_MIN)), F.lit(TTL_MAX))).cast("int")


def cache_control(cacheable: Column | str, ttl: Column | str, versioned: Column | bool = False) -> Column:
    versioned = F.lit(versioned) if isinstance(versioned, bool) else versioned
    return (
        F.when(~col(cacheable), "no-store")
        .when(versioned, f"public, max-age={IMMUTABLE_SECONDS}, immutable")
        .otherwise(F.concat(F.lit("public, max-age="), col(ttl).cast("string")))
    )


def max_age(header: Column | str) -> Column:
    """Seconds of a Cache-Control header; 0 where there is no number."""
    found = F.regexp_extract(col(header), r"(?:^|,)\s*max-age=(-?[0-9]+)\s*(?:,|$)", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def first_non_empty(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def path_escape(text: Column | str) -> Column:
    """Percent-encoding for one path segment; a space is %20."""
    out = F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))
    for code, char in (("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def hex16(number: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(col(number)), 16, "0"))


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp, zone-less ones read as UTC."""
    return F.unix_millis(col(ts).cast("timestamp"))


def backoff_ms(attempt: Column | str, base: int = 20, most: int = 5) -> Column:
    """Doubling from ``base``, with at most ``most`` doublings."""
    return F.lit(base).cast("long") * F.pow(F.lit(2.0), F.least(col(attempt), F.lit(most))).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    """Significant digits and the exponent of the first one, of a positive number's text."""
    whole = F.split_part(text, F.lit("."), F.lit(1))
    rest = F.split_part(text, F.lit("."), F.lit(2))
    raw = F.concat(whole, F.split_part(rest, F.lit("E"), F.lit(1)))
    power = F.coalesce(F.split_part(rest, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
    return F.struct(F.trim(raw, F.lit("0")).alias("d"), (F.length(whole) + power - lead - 1).alias("e"))


def _short(x: Column) -> Column:
    """The text of digits and exponent: an exponent is written below -4 and above 5."""
    digits, exponent = x["d"], x["e"]
    size = F.abs(exponent).cast("string")
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    scientific = F.concat(F.left(digits, F.lit(1)), fraction, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    below_one = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits)
    plain = F.concat(F.left(digits, exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    return F.when((exponent < -4) | (exponent >= 6), scientific).when(exponent < 0, below_one).otherwise(plain)


def _named(v: Column) -> Column:
    # before version 19 Java writes a digit too many for some numbers; fewer digits serve if they name the same number
    rounded = [F.format_string(f"%.{n}E", F.abs(v)) for n in (14, 15, 16)]
    text = F.coalesce(*[F.when(t.try_cast("double") == F.abs(v), t) for t in rounded], F.abs(v).cast("string"))
    return F.concat(F.when(v < 0, "-").otherwise(""), bind(bind(text, _digits), _short))


def metric_number(value: Column | str) -> Column:
    """Whole numbers below 1e15 without a fraction; others by their shortest digits, with an exponent
    of two digits or more where it is below -4 or above 5; ``+Inf``, ``-Inf`` and ``NaN``."""
    v = col(value).cast("double")
    return (
        F.when(F.isnan(v), "NaN")
        .when(F.abs(v) == float("inf"), F.when(v > 0, "+Inf").otherwise("-Inf"))
        .when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string"))
        .when(v.isNotNull(), bind(v, _named))
    )


def bool_gauge(flag: Column | str) -> Column:
    """A gauge of a condition: 1 or 0."""
    return F.when(col(flag), F.lit(1.0)).otherwise(F.lit(0.0))


def duration_ms(nanoseconds: Column | str) -> Column:
    """Milliseconds of a duration as samples give them: whole microseconds, divided by 1000."""
    return F.floor(col(nanoseconds) / 1000).cast("double") / 1000


def http_date(ms: Column | str) -> Column:
    """``Mon, 02 Jan 2006 15:04:05 GMT`` of milliseconds since 1970, in UTC whatever the session's zone."""
    seconds = F.floor(col(ms) / 1000).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    names = lambda text, i: F.element_at(F.array(*map(F.lit, text.split())), i)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    date = F.concat_ws(" ", two(F.dayofmonth(day)), names("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec", F.month(day)), F.lpad(F.year(day).cast("string"), 4, "0"))
    return F.concat(names("Sun Mon Tue Wed Thu Fri Sat", F.dayofweek(day)), F.lit(", "), date, F.lit(" "), clock, F.lit(" GMT"))


def label_value(text: Column | str) -> Column:
    """A label's value in quotes, with backslashes, quotes and line ends escaped."""
    out = col(text)
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def series_key(name: Column | str, labels: Column | str) -> Column:
    """``name{a="1",b="2"}`` with label names in order; the name alone without labels."""
    parts = F.transform(F.array_sort(F.map_keys(col(labels))), lambda k: F.concat(k, F.lit("="), label_value(F.element_at(col(labels), k))))
    return F.when(F.size(F.map_keys(col(labels))) > 0, F.concat(col(name), F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(col(name))


def in_namespaces(key: Column | str, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col(key), F.lit(p))
    return out


def bench_key(i: Column | str, cacheable: float) -> Column:
    """Generated keys: a share of ``cacheable`` falls into the cacheable namespace."""
    n = col(i)
    return F.when((n % 1000) / 1000 < cacheable, F.concat(F.lit("config:item:"), n.cast("string"))).otherwise(
        F.concat(F.lit("task:"), n.cast("string"), F.lit(":status"))
    )


def histogram_bucket(seconds: Column | str, bounds: tuple[float, ...] = HISTOGRAM_BOUNDS) -> Column:
    """The first bound that is not below the value; infinity beyond the last."""
    out = F.lit(float("inf"))
    for b in reversed(bounds):
        out = F.when(col(seconds) <= b, F.lit(b)).otherwise(out)
    return out


def rank_percentile(values: Column | str, p: float) -> Column:
    """``sorted[min(n - 1, floor(n * p))]`` of an array; 0 for an empty one."""
    xs = F.array_sort(col(values))
    n = F.size(col(values))
    at = F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1
    return F.when(n > 0, F.element_at(xs, at)).otherwise(F.lit(0.0))


def up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's log is at least as new: the later term, then the longer log."""
    return F.struct(term.cast("long").alias("t"), index.cast("long").alias("i")) >= F.struct(own_term.cast("long").alias("t"), own_index.cast("long").alias("i"))
