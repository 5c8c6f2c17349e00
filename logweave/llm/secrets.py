"""Operator 8, secret scans: patterns find candidates, corpus-wide ownership tells what they are.

Candidates are the base patterns (which stay, whatever follows) and wider ones: signed tokens, private
keys, prefixed service tokens and opaque mixed-case strings.  Every candidate's value is hashed; over
the whole corpus the distinct owners and the distinct repositories of each hash are counted, each from
pairs of its own that are made distinct first, so a value that fills a third of the corpus is counted
in parts.  A repository is not nested in an owner: mirrors of a file are one repository, whoever has
them, and one owner's files are many.

A value that several owners have in several repositories is an ``example`` (documentation, a
tutorial, a copied file), and so is one that two owners have in many.  One that stays with its owner
and looks live (long, varied, no placeholder word) is ``live``, in however many files and mirrors;
the rest is ``weak``.  Wider candidates become spans only where they are live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carries, settle, slices, table, texts_of

#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "service", "opaque")
BASE = 3
#: A value with this many owners, in this many repositories, is an example; and one of two owners in many.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 3
WIDE_REPOSITORIES = 10
#: Hashes of examples that are broadcast (8 bytes each), at most; more are joined in salted parts.
BROADCAST_HASHES = 200_000
SALTS = 16
MIN_ENTROPY = 2.5
MIN_DISTINCT = 6
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "redacted")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
#: A private key whole: its header, header lines, lines of its body (ends of lines may be escaped) and footer.
_PEM = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?>\r?\n[A-Za-z]{1,20}(?:-[A-Za-z]{1,20}){1,3}:[^\n]{0,200})*"
    r"(?>(?:\s|\\[nr]){0,8}[A-Za-z0-9+/=]{16,})*(?>(?:\s|\\[nr]){0,8}[A-Za-z0-9+/=]{0,80}(?:\s|\\[nr]){0,8}-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
    re.A,
)
_BETWEEN = re.compile(r"\s|\\[nr]", re.A)
_SERVICE = re.compile(r"\b(?:gh[opusr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", re.A)
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")

_AS_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_AS_OPAQUE = bytes(0x78 if re.match(rb"[A-Za-z0-9+/_-]", bytes([b])) else 0x20 for b in range(256))
_HINTS = ("password", "passwd", "secret", "token", "api")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= MIN_DISTINCT and entropy(value) >= MIN_ENTROPY and not any(p in low for p in PLACEHOLDERS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind."""
    found = []
    low, body = text.lower(), text.encode("utf-8", "surrogatepass")
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in body.translate(_AS_HEX):
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Matches of the other kinds, which may overlap."""
    found = []
    if "eyJ" in text:
        found += [(m.start(), 3, m.end(), m[0]) for m in _JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        # the same key however its lines are broken
        found += [(m.start(), 4, m.end(), _BETWEEN.sub("", m[0])) for m in _PEM.finditer(text)]
    if any(h in text for h in ("gh", "xox", "sk_live_")):
        found += [(m.start(), 5, m.end(), m[0]) for m in _SERVICE.finditer(text)]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_AS_OPAQUE):
        for m in _OPAQUE.finditer(text):
            v = m[0]
            if v.lower() != v and v.upper() != v and any(c.isdigit() for c in v) and entropy(v) >= 3.5:
                found.append((m.start(), 6, m.end(), v))
    return found


def wider_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates that overlap no span of ``base`` (by start) and no earlier one, by kind and start."""
    # disjoint stretches that are taken, as their starts and ends
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end, _ in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = []
    for span in sorted(candidates(text), key=lambda x: (x[1], x[0])):
        i = bisect_right(starts, span[0])
        if (not i or ends[i - 1] <= span[0]) and (i == len(starts) or span[2] <= starts[i]):
            starts.insert(i, span[0])
            ends.insert(i, span[2])
            out.append(span)
    return sorted(out)


def listed(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64()), ("live", pa.bool_())])
_SPANS_SQL = "array<struct<start:bigint,kind:int,end:bigint,hash:bigint,live:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch], carried: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found, base = [], []
        for text in texts_of(batch, carried):
            text = text or ""
            spans = base_spans(text)
            base.append(listed(spans))
            spans = sorted(spans + wider_spans(text, spans))
            found.append([{"start": s, "kind": k, "end": e, "hash": _hash(v), "live": looks_live(v)} for s, k, e, v in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.string()), pa.array(found, pa.list_(_SPAN)), batch.column(2), batch.column(3)],
            ["row", "base", "found", "owner", "repository"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories`` over the candidates of ``found(found, owner, repository)``.

    Owners and repositories are counted apart; rows of a pair are combined before they move, and the
    pairs of one hash are dealt by pair, so no task gets all rows of a hash.
    """
    pairs = found.select(F.explode("found.hash").alias("hash"), "owner", "repository")
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = pairs.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def is_example(owners: int = EXAMPLE_OWNERS, repositories: int = EXAMPLE_REPOSITORIES, wide: int = WIDE_REPOSITORIES) -> Column:
    """The rule over ``ownership``'s counts."""
    o, r = F.col("owners"), F.col("repositories")
    return ((o >= owners) & (r >= repositories)) | ((o >= 2) & (r >= wide))


def find_secrets(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
    wide_repositories: int = WIDE_REPOSITORIES,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """All candidates of every row of ``docs(text, ...)`` with their verdicts.

    Returns ``row`` (a struct of the kept columns), ``base`` (the base spans as text) and ``spans``,
    an array of ``(start, kind, end, verdict)`` by start and kind.  The owner is the ``source`` where
    there is such a column (else all rows have one owner), the repository the text itself, so mirrors
    of a document are one.  Null and empty texts have no spans; very long texts are scanned whole, in
    time that grows in proportion; a null owner is one owner of its own; repeated rows are each
    scanned; an empty table gives no rows; kept columns sit in the struct, so no name can clash.
    """
    if owner is None:
        owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    repository = F.hex(F.xxhash64(F.col("text").cast("string"))) if repository is None else F.coalesce(repository.cast("string"), F.lit(""))
    carried = carries(docs, keep)
    text = F.lit(None).cast("string") if carried else F.col("text").cast("string")
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"), owner.alias("owner"), repository.alias("repository"))
    made = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("base", T.StringType()),
            T.StructField("found", T._parse_datatype_string(_SPANS_SQL)),
            T.StructField("owner", T.StringType()),
            T.StructField("repository", T.StringType()),
        ]
    )
    # the ids are written with the rows, so they stay the same for every later reader
    scanned = settle(rows.mapInArrow(lambda it: _scan(it, carried), made).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    some = F.size("found") > 0
    shared = settle(ownership(scanned.where(some)).where(is_example(example_owners, example_repositories, wide_repositories)).select("hash"), "shared-values").withColumn("shared", F.lit(True))
    each = scanned.where(some).select("uid", F.explode("found").alias("s")).select("uid", "s", F.col("s.hash").alias("hash"))
    if shared.count() <= broadcast_hashes:
        marked = each.join(F.broadcast(shared), "hash", "left")
    else:
        salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = each.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "_salt"], "left")
    verdict = F.when(F.col("shared"), "example").when(F.col("s.live"), "live").otherwise("weak")
    judged = (
        marked.select("uid", F.struct("s.start", "s.kind", "s.end", verdict.alias("verdict")).alias("span"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list("span")).alias("spans"))
    )
    none = T._parse_datatype_string("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")
    # rows without candidates, most of them, move nowhere
    quiet = scanned.where(~some).select("row", "base", F.array().cast(none).alias("spans"))
    return quiet.unionByName(scanned.where(some).join(judged, "uid").select("row", "base", "spans"))


def spans_text(spans: Column) -> Column:
    """Base spans and live wider ones as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    stay = F.filter(spans, lambda s: (s["kind"] < BASE) | (s["verdict"] == "live"))
    return F.array_join(
        F.transform(stay, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


MASK = "[SECRET]"


def _redact(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], mask]
                at = max(at, s["end"])
            texts.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows and columns of ``docs`` with every secret that is no widely copied example masked.

    ``n_chars``, where there is such a column, follows the new text; rows without such secrets stay
    as they are.  Null and empty texts have none; very long texts are read and masked whole; repeated
    rows and null ids are masked row by row; an empty table gives no rows; columns of any names stay.
    """
    found = find_secrets(docs, tuple(docs.columns))
    bad = F.filter("spans", lambda s: ((s["kind"] < BASE) & (s["verdict"] != "example")) | (s["verdict"] == "live"))
    marked = found.select("row", bad.alias("bad"))
    clean = marked.where(F.size("bad") == 0).select("row.*")
    hit = marked.where(F.size("bad") > 0).select("row", F.col("row.text").alias("text"), "bad")
    out = T.StructType([T.StructField("row", hit.schema["row"].dataType), T.StructField("text", T.StringType())])
    masked = hit.mapInArrow(lambda it: _redact(it, mask), out)
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.unionByName(masked.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns]))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        *[_count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


def _located(kind: int, pattern: str, group: int = 0) -> str:
    """SQL of the non-overlapping matches of a pattern: place, end, value.  ``group`` 1 is what stands before."""
    lead = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""SELECT id, {kind} AS kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, substr(t, CAST(s AS INTEGER) + 1, CAST(e - s AS INTEGER)) AS m FROM (SELECT id, t,
 coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + {"length(leads[i])" if group else "0"} AS s,
 coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS e
 FROM (SELECT id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps, {lead} AS leads FROM d), unnest(range(1, len(ms) + 1)) u(i))"""


_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_WORDS_SQL = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN_SQL = f"""({_WORDS_SQL})["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""
_PEM_SQL = _PEM.pattern.replace("(?>", "(?:").replace("\\\\", "\\\\")
_NO_OVERLAP = "NOT EXISTS (SELECT 1 FROM {taken} x WHERE x.id = c.id AND x.s < c.e AND c.s < x.e)"


def _oracle() -> str:
    kinds = {3: ("(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 1), 4: (_PEM_SQL, 0), 5: (_SERVICE.pattern, 0), 6: (_OPAQUE.pattern, 0)}
    parts = [
        "d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS owner, text AS repository, coalesce(text, '') AS t FROM documents)",
        f"assign AS (SELECT id, kind, s, e, regexp_extract(m, '{_ASSIGN_SQL}', 2) AS v FROM ({_located(0, _ASSIGN_SQL)}) WHERE length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6)",
        f"""base AS MATERIALIZED (SELECT * FROM assign UNION ALL SELECT id, kind, s, e, m FROM ({_located(1, _ACCESS.pattern)}) WHERE length(m) >= 20
 UNION ALL SELECT id, kind, s, e, m FROM ({_located(2, _HEX.pattern)}) WHERE length(m) >= 24)""",
    ]
    taken = "base"
    for kind, (pattern, group) in kinds.items():
        value = "regexp_replace(m, '\\s|\\\\[nr]', '', 'g')" if kind == 4 else "m"
        mixed = "WHERE lower(m) <> m AND upper(m) <> m AND regexp_matches(m, '[0-9]') AND list_aggregate(string_split(m, ''), 'entropy') >= 3.5" if kind == 6 else ""
        parts.append(f"k{kind} AS (SELECT id, kind, s, e, {value} AS v FROM ({_located(kind, pattern, group)}) {mixed})")
        parts.append(f"t{kind} AS MATERIALIZED (SELECT * FROM {taken} UNION ALL SELECT * FROM k{kind} c WHERE {_NO_OVERLAP.format(taken=taken)})")
        taken = f"t{kind}"
    words = " AND ".join(f"NOT contains(lower(v), '{p}')" for p in PLACEHOLDERS)
    names = ", ".join(f"'{k}'" for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{KINDS[k]}" for k in range(BASE))
    place = f"[{names}][kind + 1] || ':' || s || ':' || e"
    return f"""WITH {", ".join(parts)},
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM {taken} JOIN d USING (id) GROUP BY v),
judged AS (SELECT c.*, CASE WHEN (owners >= {EXAMPLE_OWNERS} AND repositories >= {EXAMPLE_REPOSITORIES}) OR (owners >= 2 AND repositories >= {WIDE_REPOSITORIES}) THEN 'example'
 WHEN len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT} AND list_aggregate(string_split(v, ''), 'entropy') >= {MIN_ENTROPY} AND {words} THEN 'live' ELSE 'weak' END AS verdict FROM {taken} c JOIN owned USING (v)),
said AS (SELECT id, {counts}, string_agg({place}, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE}) AS base, string_agg({place}, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE} OR verdict = 'live') AS spans,
 count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM judged GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k]}, 0) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN said USING (id)"""


SQL = _oracle()
