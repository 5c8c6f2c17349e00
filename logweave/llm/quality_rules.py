"""Operator 9, quality rules: repetition counts, then divergence from language references.

Every document gets two histograms: its character classes and the common words of the languages.
The references are the same histograms summed over the documents of a language that pass the count
rules, equal texts once, so neither junk nor a text with very many copies bends them.  A document is
kept if the Jensen-Shannon distance of each histogram to its language's reference stays under a limit.
A histogram with too few entries is not judged, and a language with too few documents has the
reference of all languages (minimum-length guards on both sides).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Characters and common words that a histogram must hold to be judged.
GUARD_CHARS = 200
GUARD_WORDS = 60
#: Different documents that a reference must be made of.
GUARD_DOCS = 20
MAX_CHARS_DISTANCE = 0.28
MAX_WORDS_DISTANCE = 0.42

#: Frequent function words of the languages: the bins of the word histogram (the last bin: others).
COMMON = {
    "en": "the of and to a in is it that was for on with as be at by this from or are an he not have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur se ne ce il",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le",
}
WORDS = sorted({w for text in COMMON.values() for w in text.split()})
#: Character classes, by byte: each UTF-8 character counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other_ascii", "letters_beyond", "beyond")


def _class_table() -> np.ndarray:
    """Class of every byte; continuation bytes fall into an extra last class that is dropped."""
    out = np.full(256, len(CLASSES), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = CLASSES.index("letters_beyond" if b < 0xE0 else "beyond")
        elif b < 0x80:
            if c.islower():
                k = "lower"
            elif c.isupper():
                k = "upper"
            elif c.isdigit():
                k = "digit"
            elif c in "\n\r":
                k = "newline"
            elif c in " \t\x0b\x0c":
                k = "space"
            elif c in ".,;:!?":
                k = "stop"
            elif c in "'\"()-":
                k = "quote"
            elif c in SYMBOLS:
                k = "symbol"
            else:
                k = "other_ascii"
            out[b] = CLASSES.index(k)
    return out


_CLASS = _class_table()
_BYTE_WORDS = [w.encode() for w in WORDS]
_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(REPEAT_WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more, each word once, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = sum(h[i : i + n] * _POWERS[i] for i in range(window))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    # equal hashes only point at windows: the words themselves decide
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms."""
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    classes = np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)].tolist()
    seen = Counter(words)
    common = [seen.get(w, 0) for w in _BYTE_WORDS]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in WHITE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        classes,
        [*common, len(words) - sum(common)],
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t or "") for t in batch.column(2).to_pylist()]
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(3),
                *[pa.array(c, pa.int64()) for c in cols[:5]],
                pa.array(map(sum, cols[5]), pa.int64()),
                *[pa.array(c, pa.list_(pa.int64())) for c in cols[5:]],
            ],
            ["doc_id", "lang", "mark", *_COUNTS, "n_chars", "classes", "common"],
        )


def js_distance(p: Column, total: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of counts, with their total, and shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda n, b: (part(n / total, (n / total + b) / 2) + part(b, (n / total + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda x, y: x + y), F.lit(0.0)))


def rules(
    docs: DataFrame,
    max_chars_distance: float = MAX_CHARS_DISTANCE,
    max_words_distance: float = MAX_WORDS_DISTANCE,
    guard_chars: int = GUARD_CHARS,
    guard_words: int = GUARD_WORDS,
    guard_docs: int = GUARD_DOCS,
) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs(doc_id, text, lang, ...)``.

    Null and empty texts have no words and fail the base rules; very long texts are measured whole; a
    null language, and one with fewer than ``guard_docs`` documents, is compared with the reference of
    all documents; without so many documents at all the count rules alone decide; null and repeated
    doc_ids are judged row by row; an empty table gives no rows; other columns are not read, so their
    names can't clash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in _COUNTS)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("mark"))
    measured = settle(
        rows.mapInArrow(_measure, f"doc_id {kind}, lang string, mark long, {columns}, n_chars long, classes array<long>, common array<long>"),
        "measured",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    bins = (("classes", "n_chars", len(CLASSES)), ("common", "n_words", len(WORDS) + 1))
    # equal texts have equal histograms and count once; copies are combined before they move
    once = measured.where(~failed).groupBy("lang", "mark").agg(*[F.first(c).alias(c) for b in bins for c in b[:2]])
    sums = lambda: [x for c, t, n in bins for x in (F.sum(t).alias(t), F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c))]
    # one row a language, and one (language null) for all
    by_lang = settle(once.groupBy("lang").agg(F.count("*").alias("docs"), *sums()), "references")
    pooled = by_lang.withColumn("lang", F.lit(None).cast("string")).groupBy("lang").agg(F.sum("docs").alias("docs"), *sums())
    known = by_lang.where(F.col("lang").isNotNull()).unionByName(pooled).where(F.col("docs") >= guard_docs)
    share = lambda c, t: F.transform(c, lambda x: x / F.greatest(F.col(t), F.lit(1))).alias(f"ref_{c}")
    references = settle(known.select(F.col("lang").alias("ref"), *[share(c, t) for c, t, _ in bins]), "shares")
    # a handful of rows: languages without a reference of their own look at that of all
    own = measured.select("lang").distinct().join(references.select(F.col("ref").alias("lang"), F.col("ref").alias("own")), "lang", "left")
    assigned = own.join(references, own.own.eqNullSafe(references.ref), "left").drop("own", "ref").withColumnRenamed("lang", "ref")
    distance = lambda c, t, least, name: F.when((F.col(t) >= least) & F.col(f"ref_{c}").isNotNull(), js_distance(F.col(c), F.col(t), F.col(f"ref_{c}"))).alias(name)
    judged = measured.join(assigned, measured.lang.eqNullSafe(assigned.ref), "left").select(
        "doc_id",
        *_COUNTS,
        distance("classes", "n_chars", guard_chars, "chars_distance"),
        distance("common", "n_words", guard_words, "words_distance"),
    )
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= max_chars_distance) & (F.coalesce("words_distance", F.lit(0.0)) <= max_words_distance)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept")


_PATTERNS = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": "[ \\t\\x0B\\x0C]", "newline": "[\\n\\r]", "stop": "[.,;:!?]", "quote": "[\x27\"()-]", "symbol": "[#*$%&|<>]",
    "other_ascii": "[\\x00-\\x08\\x0E-\\x1F\\x7F/+=@\\[\\]\\\\^_`{}~]", "letters_beyond": "[\\x{80}-\\x{7FF}]", "beyond": "[\\x{800}-\\x{10FFFF}]",
}
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
SQL = f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS id FROM documents),
windows AS (SELECT id, i, array_to_string(words[i : i + {REPEAT_WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) u(i)),
again AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, win) AS n FROM windows) WHERE n > 1),
inside AS (SELECT id, count(DISTINCT i + k) AS n FROM again, range({REPEAT_WINDOW}) r(k) GROUP BY id),
counted AS (SELECT w.*, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w LEFT JOIN inside ON inside.id = w.id),
judged AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
bins AS (SELECT id, lang, t, base_failed, 'classes' AS kind, i, length(t) - length(regexp_replace(t, p, '', 'g')) AS n FROM judged, (SELECT unnest([{_quoted(_PATTERNS.values())}]) AS p, unnest(range({len(CLASSES)})) AS i)
 UNION ALL SELECT id, lang, t, base_failed, 'common', i, CASE WHEN i < {len(WORDS)} THEN len(list_filter(words, lambda x: x = c)) ELSE n_words - len(list_filter(words, lambda x: list_contains([{_quoted(WORDS)}], x))) END
  FROM judged, (SELECT unnest([{_quoted(WORDS)}, '']) AS c, unnest(range({len(WORDS) + 1})) AS i)),
once AS (SELECT lang, kind, i, n, t FROM bins WHERE NOT base_failed GROUP BY ALL),
refs AS (SELECT lang, kind, i, sum(n) AS n, count(*) AS docs FROM once WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, kind, i, sum(n), count(*) FROM once GROUP BY kind, i),
shares AS (SELECT lang, kind, i, n / greatest(sum(n) OVER (PARTITION BY lang, kind), 1) AS q FROM refs WHERE docs >= {GUARD_DOCS}),
totals AS (SELECT *, sum(n) OVER (PARTITION BY id, kind) AS total FROM bins),
parts AS (SELECT b.id, b.kind, b.n / b.total AS p, s.q FROM totals b JOIN shares s ON s.kind = b.kind AND s.i = b.i AND s.lang IS NOT DISTINCT FROM CASE WHEN b.lang IN (SELECT lang FROM shares WHERE lang IS NOT NULL) THEN b.lang END
  WHERE b.total >= CASE b.kind WHEN 'classes' THEN {GUARD_CHARS} ELSE {GUARD_WORDS} END),
distances AS (SELECT id, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS d FROM parts GROUP BY id, kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT EXISTS (SELECT 1 FROM distances d WHERE d.id = judged.id AND d.d > CASE d.kind WHEN 'classes' THEN {MAX_CHARS_DISTANCE} ELSE {MAX_WORDS_DISTANCE} END) AS kept FROM judged"""
