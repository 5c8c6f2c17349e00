import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm.common import table
from logweave.llm.quality_rules import CLASSES, MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE, SQL, WORDS, measure, op9_quality_rules, repeated_words, rules

SCHEMA = "doc_id long, text string, lang string, kept string, n_words int"


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b#é\x85\xa0", max_size=150))
def test_counts(text):
    assert measure(text)[:5] == slow(text)


def test_repeats():
    words = [f"w{i}".encode() for i in range(10)]
    assert repeated_words(words) == 0 and repeated_words(words + words) == 20
    assert repeated_words([b"a"] * 9) == 9 and repeated_words([b"a"] * 8) == 0


def test_histograms():
    *_, classes, common = measure("The dog ist the né 😀\n#1")
    got = dict(zip(CLASSES, classes))
    assert got["lower"] == 12 and got["upper"] == 1 and got["letters_beyond"] == 1 and got["beyond"] == 1 and got["newline"] == 1 and got["symbol"] == 1
    assert sum(common) == 7 and common[WORDS.index("the")] == 1 and common[WORDS.index("ist")] == 1


def distance(p, q):
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum()
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in rules(table(spark, sf, "documents")).collect()}
    assert len(got) == len(docs)
    assert {r.doc_id: (r.base_failed, r.kept) for r in op9_quality_rules(spark, sf).collect()} == {d: (r.base_failed, r.kept) for d, r in got.items()}
    clean = {(d.lang, d.text) for d in docs if not got[d.doc_id].base_failed}
    rows = {d.doc_id: measure(d.text) for d in docs}
    share = lambda x: np.array(x) / max(1, sum(x))
    for k, name, least in ((5, "chars_distance", 200), (6, "words_distance", 60)):
        refs = {lang: share(np.sum([measure(t)[k] for l, t in clean if l == lang], axis=0)) for lang in {d.lang for d in docs}}
        for d in docs:
            own = rows[d.doc_id][k]
            if sum(own) < least:
                assert got[d.doc_id][name] is None
            else:
                assert got[d.doc_id][name] == pytest.approx(distance(share(own), refs[d.lang]), abs=1e-9)
    for d in docs:
        r, want = got[d.doc_id], slow(d.text)
        assert (r.n_words, rows[d.doc_id][1], r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        near = (r.chars_distance or 0) <= MAX_CHARS_DISTANCE and (r.words_distance or 0) <= MAX_WORDS_DISTANCE
        assert r.kept == (not r.base_failed and near)


def test_nulls_repeats_empty(spark):
    rows = [(None, None, None, "", 1), (1, "word " * 7 + "other thing of the kind " * 4, None, "", 1), (2, "", "xx", "", 1), (2, "", "xx", "", 1)]
    got = rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (1, 27, False), (2, 0, False), (2, 0, False)]
    assert rules(spark.createDataFrame([], SCHEMA)).collect() == []


def english(i):
    return " ".join(f"the dog of {chr(97 + i % 26)}w{chr(97 + i // 26)} and a cat in the house is on it" for _ in range(1)) + f" {'x' * (i % 7)} with {'y' * (i % 5 + 1)} words at the end of line by them as be or not"


def test_references_without_junk_copies_and_small_languages(spark):
    good = [(i, english(i), "en", "", 0) for i in range(60)]
    junk = [(100 + i, "#### $$$$ |||| %%%% " * 20 + f"q{i}", "en", "", 0) for i in range(60)]
    copies = [(300 + i, "zz yy xx " + " ".join(f"k{j}" for j in range(80)), "en", "", 0) for i in range(500)]
    lone = [(900, "#" * 300 + " " + " ".join(f"| {j} %" for j in range(60)), "xx", "", 0)]  # a language of its own is no excuse
    got = {r.doc_id: r for r in rules(spark.createDataFrame([*good, *junk, *copies, *lone], SCHEMA), guard_chars=100, guard_words=20).collect()}
    assert all(got[d[0]].kept for d in good)
    assert all(got[d[0]].base_failed for d in junk) and not got[900].kept and not got[300].kept
    few = {r.doc_id: r for r in rules(spark.createDataFrame(good[:5] + lone, SCHEMA), guard_chars=100, guard_words=20).collect()}
    assert all(r.chars_distance is None and r.kept != r.base_failed for r in few.values())


def test_against_sql(spark):
    from tests.oracle import compare

    assert compare(spark, op9_quality_rules, SQL, "/root/testdata/sf0.001") is None


def test_very_long_texts():
    for text in ("word the\n" * 40_000, "x" * 500_000, "a b c d e f g h i " * 20_000):
        assert measure(text)[0] == len(text.split())
    assert measure("word the\n" * 3000)[:5] == (6000, 21000, 0, 2999, 6000)
