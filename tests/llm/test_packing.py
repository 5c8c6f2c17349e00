import zlib
from array import array
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm.common import table
from logweave.llm.encoding import WORD_BPE, library_encoder, tokenizer_path
from logweave.llm.packing import Packer, op4_packing, pack

PATH = tokenizer_path(WORD_BPE)
SCHEMA = "doc_id long, text string, ids string, start string"


@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 5))
def test_packer_places_every_id_once(totals, windows):
    packer, pieces, full = Packer(20, windows), defaultdict(list), 0
    for tag, total in enumerate(totals):
        for _, content in packer.add(tag, total):
            assert sum(n for *_, n in content) == 20
            full += 1
            for t, s, n in content:
                pieces[t] += range(s, s + n)
        assert len(packer.open) <= windows
        assert {k: sum(n for *_, n in v) for k, v in packer.held.items()} == {n: f for f, n in packer.open}
    for _, content in packer.rest():
        for t, s, n in content:
            pieces[t] += range(s, s + n)
    assert all(sorted(pieces[t]) == list(range(n)) for t, n in enumerate(totals))


def test_best_fit_before_a_cut():
    packer = Packer(10, 2)
    assert not [*packer.add("a", 6), *packer.add("b", 7)]
    assert not [*packer.add("c", 2)]
    assert sorted(packer.held.values()) == [[("a", 0, 6)], [("b", 0, 7), ("c", 0, 2)]]
    first, second = [content for _, content in packer.add("d", 5)]
    assert first == [("b", 0, 7), ("c", 0, 2), ("d", 0, 1)] and second == [("a", 0, 6), ("d", 1, 4)]


@pytest.mark.parametrize("text", ["", " ", "A\n\nB", "don't 'S 12", "É é ÀB", "<|endoftext|>x<|startoftext|>", "İ ΑΣ ß", "a\x1cb \x1f c", "日本 語😀", " ́x", "x" * 900])
def test_pieces_like_the_library(text):
    library = Tokenizer.from_file(PATH)
    (body,) = library_encoder(PATH, False).texts([text])
    assert array("I", body).tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, want, window=2048):
    """want: per document, its ids with the end id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def test_whole_table(spark):
    library = Tokenizer.from_file(PATH)
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs}
    n = check(op4_packing(spark, "/root/testdata/sf0.01").collect(), want)
    assert n * 2048 < 1.01 * sum(map(len, want.values())) + 2048


def test_nulls_repeats_empty(spark):
    docs = [(1, None, "", ""), (None, "a b", "", ""), (2, "", "", ""), (2, "", "", ""), (3, "word " * 9000, "", "")]
    rows = pack(spark.createDataFrame(docs, SCHEMA), PATH).collect()
    assert sum(r.length for r in rows) == 1 + 3 + 1 + 1 + 9001
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows if r.doc_id != 3) == [(0, 0, 3), (1, 0, 1), (2, 0, 1), (2, 0, 1)]
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_equal_lengths_and_memory_bound(spark):
    """Ties of equal fills, and workers that remember next to nothing."""
    library = Tokenizer.from_file(PATH)
    docs = [(i, f"one two three four five six seven {chr(97 + i % 26)}", "", "") for i in range(500)]
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t, *_ in docs}
    for window, kept in ((16, 1 << 20), (17, 1 << 20), (64, 2000)):
        rows = pack(spark.createDataFrame(docs, SCHEMA).withColumn("n", F.lit(0)), PATH, window=window, open_windows=4, kept_bytes=kept)
        n = check(rows.withColumn("ids_crc32", F.crc32("ids")).collect(), want, window)
        assert n * window < 1.1 * sum(map(len, want.values())) + 4 * window


def test_very_long_text_without_spaces(spark):
    library = Tokenizer.from_file(PATH)
    docs = [(1, "ab" * 300_000, "", ""), (2, "x", "", "")]
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t, *_ in docs}
    check(pack(spark.createDataFrame(docs, SCHEMA), PATH).withColumn("ids_crc32", F.crc32("ids")).collect(), want)
