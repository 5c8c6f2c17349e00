import hashlib
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logweave.llm.bpe import Codec, Decoder, Encoder, MergeList, Transducer, decode, digests, encode, op1_bpe
from logweave.llm.common import table
from logweave.llm.encoding import BYTE_BPE, PieceEncoder, tokenizer_path

PATH = tokenizer_path(BYTE_BPE)
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def merges():
    return MergeList(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def pieces(merges):
    return PieceEncoder(Encoder(merges).many, True, merges.special)


def check(text, merges, library):
    ids = library.encode(text, add_special_tokens=False).ids
    (body,) = pieces(merges).texts([text])
    assert np.frombuffer(body, "<u4").tolist() == ids
    assert Decoder(merges).text(np.array(ids), step=3) == library.decode(ids, skip_special_tokens=False) == text


ODD = ["", " ", "  ", "a  b", "a   b", " \n a", "x \n", "x\n ", "\n \n", "a   b", "it's we'll 'tis", "don't' s", "<|endoftext|>", "a\n <|endoftext|> b", " <|endoftext|>",
       "<|endof", "a\x1c b", "12345 678 ½²", "日本語 テキスト", "é é", "  x", "tab\t tab", "😀😀 👩‍👩‍👧", "a" * 3000, "ab" * 2000 + " c", "=" * 999, " " * 500 + "x", "\r\n\r\n", "'s", " 's"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, merges, library):
    check(text, merges, library)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tabeht's1é \x1c。<|endoftext|>", max_size=60))
def test_like_the_library(text):
    check(text, MERGES, LIBRARY)


MERGES, LIBRARY = MergeList(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 3))
def test_transducer_emits_what_the_whole_gives(seed, letters):
    rng = random.Random(seed)
    alphabet = rng.sample("theinaros er", 1 + letters)
    body = "".join(rng.choice(alphabet) for _ in range(3 * MERGES.window)).encode()
    run, got = Transducer(MERGES), []
    for at in range(0, len(body), 97):
        got += run.feed(body[at : at + 97])
    assert got, "tokens come out before the end"
    assert got + run.close() == MERGES.merge(body)
    assert run.most <= MERGES.window


def test_lookahead_of_small_lists():
    class Small(MergeList):
        def __init__(self, parts):
            ids = {c: i for i, c in enumerate("abcdef")}
            self.bytes = [c.encode() for c in ids]
            self.parts, self.made = [], []
            for a, b in parts:
                ids[a + b] = len(ids)
                self.bytes.append((a + b).encode())
                self.parts.append((ids[a], ids[b]))
                self.made.append(ids[a + b])

    assert Small([("a", "b")])._lookahead() == 1
    # whether a joins b waits for c, as b c comes first; whether b joins c waits for d
    assert Small([("c", "d"), ("b", "c"), ("a", "b")])._lookahead() == 3
    assert Small([("a", "b"), ("c", "d"), ("ab", "cd")])._lookahead() == 2


def test_tokens_leave_ordinary_words_early(library):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    codec = Codec(PATH)
    n = sum(len(ids) // 4 for _, ids, _ in codec.blocks(docs))
    assert n == sum(len(x.ids) for x in library.encode_batch(docs, add_special_tokens=False))
    assert codec.encoder.early > 10_000 and codec.encoder.run.most < 300


@pytest.mark.parametrize("unit", ["x", "=", "abcdefghijklmnopqrstuvwxyz", "\u65e5\u672c"])
def test_long_runs_without_spaces(unit, library):
    text = (unit * 1_000_000)[:1_000_000]
    codec, start = Codec(PATH), time.process_time()
    ids = b"".join(body for _, body, _ in codec.blocks([text]))
    assert time.process_time() - start < 20  # a few seconds alone
    assert codec.encoder.run.most <= codec.merges.window
    part = text[:20_000]
    assert np.frombuffer(b"".join(body for _, body, _ in codec.blocks([part])), "<u4").tolist() == library.encode(part, add_special_tokens=False).ids
    assert codec.decoder.text(np.frombuffer(ids, "<u4")) == text


def test_memory_forgets_the_rare_only(library):
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(3000)]
    texts = [" ".join(["always", *words[i : i + 40]]) for i in range(0, 3000, 40)]
    encoder = PieceEncoder(Encoder(MERGES, 200 * 100).many, True, MERGES.special, 200 * 100)
    for t in texts * 2:
        (body,) = encoder.texts([t])
        assert np.frombuffer(body, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.kept.young) + len(encoder.kept.older) <= 2 * (encoder.kept.most + 41)


def test_digests_in_blocks(spark, library, monkeypatch):
    texts = [None, "", "a b", ("word \u00e9\u20ac " * 300_000), "x" * 2_500_000]
    rows = digests(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA), PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        text = texts[r.doc_id] or ""
        if len(text) < 2_000_000 or " " in text:
            ids = library.encode(text, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(text)


def test_decoder_splits_characters(merges, library):
    ids = [merges.of_byte[b] for b in "aé😀".encode()] + [merges.of_byte[0xE2], merges.of_byte[0x82]] + [merges.of_byte[0xFF]]
    for step in (1, 2, 5):
        assert Decoder(merges).text(np.array(ids), step) == library.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in op1_bpe(spark, "/root/testdata/sf0.01").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert tuple(got[r.doc_id][1:]) == want


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None, "x", "y"), (None, "a b", "", ""), (2, "", "", ""), (2, "", "", "")], SCHEMA)
    made = encode(docs, PATH, decoded=True)
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in made.collect()) == [(0, 2, "a b"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert sorted((r.doc_id or 0, r.text) for r in decode(encode(docs, PATH), PATH).collect()) == [(0, "a b"), (1, ""), (2, ""), (2, "")]
    assert encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_very_long(spark, library):
    text = ("thendor  and\n the " + "x" * 700 + " ") * 3000
    row = encode(spark.createDataFrame([(1, text, "", "")], SCHEMA), PATH, decoded=True).first()
    assert row.decoded == text and row.ids == library.encode(text, add_special_tokens=False).ids
