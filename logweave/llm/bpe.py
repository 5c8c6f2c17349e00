"""Operator 1, BPE encoding and decoding as streaming transducers with bounded memory.

Encoding.  Bytes of a pre-token go in one at a time.  For every position the transducer knows the one
token that ends there when the text ends there: of the tokens that are a suffix of the bytes so far,
the one that may follow the token before it (two tokens may follow each other if merging their bytes
gives the two again).  A position is live while a token of the vocabulary can still begin there, and
how far back that is depends on the state, the longest suffix that begins a token.  Whatever follows,
the next tokens begin at live positions only; so the tokens on which the chains of all live positions
agree can't change any more, and are emitted.

That this happens soon, and memory stays constant, follows from the merge list.  Whether a merge
removes the boundary at a byte depends on a bounded number of bytes to its right: merge j at a
boundary needs the bytes of its right part v, and that no earlier merge takes v's right end away;
such a merge k has as left part a token on the right edge of v's derivation, and needs its own
lookahead from there.  So::

    need(j) = len(v) + max(0, need(k) for k < j whose left part is on the right edge of v)

and the list's sufficient lookahead is the largest need.  Chains of positions so far from the end
agree, so never more than that and two of the longest tokens are held.

Decoding.  Ids map to bytes, and an incremental UTF-8 decoder carries the unfinished character from
one block of ids to the next; ill-formed bytes become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forgets, hold, slices, table
from .encoding import BLOCK, BYTE_BPE, KEPT_BYTES, Memory, PieceEncoder, blocks, byte_chars, tokenizer_path

NEVER = 1 << 40
#: Longest word whose ids a worker keeps, in characters.
KEPT_CHARS = 48
#: Pairs of tokens and steps of the automaton that a worker keeps before it starts afresh.
KEPT_PAIRS, KEPT_STEPS = 500_000, 300_000
#: Bytes between two looks for tokens that are stable, and ids decoded at once.
LOOK = 8
DECODE_STEP = 1 << 16


class MergeList:
    """A byte-level vocabulary with ranked merges, read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = self.vocab[c]
        #: left << 20 | right -> rank, and rank -> the merged id
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = self.vocab[a], self.vocab[b]
            self.ranks[left << 20 | right] = rank
            self.made.append(self.vocab[a + b])
            self.parts.append((left, right))
        if len(set(self.made)) < len(self.made):
            raise ValueError("two merges make the same token: the lookahead below assumes one derivation each")
        self.longest = max(map(len, self.bytes))
        self.lookahead = self._lookahead()
        #: bytes that are held at most: see the module's text
        self.window = self.lookahead + 2 * self.longest + LOOK
        self.automaton = Automaton(self)

    def _lookahead(self) -> int:
        right_part = {m: r for m, (_, r) in zip(self.made, self.parts)}
        need_after: dict[int, int] = {}
        most = 0
        for left, right in self.parts:
            further, edge = 0, right
            while edge is not None:
                further = max(further, need_after.get(edge, 0))
                edge = right_part.get(edge)
            need = len(self.bytes[right]) + further
            need_after[left] = max(need_after.get(left, 0), need)
            most = max(most, need)
        return most

    def merge(self, body: bytes) -> list[int]:
        """Tokens of a whole pre-token (or of a buffer as if it ended here)."""
        ids = [self.of_byte[b] for b in body]
        get = self.ranks.get
        ranks = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != NEVER:
            i = ranks.index(rank)
            ids[i] = self.made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NEVER)
        return ids


class Automaton:
    """What the transducers of a merge list share: steps over bytes, and which tokens may be neighbours.

    A state is the longest suffix of the bytes so far that is the beginning of a token, so there are
    no more states than beginnings.  All is made as texts need it; so many steps and pairs are kept.
    """

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        special = set(merges.special.values())
        self.ids = {b: i for i, b in enumerate(merges.bytes) if i not in special}
        self.begins = {b[:n] for b in self.ids for n in range(len(b) + 1)}
        self.proper = {b[:n] for b in self.ids for n in range(len(b))}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.texts = [b""]
        #: (length, id) of the tokens that end in a state, longest first, and how far back live positions are
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.lives: list[tuple[int, ...]] = [(0,)]
        self.steps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def move(self, state: int, byte: int) -> int:
        text = self.texts[state] + bytes([byte])
        while text not in self.begins:
            text = text[1:]
        if (to := self.numbers.get(text)) is None:
            to = self.numbers[text] = len(self.texts)
            suffixes = [text[i:] for i in range(len(text))]
            self.texts.append(text)
            # a token that its own bytes don't make is never the outcome
            self.ends.append(tuple((len(x), self.ids[x]) for x in suffixes if x in self.ids and self.merges.merge(x) == [self.ids[x]]))
            self.lives.append(tuple(len(x) for x in suffixes if x in self.proper) + (0,))
        if len(self.steps) >= KEPT_STEPS:
            self.steps.clear()
        self.steps[state << 8 | byte] = to
        return to

    def follows(self, pair: int) -> bool:
        """Whether the token in the lower bits may come after the one above them."""
        m, left, right = self.merges, pair >> 20, pair & 0xFFFFF
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        good = self.pairs[pair] = m.merge(m.bytes[left] + m.bytes[right]) == [left, right]
        return good


class Transducer:
    """Bytes of one pre-token in, stable tokens out.

    ``last[i]`` is the token that ends i bytes after the last emitted one, ``back[i]`` where it begins;
    place 0 stands for what was emitted.
    """

    def __init__(self, merges: MergeList) -> None:
        self.automaton, self.state = merges.automaton, 0
        self.last, self.back = [-1], [0]
        self.most = 0

    def feed(self, data: bytes) -> list[int]:
        a = self.automaton
        steps, ends, pairs = a.steps, a.ends, a.pairs
        last, back, state, here = self.last, self.back, self.state, len(self.last)
        out: list[int] = []
        for byte in data:
            to = steps.get(state << 8 | byte)
            state = a.move(state, byte) if to is None else to
            for length, token in ends[state]:
                at = here - length
                if at <= 0:
                    if at or last[0] < 0:  # at the beginning any token may stand
                        if at:
                            continue
                        break
                before = last[at] << 20 | token
                good = pairs.get(before)
                if a.follows(before) if good is None else good:
                    break
            else:
                raise ValueError("no token can end here: the vocabulary lacks a byte")
            last.append(token)
            back.append(at)
            here += 1
            if not here % LOOK:
                out += self._settled(state)
                here = len(last)
        self.state = state
        return out

    def _settled(self, state: int) -> list[int]:
        """Tokens on which all live positions agree; they leave the buffer."""
        last, back = self.last, self.back
        here = agreed = len(last) - 1
        if here > self.most:
            self.most = here
        for length in self.automaton.lives[state]:
            at = here - length
            while at != agreed:
                if at > agreed:
                    at = back[at]
                else:
                    agreed = back[agreed]
            if not agreed:
                return []
        out = self._chain(agreed)
        del last[:agreed]
        back[:] = [b - agreed if b > agreed else 0 for b in back[agreed:]]
        return out

    def _chain(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at])
            at = self.back[at]
        return out[::-1]

    def close(self) -> list[int]:
        """The rest, as the pre-token ends here; the transducer is as new afterwards."""
        out = self._chain(len(self.last) - 1)
        self.last, self.back, self.state = [-1], [0], 0
        return out


class Encoder:
    """Splits text into pre-tokens and runs the transducer over each; short ones are remembered.

    ``early`` counts the tokens that came out before their pre-token's end.
    """

    def __init__(self, merges: MergeList, most: int = KEPT_BYTES // 8) -> None:
        import public_tokenizers
        import regex

        self.merges = merges
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
        self.kept = Memory(most)
        self.run, self.early = Transducer(merges), 0

    def _word(self, word: str) -> bytes:
        if (made := self.kept.recall(word)) is not None:
            return made
        run, ids = self.run, array("I")
        for at in range(0, len(word), DECODE_STEP):
            ids.extend(run.feed(word[at : at + DECODE_STEP].encode()))
        self.early += len(ids)
        ids.extend(run.close())
        made = ids.tobytes()
        if len(word) <= KEPT_CHARS:
            self.kept.young[word] = made
        return made

    def encode(self, text: str) -> bytes:
        if self.marks is not None and "<|" in text:
            out = []
            for part in self.marks.split(text):
                out.append(self.merges.special[part].to_bytes(4, "little") if part in self.merges.special else self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        kept = self.kept.young
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):  # one word, as most new pieces are
            return kept[text] if text in kept else self._word(text)
        return b"".join([kept[w] if w in kept else self._word(w) for w in self.words.findall(text)])

    def many(self, pieces: list[str]) -> list[bytes]:
        self.kept.turn()
        return [self.encode(p) for p in pieces]


class Decoder:
    """Ids in, text out, block by block."""

    def __init__(self, merges: MergeList) -> None:
        self.table = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def close(self) -> str:
        """What is left of an unfinished character; the decoder is as new afterwards."""
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def text(self, ids: np.ndarray, step: int = DECODE_STEP) -> str:
        self.state.reset()
        parts = [self.feed(ids[i : i + step].tolist()) for i in range(0, len(ids), step)]
        return "".join([*parts, self.close()])


class Codec:
    """Encoder and decoder of one vocabulary, texts and ids in blocks."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.encoder = Encoder(self.merges)
        self.pieces = PieceEncoder(self.encoder.many, True, self.merges.special)
        self.decoder = Decoder(self.merges)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bool]]:
        """(place of the text, ids as bytes, whether they are its last) for parts of each text in order.

        A long text comes in parts of about BLOCK characters, so neither its ids nor the text that
        they decode to are ever held as a whole.
        """
        held: list[str] = []
        size = first = 0
        for i, t in enumerate(texts):
            t = t or ""
            if len(t) <= BLOCK:
                held.append(t)
                size += len(t)
            if len(t) > BLOCK or size >= BLOCK:
                yield from ((first + k, ids, True) for k, ids in enumerate(self.pieces.many(held)))
                held, size, first = [], 0, i + 1
            if len(t) > BLOCK:
                parts = blocks(t)
                part = next(parts)
                while part is not None:
                    following = next(parts, None)
                    yield i, self.pieces.many([part])[0], following is None
                    part = following
        yield from ((first + k, ids, True) for k, ids in enumerate(self.pieces.many(held)))


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


forgets(codec.cache_clear)


def _lists(bodies: list[bytes]) -> pa.Array:
    """An Arrow array of lists of ints over the ids' bytes."""
    cuts = np.concatenate(([0], np.cumsum([len(b) // 4 for b in bodies]))).astype("<i4")
    values = pa.Array.from_buffers(pa.int32(), int(cuts[-1]), [None, pa.py_buffer(b"".join(bodies))])
    return pa.ListArray.from_arrays(pa.array(cuts), values)


def _encode(batches: Iterator[pa.RecordBatch], path: str, decoded: bool, step: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    hold(path)
    c = codec(path)
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]
    for batch in slices(batches, kind=path):
        docs, held, first, size = batch.column(0), [], 0, 0
        parts: list[bytes] = []
        for i, ids, over in c.blocks(batch.column(1).to_pylist()):
            parts.append(ids)
            if not over:
                continue
            held.append(b"".join(parts))
            parts = []
            size += len(held[-1])
            if size >= step or i + 1 == batch.num_rows:
                columns = [docs.slice(first, len(held)), _lists(held)]
                if decoded:
                    columns.append(pa.array([c.decoder.text(np.frombuffer(b, "<u4")) for b in held], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
                held, first, size = [], i + 1, 0


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    hold(path)
    decoder = codec(path).decoder
    for batch in slices(batches, kind=path):
        texts = [decoder.text(np.asarray(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Digests of what the encoder emits and the decoder makes of it, block by block."""
    hold(path)
    c = codec(path)
    decimal = [b"%d," % i for i in range(len(c.merges.bytes))]
    for batch in slices(batches, kind=path):
        rows: list[tuple[int, str, str]] = []
        ids_sha, text_sha, tokens, comma = hashlib.sha256(), hashlib.sha256(), 0, b""
        for _, body, over in c.blocks(batch.column(1).to_pylist()):
            ids = np.frombuffer(body, "<u4").tolist()
            if ids:
                tokens += len(ids)
                # the comma after a block's last id waits for the next block
                ids_sha.update(comma + b"".join(map(decimal.__getitem__, ids))[:-1])
                comma = b","
                text_sha.update(c.decoder.feed(ids).encode())
            if over:
                text_sha.update(c.decoder.close().encode())
                rows.append((tokens, ids_sha.hexdigest(), text_sha.hexdigest()))
                ids_sha, text_sha, tokens, comma = hashlib.sha256(), hashlib.sha256(), 0, b""
        columns = [pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * 3, _DIGEST)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_DIGEST.names])


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``docs(doc_id, text, ...)``.

    ``decoded`` adds what the decoder makes of the ids, in the same pass.  Null and empty texts have
    no ids and decode to the empty text; very long texts and runs without white space are encoded in
    blocks, with bounded memory but for the row itself; null and repeated doc_ids stay as they are; an
    empty table gives no rows; other columns are not read, so their names can't clash.
    """
    rows, kind = _texts(docs)
    return rows.mapInArrow(lambda it: _encode(it, path, decoded), f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encode`` gives: ids as decimal text
    joined by commas, the decoded text as UTF-8.

    Blocks of ids are digested as the encoder emits them, so memory is bounded whatever a text's length.
    Nulls, empty and very long texts, repeats and other columns are as for ``encode``.
    """
    rows, kind = _texts(docs)
    return rows.mapInArrow(lambda it: _digest(it, path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids, ...)``; null ids decode to the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        lambda it: _decode(it, path), f"doc_id {kind}, text string"
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
