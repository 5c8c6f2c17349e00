"""Token ids of whole texts, one encoder call per distinct piece instead of one per text.

Both public vocabularies split a text before any merge, and no split depends on more than the white
space around it.  So a text falls into pieces at single spaces, pieces repeat (Zipf), and the ids of
a text are the joined ids of its pieces, kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from .common import forgets

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Bytes of pieces that a worker remembers, about, and the longest piece that it does.
KEPT_BYTES = 320 << 20
KEPT_CHARS = 40
#: What a remembered piece takes: two small objects and a place in a table.
ENTRY_BYTES = 200
#: Characters of text that are split at once, so that memory does not follow a text's length.
BLOCK = 1 << 20
#: A space between two characters that are not white space: no split sees across it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """The text in parts of about ``block`` characters, each later one beginning with a safe space."""
    at = 0
    while len(text) - at > block:
        cut = text.rfind(" ", at + 1, at + block)
        while cut > at and not _SAFE.match(text, cut):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            if (m := _SAFE.search(text, at + block)) is None:
                break
            cut = m.start()
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Memory:
    """Ids by piece within ``most`` bytes, in two generations.

    When the younger one has filled half of the bytes it becomes the older one, and what was not met
    again by the time the next has filled up is forgotten.  So frequent pieces stay, rare ones go, and
    the memory is bounded by bytes: pieces are at most KEPT_CHARS long, and a place counts ENTRY_BYTES.
    """

    def __init__(self, most: int) -> None:
        self.most = most // (2 * ENTRY_BYTES)
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def recall(self, piece: str) -> bytes | None:
        """Ids of a piece that is not in the younger generation; it is from now on."""
        if (ids := self.older.get(piece)) is not None:
            self.young[piece] = ids
        return ids

    def recalled(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The same for many, with those that are remembered."""
        older = self.older
        found = {p: older[p] for p in pieces if p in older}
        self.young.update(found)
        return found

    def turn(self) -> None:
        """To be called between texts."""
        if len(self.young) > self.most:
            self.older, self.young = self.young, {}


class PieceEncoder:
    """``encode(pieces)`` gives the ids of each piece as bytes; ``spaced`` pieces carry their space.

    ``marks`` are strings (special tokens) that must not be parted from white space before them.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaced: bool, marks: Iterable[str] = (), most: int = KEPT_BYTES) -> None:
        self.encode, self.space, self.marks = encode, " " * spaced, tuple(marks)
        self.kept = Memory(most)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not kept; short ones are kept from now on."""
        made = dict(zip(pieces, self.encode([self.space + p for p in pieces] if self.space else pieces)))
        # pieces across a line end are as good as never seen again
        self.kept.young.update({p: ids for p, ids in made.items() if len(p) <= KEPT_CHARS and "\n" not in p})
        return made

    def _risky(self, piece: str) -> bool:
        """White space or a mark at a cut: what stands before the piece could change its ids."""
        return not piece or piece[0].isspace() or ("<" in piece and any(m in piece for m in self.marks))

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  All texts together should be a few MB."""
        self.kept.turn()
        # the first piece of a text has no space before it; later blocks begin with one
        split = [t.split(" ") for t in texts]
        heads = self.encode([s[0] for s in split])
        flat: list[str] = []
        ends = []
        for s in split:
            flat += s[1:]
            ends.append(len(flat))
        found = list(map(self.kept.young.get, flat))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        missing = dict.fromkeys([flat[i] for i in gaps])
        made = self.kept.recalled(missing) if self.kept.older else {}
        new = [p for p in missing if p not in made] if made else list(missing)
        risky = {p for p in new if self._risky(p)} if self.space else set()
        made |= self._learn([p for p in new if p not in risky] if risky else new)
        for i in gaps:
            found[i] = made.get(flat[i])
        out = [h + b"".join(found[a:b]) if not risky or None not in found[a:b] else None for h, a, b in zip(heads, [0, *ends], ends)]
        if risky:
            for i, ids in enumerate(out):
                if ids is None:
                    head, *rest = _SAFE.split(texts[i])
                    known = {p: ids for p in dict.fromkeys(rest) if (ids := self.kept.young.get(p)) is not None}
                    known |= self._learn([p for p in dict.fromkeys(rest) if p not in known])
                    out[i] = self.encode([head])[0] + b"".join(map(known.__getitem__, rest))
        return out

    def texts(self, texts: list[str | None], budget: int = BLOCK) -> Iterator[bytes]:
        """Ids of each text in order; null counts as empty."""
        held: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > BLOCK:
                yield from self.many(held)
                held, size = [], 0
                yield b"".join(self.many([part])[0] for part in blocks(t))
                continue
            held.append(t)
            size += len(t)
            if size >= budget:
                yield from self.many(held)
                held, size = [], 0
        yield from self.many(held)


#: How a byte-level vocabulary writes bytes: printable ones as they are, the rest from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Below this character no letter decomposes, combines or has an unusual class.
_SIMPLE = "\u0300"


def byte_chars() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class LibraryWords:
    """Ids of pieces from the tokenizers library.

    Pieces of simple characters are split into words here and each new word goes to the library's
    model; all others, and special tokens, go through the library whole.
    """

    def __init__(self, path: str, spaced: bool, most: int = KEPT_BYTES // 4) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        self.marks = tuple(x.content for x in t.get_added_tokens_decoder().values())
        self.spaced = spaced
        pattern = public_tokenizers.PATTERN
        if not spaced:  # the lower-casing vocabulary drops white space and takes digits one by one
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(pattern).findall
        self.model = t.model.tokenize
        self.bytes = str.maketrans({chr(b): c for c, b in byte_chars().items()})
        self.kept = Memory(most)
        #: words after a space, without it: the pieces of an encoder of spaced pieces
        self.known = Memory(most) if spaced else self.kept
        self.stops = {c: self._word(c) for c in ",."}
        self.line = b"".join(map(self._word, self.split(".\n")))

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def _of(self, word: str) -> bytes:
        """Ids of one word: those with a space are kept among the pieces, without it."""
        kept, key = (self.known, word[1:]) if self.spaced and word[0] == " " else (self.kept, word)
        made = kept.young.get(key)
        if made is None and (made := kept.recall(key)) is None:
            made = self._word(word)
            if len(key) <= KEPT_CHARS:
                kept.young[key] = made
        return made

    def encode(self, pieces: list[str]) -> list[bytes]:
        self.kept.turn()
        known, young, spaced, out = self.known, self.known.young, self.spaced, []
        for p in pieces:
            if not p:
                out.append(b"")
                continue
            if not ((p.isascii() or max(p) < _SIMPLE) and not ("<|" in p and any(m in p for m in self.marks))):
                out.append(array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes())
                continue
            if spaced:
                bare = p[1:] if p[0] == " " else ""
            else:
                bare = p = p.lower()
            # most new pieces are one word, perhaps with a stop after it
            if bare.isalpha():
                stop = b""
            elif bare[-1:] in self.stops and bare[:-1].isalpha():
                stop, p, bare = self.stops[bare[-1]], p[:-1], bare[:-1]
            else:
                # the end of a line between two words is the next most common
                head, line, tail = bare.partition(".\n")
                after = self.stops.get(tail[-1:], b"")
                if line and head.isalpha() and (tail[:-1] if after else tail).isalpha():
                    out.append(self._of(p[: len(p) - len(bare) + len(head)]) + self.line + self._of(tail[:-1] if after else tail) + after)
                else:
                    out.append(b"".join(map(self._of, self.split(p))))
                continue
            ids = young.get(bare)
            if ids is None and (ids := known.recall(bare)) is None:
                ids = self._word(p)
                if stop and len(bare) <= KEPT_CHARS:
                    young[bare] = ids
            out.append(ids + stop)
        return out


@lru_cache(maxsize=1)
def library_encoder(path: str, spaced: bool, most: int = KEPT_BYTES) -> PieceEncoder:
    """Ids as the tokenizers library's ``encode(text, add_special_tokens=False)`` gives them.

    ``most`` bytes are remembered, three quarters of them for pieces.
    """
    words = LibraryWords(path, spaced, most // 4)
    encoder = PieceEncoder(words.encode, spaced, words.marks, most - most // 4)
    if spaced:
        words.known = encoder.kept
    return encoder


forgets(library_encoder.cache_clear)
