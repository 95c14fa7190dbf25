"""Tokenisation through the ``tokenizers`` library with a bounded cache of encoded chunks.

A text is cut only where the tokenizer itself always starts a new word, so that encoding the chunks one by one gives
the ids of the whole text; texts that contain a special token's string go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np

#: Unicode White_Space, which is what the byte-level pattern's ``\s`` matches.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pattern with its three kinds of non-space runs put together.
BYTE_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
#: A character that is no white space before a blank and another one: a new word starts at the blank in every pattern here.
BLANK = re.compile(f"[^{SPACE}\x1c-\x1f](?= [^{SPACE}\x1c-\x1f])").search


ASIS = "\0"
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def byte_keys(text: str) -> list[str]:
    """Chunks of the byte-level pattern as keys: a word stands for itself after a blank, one with ``\\n`` in front for a
    line's first word, one with ``ASIS`` in front for just what follows. Texts with runs of white space go by the pattern."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ASIS in text or OTHER_SPACE(text):
        return [ASIS + c for c in BYTE_CHUNKS(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = ASIS + keys[0]
    if keys[-1] in ("", "\n"):
        return [ASIS + c for c in BYTE_CHUNKS(text)]
    return keys


def word_chunks(text: str) -> list[bytes]:
    """The word-level pattern drops white space; ASCII white space is always a boundary there."""
    return text.encode().split()


#: Chunks kept per Python worker (about 200 bytes each).
CACHE_ENTRIES = 800_000
#: Characters of text looked at together; bounds what a worker holds besides one text.
GROUP_CHARS = 1 << 20
LONG_CHUNK = 200


class Chunks(dict):
    """Chunks to their ids; those not seen yet are encoded as they are asked for, and kept unless they are long.

    Two generations: when the young one is full it becomes the old one, from which chunks come back when they are asked
    for, so that frequent ones stay and what is rare goes.
    """

    def __init__(self, encode: Callable[[Chunks, str | bytes], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk):
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(self, chunk)
            if len(chunk) > LONG_CHUNK:
                return ids
        self[chunk] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class ChunkCache:
    """Texts to bytes of little-endian unsigned 32-bit ids, by a chunker and a function for chunks not seen yet."""

    def __init__(self, chunks: Callable[[str], list], encode: Callable[[Chunks, str | bytes], bytes],
                 specials: list[str], whole: Callable[[str], bytes], largest_id: int, entries: int = CACHE_ENTRIES):
        self.chunks, self.specials, self.whole, self.entries, self.largest_id = chunks, specials, whole, entries, largest_id
        self.cache = Chunks(encode)

    def parts(self, text: str) -> Iterator[str]:
        """A long text in pieces of about ``GROUP_CHARS``, each from a single blank between two words on."""
        at = 0
        while len(text) - at > 2 * GROUP_CHARS:
            cut = BLANK(text, at + GROUP_CHARS)
            if not cut:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def _one(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.whole(text)
        if len(self.cache) > self.entries // 2:
            self.cache.turn()
        return b"".join(map(self.cache.__getitem__, self.chunks(text)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            t = t or ""
            long_ = len(t) > 2 * GROUP_CHARS and not any(s in t for s in self.specials)
            out.append(b"".join(map(self._one, self.parts(t))) if long_ else self._one(t))
        return out


#: Letters of one byte or two that are composed and keep their class in lower case.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A plain chunk: letters, then punctuation; the tokenizer always starts a new word between the two.
PLAIN = re.compile(f"([{LETTERS}]+)([!-&(-/:-@[-`{{-~]*)").fullmatch


def byte_characters() -> str:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return "".join(chr(b if b in own else next(moved)) for b in range(256))


class PlainEncoder:
    """Encodes unseen chunks: plain ones by the library's model, their letters and punctuation apart; others whole.

    Letters are kept under the chunk that they are alone: after a blank for byte-level chunks, in lower case for others.
    """

    def __init__(self, tok, lower: bool):
        self.tok, self.model, self.lower = tok, tok.model, lower
        self.tails: dict[str, bytes] = {"": b""}
        self.mapped = dict(enumerate(byte_characters()))

    def each(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def tail(self, chunk: str) -> bytes:
        if chunk not in self.tails:
            if len(self.tails) > 1000:
                self.tails = {"": b""}
            self.tails[chunk] = self.each(chunk)
        return self.tails[chunk]

    def core(self, word: str) -> bytes:
        """Ids of a run of letters, perhaps after a blank, which is one word to the pre-tokenizer."""
        blank, letters = (self.mapped[32], word[1:]) if word[0] == " " else ("", word)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.mapped)
        return array("I", [t.id for t in self.model.tokenize(blank + letters)]).tobytes()

    def __call__(self, kept: Chunks, key: str | bytes) -> bytes:
        text = key if isinstance(key, str) else key.decode()
        before, at = " ", 0
        if not self.lower and text[:1] in ("\n", ASIS):
            before, at = text[0], 1
        if len(text) >= LONG_CHUNK or not (m := PLAIN(text, at)):
            return self.each(text[1:] if before == ASIS else text if before == "\n" or self.lower else f" {text}")
        word, tail = m.groups()
        if self.lower:
            word = word.lower()
            name = word.encode()
        else:
            name = word if before == " " else ASIS + word
        if name == key:
            return self.core(word if self.lower or before != " " else f" {word}")
        return (self.tail("\n") if before == "\n" else b"") + kept[name] + self.tail(tail)


_encoders: dict[str, ChunkCache] = {}


def forget_encoders() -> None:
    """Drop the encoders of this process with the chunks they keep."""
    _encoders.clear()


def library_encoder(path: str, entries: int = CACHE_ENTRIES) -> ChunkCache:
    """The cached encoder for a ``tokenizers`` file, one per worker process, which keeps up to ``entries`` chunks.

    Special tokens in a text are honoured.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        byte_level = tok.decoder is not None and tok.normalizer is None
        _encoders[path] = ChunkCache(
            byte_keys if byte_level else word_chunks,
            PlainEncoder(tok, lower=not byte_level),
            [t.content for t in tok.get_added_tokens_decoder().values()],
            lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(),
            max(tok.get_vocab(with_added_tokens=True).values(), default=0),
        )
    _encoders[path].entries = entries
    return _encoders[path]
