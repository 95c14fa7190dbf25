"""Vectorised words and word-range hashes of many texts at once, straight from their UTF-8 bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np

U = np.uint64
#: Odd multipliers of the two range hashes and their inverses modulo 2**64.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
INVERSES = tuple(pow(m, -1, 1 << 64) for m in MULTIPLIERS)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For texts in lower case: everything but ASCII letters, digits and bytes of other characters separates.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept between calls up to four million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=U)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xDABA0B6EB09322E3)
        x = (x ^ (x >> U(29))) * U(0xBD2D3A4CCF9AC47F)
        return x ^ (x >> U(32))


def range_hash(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of a range from the sum of its values times powers from 0 on, and its length."""
    with np.errstate(over="ignore"):
        return mix(raw + length.astype(U) * U(0x9FB21C651E98DF25))


class RangeHash:
    """Hashes of ``values[a:b]`` for any ranges, by prefix sums; equal ranges of any arrays have equal hashes."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.which, n = which, len(values)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(MULTIPLIERS[which], n), out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[b] - self.sums[a]) * powers(INVERSES[self.which], len(self.sums))[a]
        return range_hash(raw, b - a)


class Words:
    """Words of many texts: ``hashes`` in a row, ``first[d]:first[d + 1]`` those of text d, byte ranges in ``raw``."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        self.raw = b" ".join([*texts, b""])
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[False], ~separators[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.hashes = RangeHash(data.astype(U) + U(1))(self.start, self.end)
        self.offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, self.offset)

    def digests(self, a: np.ndarray, b: np.ndarray, size: int = 16) -> list[bytes]:
        """Cryptographic digests of the words ``a[k]`` to before ``b[k]``, with one blank between them."""
        text = b" ".join(self.raw.split())
        at = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        return [hashlib.blake2b(text[x:y], digest_size=size).digest() for x, y in zip(at[a].tolist(), (at[b] - 1).tolist(), strict=True)]


def pieces_of(text: bytes, most: int, overlap: int, separators: np.ndarray = SPACE):
    """``(piece, behind)`` of a text: pieces of about ``most`` bytes that end before a word, and what follows a piece up to
    the end of the next ``overlap`` words, so that every range of ``overlap + 1`` words lies in a piece and what is behind it."""
    n = len(text)
    if n <= most:
        yield text, b""
        return
    space = re.escape(bytes(np.flatnonzero(separators).astype(np.uint8)))
    word, gap = re.compile(b"[" + space + b"]*[^" + space + b"]+"), re.compile(b"[" + space + b"]+")
    at = 0
    while at < n:
        found = gap.search(text, at + most) if at + most < n else None
        end = stop = found.end() if found else n
        for _ in range(overlap):
            m = word.match(text, stop)
            if not m:
                break
            stop = m.end()
        yield text[at:end], text[end:stop]
        at = end


def slices(sizes: list[int], most: int):
    """Ranges of consecutive texts of about ``most`` bytes together."""
    at = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)
