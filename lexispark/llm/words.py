"""Vectorised word folding and hashing of text columns, for use inside Arrow tasks.

A *word* is a maximal run of letters and digits after lower-casing and removing accents (Hangul syllables stay as stored).
A batch of texts is turned into one array of code points, folded by one table look-up, cut into words and hashed by
prefix sums, so the cost per character is a few array passes and no Python loop runs per character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Multipliers of the polynomial word hash and of the mixer (odd 64-bit constants, arbitrary).
_MUL = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IGNORED = np.uint32(0xFFFFFFFF)
#: Characters of one array pass; texts longer than this make a pass of their own.
CHUNK_CHARS = 1 << 20


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point -> folded letter or digit, 0 for a separator, ``_IGNORED`` for a combining mark."""
    table = np.zeros(0x110000, np.uint32)
    table[0x3400:0x9FFF] = np.arange(0x3400, 0x9FFF)
    table[0xAC00:0xD7A4] = np.arange(0xAC00, 0xD7A4)
    table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]:
        parts = unicodedata.normalize("NFD", chr(cp).lower())
        base = [c for c in parts if not unicodedata.combining(c)]
        if not base:
            table[cp] = _IGNORED
        elif unicodedata.category(base[0])[0] in "LN":
            table[cp] = ord(base[0])
    return table


@lru_cache(1)
def _value_table() -> np.ndarray:
    table = fold_table().astype(np.uint64)
    values = mix(table)
    values[(table == 0) | (table == _IGNORED)] = 0
    return values


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MUL)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    forth, back = (np.full(n, m, np.uint64) for m in (_MUL, pow(_MUL, -1, 1 << 64)))
    forth[0] = back[0] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


class Words:
    """Words of a batch of texts: ``hashes`` of all words in order, ``first[i]:first[i+1]`` those of text i."""

    __slots__ = ("chars", "ends", "first", "hashes", "starts")

    def __init__(self, hashes, first, chars, starts, ends):
        self.hashes, self.first, self.chars, self.starts, self.ends = hashes, first, chars, starts, ends


def split_words(texts: list[str | None]) -> Words:
    """Fold and cut every text of the batch; a null text has no words."""
    joined = "\n".join([t if t is not None else "" for t in texts]) + "\n"
    bounds = np.cumsum(np.fromiter((1 if t is None else len(t) + 1 for t in texts), np.int64, len(texts)))
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold_table()[raw]
    ignored = folded == _IGNORED
    if ignored.any():
        keep = ~ignored
        bounds = np.cumsum(keep)[bounds - 1]
        folded, raw = folded[keep], raw[keep]
    inside = np.concatenate([[False], folded != 0])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, np.concatenate([[0], bounds]))
    forth, back = _powers(max(10, int(len(folded)).bit_length()))
    sums = np.empty(len(folded) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_value_table()[raw] * forth[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, first, folded, starts, ends)


def chunks(texts: list[str | None], most: int = 4096, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Cut a batch into parts of at most ``most`` texts and about ``chars`` characters: (offset, texts)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and (size + n > chars or i - begin >= most):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, texts[begin:]


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words, and the first run of each text (runs never cross texts)."""
    h, first = words.hashes, words.first
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    out = h[at]
    for k in range(1, size):
        out = out * np.uint64(_MUL) + h[at + k]
    return mix(out), begin


def word_text(words: Words, i: int) -> str:
    """Folded text i with one space between its words."""
    a, b = words.first[i], words.first[i + 1]
    if a == b:
        return ""
    part = words.chars[words.starts[a] : words.ends[b - 1]]
    return " ".join(np.where(part == 0, np.uint32(32), part).tobytes().decode("utf-32-le", "surrogatepass").split())
