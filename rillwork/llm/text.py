"""Vectorised text kernels: code points, word hashes and n-gram hashes of many documents at once with numpy.

Hashes are 64 bits wide and the same on every machine and in every run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points that are handled at once; longer texts are cut at a blank and put together again.
PIECE = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _category(kinds: str) -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)), bool, 0x110000)


def letters() -> np.ndarray:
    return _category("L")


def letters_and_numbers() -> np.ndarray:
    return _category("LN")


@cache
def _char_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _B)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n at least; one table is kept, for the largest n so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        a, b = np.full(n, _B, np.uint64), np.full(n, _B_INV, np.uint64)
        a[0] = b[0] = 1
        _POWERS[:] = [np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(document, piece): long texts cut just after a blank, or where there is none, only at the end."""
    for i, t in enumerate(texts):
        t = (t or "").lower()
        at = 0
        while len(t) - at > PIECE:
            to = t.rfind(" ", at, at + PIECE)
            if to <= at:
                to = t.find(" ", at + PIECE)
                if to < 0:
                    break
            yield i, t[at : to + 1]
            at = to + 1
        yield i, t[at:] if at else t


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and offsets: text i has words[offsets[i]:offsets[i + 1]].

    A word is a longest run of letters and numbers (Unicode categories L and N) of the lower-cased text. Null is empty.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            codes = code_points("\n".join(p for _, p in group) + "\n")
            ends = np.cumsum([len(p) + 1 for _, p in group])
            inside = letters_and_numbers()[codes]
            edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            up, down = _powers(1 << max(10, int(len(codes)).bit_length()))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_char_values()[codes] * up[: len(codes)], dtype=np.uint64)])
            hashes.append(mix((total[stop] - total[start]) * down[start]))
            per_piece = np.diff(np.searchsorted(start, ends), prepend=0)
            np.add.at(counts, [i for i, _ in group], per_piece)
            group.clear()
            size = 0

    for piece in _pieces(texts):
        if size and size + len(piece[1]) > PIECE:
            flush()
        group.append(piece)
        size += len(piece[1]) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a text of fewer than n words, but at least one, has one gram of them all."""
    words, at = word_hashes(texts)
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        grams[: len(words) - k or None] += words[k:] * np.uint64(2 * k + 1) if k else words
        grams = mix(grams)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            g = np.zeros(1, np.uint64)
            for w in words[a:b]:
                g = mix(g * np.uint64(31) + w)
            yield g
        else:
            yield words[:0]


def spelled_words(texts: list[str | None], spell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths, spelling, offsets) of the words of word_hashes. ``spelling`` is the sum of spell[p, c] over the symbols c of a
    word, p the symbol before it, or 0 before the first; ``symbols`` below says which symbol a code point is."""
    hashes, offsets = word_hashes(texts)
    lengths, spelling = [np.zeros(0, np.int64)], [np.zeros(0)]
    for symbol, before, start, stop in word_symbols(texts):
        total = np.concatenate([[0.0], np.cumsum(spell[before, symbol], dtype=np.float64)])
        lengths.append(stop - start)
        spelling.append(total[stop] - total[start])
    return hashes, np.concatenate(lengths), np.concatenate(spelling), offsets


#: Symbols of spelling: 0 begins a word, most code points below PLAIN_SYMBOLS stand for themselves, the others share the rest.
SYMBOLS, PLAIN_SYMBOLS = 512, 448


def symbols(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < PLAIN_SYMBOLS, codes, PLAIN_SYMBOLS + codes % (SYMBOLS - PLAIN_SYMBOLS)).astype(np.int32)


def word_symbols(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of text, in order: (symbols, symbols before them, starts, ends of the words); symbols outside words are 0."""
    group: list[str] = []
    size = 0

    def stretch() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes = code_points("\n".join(group) + "\n")
        inside = letters_and_numbers()[codes]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        symbol = np.where(inside, symbols(codes), 0)
        return symbol, np.concatenate([[0], symbol[:-1]]), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    for _, piece in _pieces(texts):
        if size and size + len(piece) > PIECE:
            yield stretch()
            group, size = [], 0
        group.append(piece)
        size += len(piece) + 1
    if group:
        yield stretch()
