"""Words of many texts at once: positions and 64-bit codes with numpy, no loop over words.

A word's code is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed. Texts are cut at white space into pieces of about a megabyte, so memory
does not depend on how long one text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but \x20 and \x09-\x0D.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            row = np.full(max(n, PIECE + 4096), base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit codes evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(texts: Iterable[bytes | None], size: int = PIECE, kind: np.ndarray = WORD) -> Iterator[tuple[bytes, list[int]]]:
    """Joins texts with blanks to pieces of about ``size`` bytes: (bytes, number of the text at each part). Long texts are cut between words."""
    held: list[bytes] = []
    own: list[int] = []
    n = 0
    gap = [bytes([x]) for x in (0x20, 0x0A) if not kind[x]]
    for k, text in enumerate(texts):
        text = text or b""
        at = 0
        while len(text) - at > size:
            end = max(text.rfind(x, at, at + size) for x in gap)
            if end <= at:
                end = min((x for x in (text.find(g, at + size) for g in gap) if x >= 0), default=len(text))
            if held:
                yield b" ".join(held), own
                held, own, n = [], [], 0
            yield text[at:end], [k]
            at = end
        held.append(text[at:])
        own.append(k)
        n += len(text) - at
        if n >= size:
            yield b" ".join(held), own
            held, own, n = [], [], 0
    if held:
        yield b" ".join(held), own


def slices(texts: list[bytes | str | None], size: int = PIECE) -> Iterator[slice]:
    """Runs of texts of about ``size`` bytes together, so that what is computed for one run stays small."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def word_codes(texts: list[bytes | None], kind: np.ndarray = WORD, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """Codes of all words of all texts in order, and the number of words of each text. With ``shapes`` also a code of each word's shape."""
    codes, shape_codes = [], []
    counts = np.zeros(len(texts), np.int64)
    for data, own in pieces(texts, kind=kind):
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            continue
        low = LOWER[raw]
        inside = kind[low]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        power, inverse = _pow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        codes.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
        if len(own) == 1:
            counts[own[0]] += len(start)
        else:
            sizes = np.fromiter((len(texts[k] or b"") for k in own[1:]), np.int64, len(own) - 1)
            first = len(data) - int(sizes.sum()) - len(own) + 1
            border = np.concatenate(([0], np.cumsum(np.concatenate(([first], sizes)) + 1)))
            counts[own] += np.diff(np.searchsorted(start, border))
        if shapes:
            kinds = _SHAPE[raw]
            new = np.ones(len(raw), bool)
            new[1:] = kinds[1:] != kinds[:-1]
            new[start] = True
            sums[1:] = np.cumsum(np.where(new, kinds.astype(np.uint64), np.uint64(0)) * _spread(new, start, end, power))
            shape_codes.append(mix(sums[end] - sums[start] + np.uint64(17)))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return (join(codes), counts, join(shape_codes)) if shapes else (join(codes), counts)


#: Classes of bytes for shapes: small, capital, digit, beyond ASCII; others are their own class.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 1


def _spread(new: np.ndarray, start: np.ndarray, end: np.ndarray, power: np.ndarray) -> np.ndarray:
    """For each byte the power that belongs to the number of its run of equal classes within its word."""
    runs = np.cumsum(new)
    base = np.zeros(len(new), np.int64)
    base[start] = runs[start]
    base = np.maximum.accumulate(base)
    return power[np.minimum(np.maximum(runs - base, 0), len(power) - 1)]


def shingles(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``width`` consecutive words of each text, and their number; a text of fewer words, but not none, is one shingle."""
    n = len(codes)
    ends = np.cumsum(counts)
    starts = ends - counts
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        part = codes[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        acc[: n - k] += part
    acc = mix(acc)
    left = np.repeat(ends, counts) - np.arange(n)
    keep = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    for k in short:
        own = codes[starts[k] : ends[k]]
        factors = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(len(own))], np.uint64)
        acc[starts[k]] = mix(np.array([(own * factors).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
        keep[starts[k]] = True
    out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    return acc[keep], out


def per_text_sets(codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The distinct codes of each text, sorted."""
    out, at = [], 0
    for n in counts.tolist():
        own = np.sort(codes[at : at + n])
        at += n
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if n else own)
    return out


class Lookup:
    """Values of distinct 64-bit keys in an open hash table, many at once; keys that are not there have the value ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float | int | None = None):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.missing = missing
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, values.dtype)
        owner = np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = owner[slot] < 0
            owner[slot[free]] = left[free]
            placed = owner[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask
        self.full = owner >= 0
        self.keys[self.full], self.values[self.full] = keys[owner[self.full]], values[owner[self.full]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        look = np.flatnonzero((self.keys[slot] != keys) | ~self.full[slot])
        absent = []
        while len(look):
            there = self.full[slot[look]]
            if not there.all():
                absent.append(look[~there])
                look = look[there]
            slot[look] = (slot[look] + 1) & self.mask
            look = look[(self.keys[slot[look]] != keys[look]) | ~self.full[slot[look]]]
        out = self.values[slot]
        if absent:
            if self.missing is None:
                raise KeyError("a key is not in the table")
            out[np.concatenate(absent)] = self.missing
        return out
