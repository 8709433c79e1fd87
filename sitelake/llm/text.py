"""Texts of an Arrow batch as one array of code points, for work on all of them at once inside a task."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

# Stands between texts; no text can hold it.
END = 0x110000
LETTER, NUMBER, SPACE, OTHER, LAST = range(5)
# Texts worked on at once; a longer single text is worked on alone and whole.
CHUNK_CHARS = 1_000_000


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other; LAST for END."""
    out = np.full(END + 1, OTHER, dtype=np.uint8)
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    out[:-1][kinds == "L"], out[:-1][kinds == "N"] = LETTER, NUMBER
    for i in range(sys.maxunicode + 1):
        if chr(i).isspace():
            out[i] = SPACE
    out[END] = LAST
    return out


@cache
def marks() -> np.ndarray:
    """Code points of combining marks, which belong to words."""
    return np.array([unicodedata.category(chr(i))[0] == "M" for i in range(sys.maxunicode + 1)] + [False])


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, END after each text, and where each text begins (one more entry for the end)."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    codes = np.full(begins[-1], END, dtype=np.uint32)
    for r, b in zip(raw, begins):
        codes[b : b + len(r)] = r
    return codes, begins


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with ``limit`` characters each, or a single longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


@cache
def randoms(seed: int, n: int) -> np.ndarray:
    """Fixed random 64-bit odd numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    if not _POWERS or len(_POWERS[0]) < n:
        out = np.full(max(1024, 2 * n), 0x9E3779B97F4A7C15, dtype=np.uint64)
        out[0] = 1
        _POWERS[:] = [np.multiply.accumulate(out)]
    return _POWERS[0]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans codes[start:end], which are in order and don't overlap or are empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + offset
    table = randoms(11, 65536)
    low = codes[at]
    value = table[low & 0xFFFF] ^ (low.astype(np.uint64) >> np.uint64(16) << np.uint64(40))
    value *= _powers(int(lengths.max()))[offset]
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mixed(sums ^ (lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
