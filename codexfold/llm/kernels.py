"""Vectorised hashing of words and word shingles over chunks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from codexfold.llm.common import text_chunks

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(19170).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling, up to 2**20 kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n - 1, 1).bit_length()
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def word_hashes(body: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's first word number.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r; texts never share one.
    """
    n_texts, size = len(offsets) - 1, len(body)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    if lower:
        body = _LOWER[body]
    space = _SPACE[body]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = ~space[firsts]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[firsts[1:] - 1] = ~space[firsts[1:] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[body] * powers(_BASE, size), out=sums[1:])
    words = (sums[stops] - sums[starts]) * powers(_BASE_INVERSE, size)[starts]
    return mix(words ^ (stops - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of an array of texts.

    A text of fewer than ``width`` words is one shingle, one without words none.
    """
    for lo, hi, body, offsets in text_chunks(texts):
        words, first = word_hashes(body, offsets)
        m = len(words) - width + 1
        rolled = np.zeros(max(m, 0), np.uint64)
        for k in range(width if m > 0 else 0):
            rolled += words[k : k + m] * _STEPS[k]
        rolled = mix(rolled)
        for row in range(lo, hi):
            a, b = int(first[row - lo]), int(first[row - lo + 1])
            if b - a >= width:
                yield row, distinct(rolled[a : b - width + 1])
            elif b > a:
                whole = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield row, mix(whole + _STEPS[40 + b - a])
            else:
                yield row, words[:0]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set; equal sets have equal keys."""
    total = mix(mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * _STEPS[62:63])
    return int(total.view(np.int64)[0])
