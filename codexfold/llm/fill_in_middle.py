"""Fill-in-the-middle transformation, with cuts found by a wavelet matrix.

Every byte of a text has a class: inside a code point, or the start of one that starts
nothing more, a word, a line, or both. A wavelet matrix over the classes answers how many
bytes of a class stand before a place; ranks of several classes add up to the number of
code points, words or lines before it. A bisection on these sums finds the byte where
a cut after any number of units lies, for all texts of a chunk at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 2_000_000
INSIDE, CHAR, WORD, LINE, LINE_WORD = range(5)
UNITS = {"char": (CHAR, WORD, LINE, LINE_WORD), "word": (WORD, LINE_WORD), "line": (LINE, LINE_WORD)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def classes(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; words are runs without white space, lines end after ``\\n``."""
    if not len(body):
        return np.zeros(0, np.uint8)
    starts = (body & 0xC0) != 0x80
    space = _SPACE[body]
    word, line = ~space, np.zeros(len(body), bool)
    word[1:] &= space[:-1]
    line[1:] = body[:-1] == 10
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    word[firsts], line[firsts] = ~space[firsts], True
    return starts * (CHAR + word.astype(np.uint8) + 2 * line.astype(np.uint8))


class WaveletMatrix:
    """Rank over small symbols: one bit vector for each bit, the highest first; every
    level holds the symbols in the order of the bits above, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.size, self.bits, self.levels = len(symbols), bits, []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.size // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.levels.append((words, before, self.size - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place ``at``."""
        ends = np.concatenate([[0], at])
        for level in range(self.bits):
            ones = self.ones(level, ends)
            ends = self.levels[level][2] + ones if symbol >> (self.bits - 1 - level) & 1 else ends - ones
        return ends[1:] - ends[0]

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def locate(self, symbols: tuple[int, ...], number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The last place in ``lo`` to ``hi`` with at most ``number`` of the symbols before it."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            middle = (lo + hi + 1) // 2
            fits = self.count(symbols, middle) <= number
            lo, hi = np.where(fits, middle, lo), np.where(fits, hi, middle - 1)
        return lo


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2^32 that depend on seed and id alone; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def _transformed(batches: Iterator[pa.RecordBatch], unit: str, seed: int, plain: int, spm: int) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, body, offsets in text_chunks(batch.column("text"), CHUNK):
            matrix = WaveletMatrix(classes(body, offsets))
            before = matrix.count(UNITS[unit], offsets)
            n = np.diff(before)
            h = np.array([draws(i, seed) for i in ids[lo:hi]], np.int64)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            starts, stops = offsets[:-1], offsets[1:]
            at = [np.where(c == 0, starts, matrix.locate(UNITS[unit], before[:-1] + c, starts, stops)) for c in cuts.T]
            whole, forms, outputs = body.tobytes(), [], []
            for row, (a, b, c, d) in enumerate(zip(starts.tolist(), at[0].tolist(), at[1].tolist(), stops.tolist())):
                text = whole[a:d]
                if a == d or h[row, 2] % 100 >= plain or any(m in text for m in marks):
                    forms.append("plain")
                    outputs.append(text)
                elif h[row, 3] % 100 < spm:
                    forms.append("spm")
                    outputs.append(b"".join([marks[1], whole[c:d], marks[0], whole[a:b], marks[2], whole[b:c]]))
                else:
                    forms.append("psm")
                    outputs.append(b"".join([marks[0], whole[a:b], marks[1], whole[c:d], marks[2], whole[b:c]]))
            kept = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array(forms), pa.array(cuts[:, 0], pa.int64(), mask=kept),
                 pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=kept), pa.array(outputs, pa.binary())],
                ["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
            )


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, transformed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row of ``docs``.

    A text of ``n`` units (``char``, ``word`` or ``line``) is cut before two units drawn
    from ``seed`` and doc_id; a cut before no unit lies at the start, one after the last
    at the end. ``psm`` is prefix, suffix, middle, each after its marker, ``spm`` suffix,
    prefix, middle. Texts that are empty or hold a marker, and the texts beyond
    ``transformed_percent``, stay ``plain`` with null units.

    A null text is empty; a null id draws as an empty one. Repeated rows give equal
    rows, an empty table none; other columns are ignored. Texts of any length are
    worked on whole.
    """
    shape = "doc_id long, n long, form string, prefix_units long, middle_units long, output binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(lambda it: _transformed(it, unit, seed, transformed_percent, spm_percent), shape)
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The parts hold no marker, and no marker starts
    inside another, so that each is found where it was set."""
    middle, head = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring(F.substring_index(head, second, 1), len(first) + 1, 2**31 - 1), F.substring_index(head, second, -1)

    prefix, suffix = parts(PREFIX, SUFFIX)
    suffix_first, prefix_last = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)
