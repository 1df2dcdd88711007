"""Removal of repeated runs of sentences.

A sentence ends after a full stop, exclamation or question mark before white space,
at a line break. One with more than ``MOST_WORDS`` words is cut before the words whose
pair with the word before has the smallest hash, and so are its parts, so that a passage
is cut alike wherever it stands. Every sentence starts one run and ends one, the shortest
with at least two sentences and ``least_words`` words. Together
they cover every sentence of any longer repeated run. Runs are hashed and compared over
the whole corpus; the first place of a repeated run keeps it, and at all others its
sentences are removed. Places are ordered by doc_id and position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import written

LEAST_SENTENCES, MOST_WORDS = 2, 40
_END = re.compile(r"""(?<![.!?…])[.!?…]++["')\]]*+\s+|\n\s*+""")
_WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, words) of the sentences of a text, white space between them included."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        n = len(text[lo:hi].split()) if hi > lo else 0
        if n > MOST_WORDS:
            found = list(_WORD.finditer(text, lo, hi))
            firsts = word_cuts([m[0] for m in found])
            starts = [lo, *(found[k].start() for k in firsts[1:])]
            out += [(a, b, j - i) for a, b, i, j in zip(starts, [*starts[1:], hi], firsts, [*firsts[1:], n])]
        elif n:
            out.append((lo, hi, n))
        elif out and hi > lo:
            out[-1] = (out[-1][0], hi, out[-1][2])
    if out:
        out[0] = (0, *out[0][1:])
    return out


def word_cuts(words: list[str]) -> list[int]:
    """The first words of the parts of an overlong sentence.

    Two sentences with a passage in common cut it at the same places, but for up to
    ``MOST_WORDS`` words at its ends: what is cut is cut at all its smallest hashes, and
    while it reaches over the passage, that is outside or at the smallest in the passage.
    """
    hashes = [0, *(xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:]))]
    firsts, waiting = [0], [(0, len(words))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo > MOST_WORDS:
            least = min(hashes[lo + 1 : hi])
            at = [k for k in range(lo + 1, hi) if hashes[k] == least]
            firsts += at
            waiting += zip([lo, *at], [*at, hi])
    return sorted(firsts)


def runs(text: str, least_words: int) -> Iterator[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the runs from and to every sentence that has one, by place."""
    parts = sentences(text)
    digests = [xxhash.xxh3_64_digest(" ".join(text[a:b].split())) for a, b, _ in parts]
    before = [0, *accumulate(n for *_, n in parts)]
    spans, first, stop = set(), 0, 0
    for k in range(len(parts)):
        while stop < len(parts) and (stop - k < LEAST_SENTENCES or before[stop] - before[k] < least_words):
            stop += 1
        if stop - k < LEAST_SENTENCES or before[stop] - before[k] < least_words:
            break
        spans.add((k, stop))
    for k in range(LEAST_SENTENCES, len(parts) + 1):
        while k - first > LEAST_SENTENCES and before[k] - before[first + 1] >= least_words:
            first += 1
        if before[k] - before[first] >= least_words:
            spans.add((first, k))
    for first, stop in sorted(spans):
        yield int.from_bytes(xxhash.xxh3_64_digest(b"".join(digests[first:stop])), "little", signed=True), first, stop - first


def _run_rows(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """(run, place, row, first, n, again) of all runs; ``again`` marks a run seen before in its text."""
    names = ["run", "place", "row", "first", "n", "again"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        places, rows = batch.column("place").to_pylist(), batch.column("row").to_pylist()
        for place, row, text in zip(places, rows, batch.column("text")):
            seen: set = set()
            for run, first, n in runs(text.as_py() or "", least_words):
                for column, value in zip(out, (run, place, row, first, n, run in seen)):
                    column.append(value)
                seen.add(run)
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the removed sentences."""
    for batch in batches:
        ids, texts, found = batch.column("doc_id"), batch.column("text"), batch.column("found").to_pylist()
        counts, kept, removed = [], [], []
        for row, spans in enumerate(found):
            text = texts[row].as_py()
            parts = sentences(text or "")
            gone = {k for s in spans or () for k in range(s["first"], s["first"] + s["n"])}
            counts.append(len(parts))
            removed.append(sorted(gone))
            kept.append("".join(text[a:b] for k, (a, b, _) in enumerate(parts) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())],
            ["doc_id", "n_sentences", "n_removed", "removed", "text"],
        )


def without_repeated_spans(docs: DataFrame, least_words: int = 15) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of every row of ``docs`` (doc_id, text).

    ``removed`` lists the numbers of the removed sentences. Null, empty and word-less
    texts and texts without a run stay as they are. Rows that share a doc_id count as
    one document, whose own repeats are judged per text; a null doc_id comes first of
    all. Repeated rows give equal results. An empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    least = F.lit(-(1 << 63)).cast("long")
    shape = "run long, place long, row long, first int, n int, again boolean"
    rows = written(docs.select(F.coalesce("doc_id", least).alias("place"), "row", "text").mapInArrow(lambda it: _run_rows(it, least_words), shape))
    firsts = rows.groupBy("run").agg(F.min("place").alias("home"), F.max("place").alias("last")).where("home < last")
    firsts = written(firsts.select("run", "home"))
    spans = rows.where("not again").join(firsts, "run").where("place > home").select("row", "first", "n")
    spans = spans.unionByName(rows.where("again").select("row", "first", "n"))
    found = spans.groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("found"))
    shape = "doc_id long, n_sentences long, n_removed long, removed array<int>, text string"
    return docs.join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(_cut, shape)
