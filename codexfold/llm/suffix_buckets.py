"""Removal of long repeated byte strings by bucket-pointer refinement.

A suffix array of all bytes of a corpus would be many times the corpus, and only
suffixes that agree for ``length`` bytes matter. So the initial q-gram buckets
hold anchors alone: of every window of ``length`` bytes, the position of its
q-gram with the smallest hash. Equal windows have equal anchors, and about one
position in 85 is one. Buckets with one anchor are dropped; what remains is every
window that may be repeated, with its anchor's bucket.

The windows of a bucket are then refined as in bucket-pointer refinement: two
positions are in the same bucket for 2h bytes if their buckets for h bytes and the
buckets of the positions h bytes later are the same. Each step sorts by that pair
of bucket identifiers, and the identifiers it gives are what the next step reads;
from 50-byte buckets two steps reach 200. Positions that are alone leave.

Large buckets are split at random into parts that are refined apart; windows that
stay alone in their part are compared by a hash of their bytes with those of the other
parts, of which each names every different one once. A window counts as repeated wherever it starts twice, in one document or two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import sorted_groups, text_chunks, written
from codexfold.llm.kernels import mix, powers

GRAM = 32
SEGMENT = 4 << 20
PLACE_BITS = 23  # places in a segment and its overlap
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(31337).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(body: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes from every position that has as many."""
    if len(body) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTES[body] * powers(_BASE, len(body)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_BASE_INVERSE, len(body))[: len(body) - n + 1])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of every window of ``width``: suffix minima of one block with
    prefix minima of the next."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def anchors(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, bucket) of the texts of a chunk, by absolute position.

    Ties go to the leftmost q-gram. Windows that cross a text's end are left out.
    """
    size, width = len(body), length - GRAM + 1
    if size < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(body, GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width)
    where = (least & low).astype(np.int64)
    lengths = np.diff(offsets)
    inside = np.zeros(size + 1, np.int64)
    whole = lengths >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[whole], -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(where)]) > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = where[starts]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:], len(starts)] - 1
    return at[first], starts[first], starts[last], hashes[at[first]]


def segments(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, shift) of chunks of texts, and of overlapping segments of long ones."""
    for lo, _, body, offsets in text_chunks(texts):
        if len(body) <= SEGMENT:
            yield lo, body, offsets, 0
            continue
        for at in range(0, max(len(body) - length + 1, 1), SEGMENT):
            part = body[at : at + SEGMENT + length - 1]
            yield lo, part, np.array([0, len(part)]), at


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(bucket, doc, first, last, at) of every anchor, windows by their place in the text."""
    for batch in batches:
        docs = np.asarray(batch.column("doc"))
        for lo, body, offsets, shift in segments(batch.column("text"), length):
            at, first, last, bucket = anchors(body, offsets, length)
            if len(at):
                row = np.searchsorted(offsets, first, "right") - 1
                base = offsets[row] - shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(docs[lo + row]), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array((at - base).astype(np.int32))],
                    ["bucket", "doc", "first", "last", "at"],
                )


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(bucket, part, doc, first, back, bytes): the bytes of each anchor's windows."""
    for batch in batches:
        names = ["bucket", "part", "doc", "first", "back", "bytes"]
        out: list[list] = [[] for _ in names]
        held = 0
        texts, docs, found = batch.column("text"), batch.column("doc").to_pylist(), batch.column("found").to_pylist()
        for row, doc in enumerate(docs):
            body = texts[row].as_buffer()
            view = memoryview(body)
            for a in found[row]:
                part = bytes(view[a["first"] : a["last"] + length])
                for column, value in zip(out, (a["bucket"], a["part"], doc, a["first"], a["at"] - a["first"], part)):
                    column.append(value)
                held += len(part)
            if held > 8 << 20:
                yield _context_batch(out, names)
                out, held = [[] for _ in names], 0
        if out[0]:
            yield _context_batch(out, names)


def _context_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def refined(body: np.ndarray, usable: np.ndarray, start: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether the ``length`` bytes from each position of ``start`` begin at another one too.

    ``usable[i]`` bytes may be read from position i; ``gram`` bytes make the initial
    buckets, and ``length`` is ``gram`` times a power of two. A position's identifier is
    -1 once its bucket holds no other.
    """
    wanted = {length: np.zeros(len(body), bool)}
    wanted[length][start] = True
    h = length
    while h > gram:  # positions whose buckets the later steps read
        h //= 2
        wanted[h] = wanted[2 * h].copy()
        wanted[h][h:] |= wanted[2 * h][:-h]
    known = np.flatnonzero(wanted[h] & (usable >= h))
    values = gram_hashes(body, h)[known]
    while True:
        names, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
        identifier = np.full(len(body), -1, np.int64)
        identifier[known] = np.where(times[inverse] > 1, inverse, -1)
        if h == length:
            return identifier[start] >= 0
        known = np.flatnonzero(wanted[2 * h] & (usable >= 2 * h))
        known = known[(identifier[known] >= 0) & (identifier[known + h] >= 0)]
        values = identifier[known].astype(np.uint64) << np.uint64(32) | identifier[known + h].astype(np.uint64)
        h *= 2


def _repeated(batches: Iterator[pa.RecordBatch], length: int, gram: int, solve_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc, start, stop, window): runs of bytes covered by repeated windows, with a null window;
    for parts of a split bucket, a row with the hash of each different window, whose doc is
    null where the window is repeated here and so covered already.
    """
    types = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.int64())])

    def solved(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(groups).combine_chunks()
        (_, __, body, offsets), = list(text_chunks(table.column("bytes"), 1 << 62))
        n = np.diff(offsets)
        counts = n - length + 1
        rows = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[rows] + inner
        usable = np.repeat(offsets[1:], n) - np.arange(len(body))
        same = refined(body, usable, start, length, gram)
        doc, shift = np.asarray(table.column("doc")), np.asarray(table.column("first")).astype(np.int64)
        at = shift[rows] + inner
        hit = np.flatnonzero(same)
        if len(hit):
            new = np.r_[True, (rows[hit][1:] != rows[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)]
            lo, hi = hit[new], hit[np.r_[np.flatnonzero(new)[1:], len(hit)] - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[rows[lo]]), pa.array(at[lo].astype(np.int32)), pa.array((at[hi] + length).astype(np.int32)), pa.nulls(len(lo), pa.int64())], schema=types
            )
        split = np.flatnonzero(np.asarray(table.column("part"))[rows] >= 0)
        if len(split):
            window, one = np.unique(gram_hashes(body, length)[start[split]], return_index=True)
            one = split[one]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[rows[one]], mask=same[one]), pa.array(at[one].astype(np.int32)), pa.array((at[one] + length).astype(np.int32)), pa.array(window.view(np.int64))], schema=types
            )

    held, size = [], 0
    for group in sorted_groups(batches, ["bucket", "part"]):
        held.append(group)
        size += group.nbytes
        if size > solve_bytes:
            yield from solved(held)
            held, size = [], 0
    if held:
        yield from solved(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest of what is left of every text after its runs are cut out."""
    for batch in batches:
        out: list = []
        texts, found = batch.column("text"), batch.column("found").to_pylist()
        for row, runs in enumerate(found):
            body = texts[row].as_py() or b""
            digest, removed, spans, at = hashlib.sha256(), 0, 0, 0
            for run in runs or ():
                if run["start"] > at or not spans:
                    digest.update(body[at : run["start"]])
                    spans += 1
                    removed += run["stop"] - run["start"]
                else:
                    removed += max(0, run["stop"] - at)
                at = max(at, run["stop"])
            digest.update(body[at:])
            out.append((len(body), removed, spans, digest.hexdigest()))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, length: int = 200, halvings: int = 2, hot_bucket: int = 2_000, solve_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text).

    Removed is every byte of the UTF-8 text that a string of ``length`` bytes covers
    which also starts elsewhere, in any row; all places lose it, the first too. A
    null text is empty; texts shorter than ``length`` lose nothing. Equal texts are
    searched once and, if long enough, are gone entirely: repeated rows and ids do
    not matter, ids may be null. An empty table gives an empty result; other columns
    are ignored. Texts and strings are compared by 64-bit hashes within buckets.
    ``length`` must be ``2 ** halvings`` times the size of the initial buckets and
    longer than an anchor. ``hot_bucket`` anchors are refined together at most, and
    groups of about ``solve_bytes``; neither changes the result.
    """
    if length % (1 << halvings) or length < GRAM:
        raise ValueError("length does not fit the anchors or the refinement")
    gram = length >> halvings
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long"), body.alias("text")).withColumn("doc", F.xxhash64("text"))
    copies = docs.groupBy("doc", F.octet_length("text").alias("n")).agg(F.count("*").alias("times"))
    copies = written(copies.where((F.col("times") > 1) & (F.col("n") >= length)).select("doc", F.lit(True).alias("copied")))
    flagged = docs.join(copies, "doc", "left")
    once = flagged.where("copied is null").select("doc", "text")
    texts = once.unionByName(flagged.where("copied").groupBy("doc").agg(F.first("text").alias("text")))

    shape = "bucket long, doc long, first int, last int, at int"
    rows = written(texts.mapInArrow(lambda it: _anchor_rows(it, length), shape))
    alive = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    part = F.when(F.col("n") > hot_bucket, F.pmod(F.xxhash64("doc", "at"), F.ceil(F.col("n") / hot_bucket)).cast("int")).otherwise(-1)
    lists = rows.join(alive, "bucket").groupBy("doc").agg(F.collect_list(F.struct("bucket", part.alias("part"), "first", "last", "at")).alias("found"))
    windows = (
        texts.join(lists, "doc").select("doc", "text", "found")
        .mapInArrow(lambda it: _contexts(it, length), "bucket long, part int, doc long, first int, back int, bytes binary")
        .repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    )
    runs = written(windows.mapInArrow(lambda it: _repeated(it, length, gram, solve_bytes), "doc long, start int, stop int, window long"))
    single = runs.where("window is not null")
    twice = written(single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))
    covered = runs.where("window is null").unionByName(single.where("doc is not null").join(twice, "window").select(runs.columns))
    per_doc = covered.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    everything = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("stop")))
    cut = flagged.join(per_doc, "doc", "left").select("doc_id", "text", F.when(F.col("copied"), everything).otherwise(F.col("runs")).alias("found"))
    return cut.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
