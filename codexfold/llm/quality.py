"""Quality scores by ridge regression on random Fourier features, calibrated by isotony.

Every text becomes a vector of statistics: shares of character classes, lengths of words
and lines, repetition of words, word runs and lines, entropy. Means and deviations over
all documents standardise them. Cosines of random projections approximate a Gaussian
kernel between such vectors. Partitions of labelled rows add up their part of the normal
equations, per fold; the sums are added in a tree, and the driver solves one system of
fixed size for each fold and penalty. The penalty with the least error outside the folds
is kept. Scores outside the folds are counted in narrow bins, and adjacent violators are
pooled over these bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import text_chunks, written
from codexfold.llm.kernels import mix, word_hashes
from codexfold.llm.source_divergence import spans

FOLDS, BINS, FAN_IN = 4, 2_048, 16
FIT_ROWS = 65_536  # labelled rows to a partial sum
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
CHUNK, SLICE = 500_000, 4_000_000  # bytes of text worked on at once
RUN = 5  # words
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _table(signs: bytes) -> np.ndarray:
    marked = np.zeros(256)
    marked[list(signs)] = 1
    return marked


_SPACE = _table(b" \t\n\v\f\r").astype(bool)
CHARACTERS = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digit": _table(b"0123456789"),
    "space": _table(b" \t\v\f\r"),
    "line_break": _table(b"\n"),
    "stop": _table(b".!?"),
    "comma": _table(b",;:"),
    "quote": _table(b"'\"()-"),
    "symbol": _table(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "shout": _table(b"!"),
    "bar": _table(b"|"),
    "control": _table(bytes([*range(9), *range(14, 32), 127])),
    "other": _table(bytes(range(128, 256))),
}
OTHERS = (
    "size", "words", "lines", "word_length", "word_spread", "long_words", "short_words", "entropy", "upper_letters", "marked_words",
    "different_words", "commonest_word", "repeated_runs", "line_length", "repeated_lines", "ended_lines", "short_lines", "lone_words",
)
STATISTICS = (*CHARACTERS, *OTHERS)


def _histograms(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text holds each byte."""
    n = len(offsets) - 1
    counts = np.zeros(n * 256, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(offsets)) if len(body) <= SLICE else None
    for lo in range(0, len(body), SLICE):
        part = body[lo : lo + SLICE]
        at = owner[lo : lo + SLICE] if owner is not None else 256 * (np.searchsorted(offsets, np.arange(lo, lo + len(part)), "right") - 1)
        counts += np.bincount(at + part, minlength=n * 256)
    return counts.reshape(n, 256)


def _per_text(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _different(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text its different hashes, and the count of the commonest."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    if not len(o):
        return np.zeros(n), np.zeros(n)
    starts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    most = np.zeros(n)
    np.maximum.at(most, o[starts], np.diff(np.r_[starts, len(o)]))
    return np.bincount(o[starts], minlength=n).astype(float), most


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for every text of a chunk; all 0 for an empty one."""
    n = len(offsets) - 1
    counts = _histograms(body, offsets)
    size = counts.sum(axis=1)
    share = counts / np.maximum(size, 1)[:, None]
    out = {name: share @ marked for name, marked in CHARACTERS.items()}
    starts, stops, owner = spans(~_SPACE[body], offsets)
    hashes, _ = word_hashes(body, offsets)
    lengths = (stops - starts).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = _per_text(owner, lengths, n) / some
    letters = share @ (CHARACTERS["upper"] + CHARACTERS["lower"])
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    last = body[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    signs = CHARACTERS["symbol"] + CHARACTERS["shout"]
    different, most = _different(owner, hashes, n)
    out |= {
        "size": np.log1p(size), "words": np.log1p(words), "entropy": entropy,
        "word_length": np.log1p(mean), "word_spread": np.sqrt(np.maximum(_per_text(owner, lengths**2, n) / some - mean**2, 0)).clip(0, 100),
        "long_words": _per_text(owner, lengths > 20, n) / some, "short_words": _per_text(owner, lengths < 3, n) / some,
        "upper_letters": (share @ CHARACTERS["upper"]) / np.maximum(letters, 1e-9), "marked_words": _per_text(owner, signs[last], n) / some,
        "different_words": different / np.sqrt(some), "commonest_word": most / some,
    }
    m = max(len(hashes) - RUN + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for k in range(RUN if m else 0):
        rolled = mix(rolled * _STEP + hashes[k : k + m])
    within = owner[:m] == owner[RUN - 1 :] if m else np.zeros(0, bool)
    runs = np.bincount(owner[:m][within], minlength=n)
    out["repeated_runs"] = 1 - _different(owner[:m][within], rolled[within], n)[0] / np.maximum(runs, 1)
    out["repeated_runs"][runs == 0] = 0

    breaks = np.cumsum(body == 10)  # lines are those with a word
    line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]) if len(line) else np.zeros(0, np.int64)
    held = np.diff(np.r_[first, len(line)])
    within = np.arange(len(line)) - np.repeat(first, held)
    named = np.add.reduceat(mix(hashes ^ mix(within.astype(np.uint64))), first) if len(first) else hashes
    of = owner[first]
    lines = np.bincount(of, minlength=n).astype(float)
    some_lines = np.maximum(lines, 1)
    ends = np.isin(last[first + held - 1], np.frombuffer(b".!?\"'", np.uint8)) if len(first) else np.zeros(0, bool)
    out |= {
        "lines": np.log1p(lines), "line_length": np.log1p(words / some_lines), "repeated_lines": 1 - _different(of, named, n)[0] / some_lines,
        "ended_lines": _per_text(of, ends, n) / some_lines, "short_lines": _per_text(of, held < 4, n) / some_lines, "lone_words": _per_text(of, held == 1, n) / some_lines,
    }
    out["repeated_lines"][lines == 0] = 0
    return np.column_stack([out[name] for name in STATISTICS])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, body, offsets in text_chunks(batch.column("text"), CHUNK):
            rows = statistics(body, offsets)
            values = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("fold")[lo:hi], values], ["doc_id", "fold", "x"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, x) of every row; the fold depends on the id, so that copies of a text spread."""
    rows = docs.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    return rows.mapInArrow(_statistics, "doc_id long, fold int, x array<double>")


class Features:
    """Standardised statistics as cosines of random projections, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(size=(len(mean), n)) / width
        self.phase = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.deviation).clip(-6, 6)
        # rounded to a grid, so that sums of products come out alike in any order
        return np.column_stack([np.round(np.cos(z @ self.turn + self.phase) * 65_536) / 65_536, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _sums(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    """One row a fold with the sums of all products of features and label."""
    width = len(features.phase) + 2
    total = np.zeros((FOLDS, width, width))
    for batch in batches:
        fold = np.asarray(batch.column("fold"))
        rows = np.column_stack([features(_matrix(batch.column("x"))), np.asarray(batch.column("label"), dtype=float)])
        for k in range(FOLDS):
            part = rows[fold == k]
            total[k] += part.T @ part
    yield from _as_rows(total)


def _as_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["fold", "sums"])


def _added(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FOLDS, width, width))
    for batch in batches:
        for fold, sums in zip(batch.column("fold").to_pylist(), batch.column("sums")):
            total[fold] += np.frombuffer(sums.as_buffer()).reshape(width, width)
    yield from _as_rows(total)


def normal_equations(rows: DataFrame, features: Features, n_rows: int) -> np.ndarray:
    """Sums per fold over the labelled ``rows`` (fold, x, label), added in a tree of ``FAN_IN``."""
    width, shape = len(features.phase) + 2, "fold int, sums binary"
    parts = max(1, -(-n_rows // FIT_ROWS))
    sums = rows.coalesce(parts).mapInArrow(lambda it: _sums(it, features), shape)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(lambda it: _added(it, width), shape)
    total = np.zeros((FOLDS, width, width))
    for r in sums.toLocalIterator():
        total[r.fold] += np.frombuffer(r.sums).reshape(width, width)
    return total


def _solved(sums: np.ndarray, penalty: float) -> np.ndarray:
    left = sums[:-1, :-1].copy()
    at = np.arange(len(left) - 1)
    left[at, at] += penalty
    left[-1, -1] += 1e-9  # the constant is free
    return np.linalg.solve(left, sums[:-1, -1])


def ridge(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted without each fold, and on all, at the penalty with the least error outside."""

    def error(w: np.ndarray, sums: np.ndarray) -> float:
        return float(sums[-1, -1] - 2 * w @ sums[:-1, -1] + w @ sums[:-1, :-1] @ w)

    whole = total.sum(axis=0)
    tried = []
    for penalty in PENALTIES:
        without = np.array([_solved(whole - part, penalty) for part in total])
        tried.append((sum(error(w, part) for w, part in zip(without, total)), penalty, without))
    _, penalty, without = min(tried, key=lambda t: t[:2])
    return without, _solved(whole, penalty)


def _binned(batches: Iterator[pa.RecordBatch], features: Features, without: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bin, n, ones) of the scores outside the folds, from -0.5 to 1.5."""
    n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        z = features(_matrix(batch.column("x")))
        raw = (z * without[np.asarray(batch.column("fold"))]).sum(axis=1)
        at = ((raw.clip(-0.5, 1.4999) + 0.5) * (BINS / 2)).astype(np.int64)
        n += np.bincount(at, minlength=BINS)
        ones += np.bincount(at, weights=np.asarray(batch.column("label")), minlength=BINS).astype(np.int64)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(ones[some])], ["bin", "n", "ones"])


def isotonic(bins: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve through the pools of (bin, n, ones), half a count of each label added."""
    pools: list[list] = []
    for at, n, ones in sorted(bins):
        pools.append([at * n, n, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([(p[0] / p[1] + 0.5) * 2 / BINS - 0.5 for p in pools])
    return at, np.maximum.accumulate(np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools]))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, n_features: int = 256, width: float = 5.0, seed: int = 13) -> DataFrame:
    """(doc_id, held_out, score, predicted, x) of every row of ``docs``; ``x`` holds ``STATISTICS``.

    The model reads labels (doc_id, quality) outside the held-out third; a document with
    several counts as good if one is 1. The score reads the text alone, whole. Null
    and empty texts have statistics of 0. Without labels all texts score 0.5, with few
    the penalty makes scores alike. A null id has no label and is not held out. Rows may
    repeat; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stats = written(text_statistics(docs.select("doc_id", "text")))
    at = range(len(STATISTICS))
    x = [F.col("x")[k] for k in at]
    moments = stats.agg(*(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    moments = np.array([m or 0.0 for m in moments]).round(9)
    features = Features(moments[: len(at)], moments[len(at) :], n_features, width, seed)
    clean = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "quality")
    clean = clean.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    labelled = written(stats.join(clean, "doc_id").select("fold", "x", "label"))
    n_rows = labelled.count()
    if n_rows:
        without, weights = ridge(normal_equations(labelled, features, n_rows))
        bins = labelled.mapInArrow(lambda it: _binned(it, features, without), "bin long, n long, ones long")
        bins = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()  # BINS rows at most
        knots = isotonic([(r.bin, r.n, r.ones) for r in bins])
    else:
        weights, knots = np.zeros(n_features + 1), (np.zeros(1), np.full(1, 0.5))
    model = spark.sparkContext.broadcast((features, weights, knots))  # n_features columns, BINS knots

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, knots = model.value
        for batch in batches:
            score = np.interp(features(_matrix(batch.column("x"))) @ weights, *knots).clip(0, 1).round(9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), batch.column("x")], ["doc_id", "score", "x"])

    rows = stats.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double, x array<double>")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "x")
