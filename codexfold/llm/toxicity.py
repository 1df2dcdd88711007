"""Toxicity scores from the nearest labelled examples.

Words are runs of letters, lower-cased. The vocabulary is that of all labelled rows
used. A text is its TF-IDF vector, (1 + log tf) * idf, idf from all texts, every word
weighed by how far its presence depends on the label among the labelled rows:
(chi2 + 0.01) / (chi2 + 40), which drops no word; length 1. The examples with the largest cosine
are found exactly with an inverted index in blocks of examples: each word knows its
largest weight per block, so the product of a text with these maxima bounds the cosines
of a block. The block with the largest bound is scored first; then every block whose
bound reaches the k-th best cosine found there. Texts are searched in batches, so that
a block is scored for all texts that need it at once: common words as a dense product,
all others by their postings. Near examples vote with 1 / (distance + 0.05); a monotone
table, fitted on leave-one-out votes of the examples, turns votes into shares of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import is_held_out, releasing

WORD = re.compile(r"[^\W\d_]+")
BLOCK, BATCH = 1024, 256  # examples of a block, texts searched at once
POSTINGS = 1 << 18  # postings worked off at once; alike examples share a block, so a word may be in all of it
DENSE = 0.1  # share of the examples that makes a word common
HALFWAY, LEAST = 40.0, 0.01  # chi-square at which a word counts half, and what every word has


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of every labelled text, and how often each occurs."""
    for batch in batches:
        counts = [Counter(words_of(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), batch.column("place"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
            ["doc_id", "label", "place", "words", "times"],
        )


def _document_counts(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts per word of the vocabulary; the last entry counts all texts."""
    column = {w: i for i, w in enumerate(vocabulary)}
    n = np.zeros(len(column) + 1, np.int64)
    for batch in batches:
        n[-1] += batch.num_rows
        for text in batch.column("text"):
            found = [column[w] for w in set(words_of(text.as_py())) if w in column]
            n[found] += 1
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])


class Index:
    """Labelled examples as blocks of unit vectors, with block maxima per word.

    Example i has the words ``cols[ptr[i]:ptr[i + 1]]`` (numbers of ``words``), each ``times`` often.
    """

    def __init__(self, words: list[str], weight: np.ndarray, ptr: np.ndarray, cols: np.ndarray, times: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int):
        self.k, self.words, self.weight, self.column = k, words, weight, {}
        raw = (1 + np.log(times)) * weight[cols]
        owner = np.repeat(np.arange(len(ids)), np.diff(ptr))
        size = np.sqrt(np.bincount(owner, weights=raw * raw, minlength=len(ids)))
        full = size > 0
        unit = raw / np.where(full, size, 1)[owner]
        heaviest = np.zeros(len(ids), np.int64)
        order = np.lexsort((-cols, unit))  # the last entry of an example is its heaviest word
        heaviest[owner[order]] = cols[order]
        # alike examples share blocks, so that block maxima are close to the members' weights
        kept = np.lexsort((np.arange(len(ids)), heaviest))
        kept = kept[full[kept]]
        self.ids, self.labels = ids[kept], labels[kept]
        at = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in kept.tolist()]) if len(kept) else np.zeros(0, np.int64)
        self.ptr, self.cols, self.units = np.r_[0, np.cumsum(np.diff(ptr)[kept])], cols[at].astype(np.int32), unit[at]
        self.prior = (labels[~full].sum() + 0.5) / ((~full).sum() + 1)
        self.steps: tuple = (np.array([0.0]), np.array([0.0]))
        self.n_blocks = -(-len(kept) // BLOCK)
        self.place: np.ndarray | None = None

    def _build(self) -> None:
        """The lists and maxima, made where the index is used: it travels as the examples alone."""
        n, m = len(self.ids), len(self.words)
        cols, values, rows = self.cols, self.units, np.repeat(np.arange(n), np.diff(self.ptr))
        self.most = np.zeros((m, self.n_blocks), np.float32)
        np.maximum.at(self.most, (cols, rows // BLOCK), np.nextafter(values.astype(np.float32), np.float32(2)))
        common = np.flatnonzero(np.bincount(cols, minlength=m) > max(DENSE * n, 8))
        self.place = np.full(m, -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((self.n_blocks, len(common), BLOCK))
        often = self.place[cols] >= 0
        self.dense[rows[often] // BLOCK, self.place[cols[often]], rows[often] % BLOCK] = values[often]
        cols, rows, values = cols[~often], rows[~often], values[~often]
        order = np.lexsort((rows, cols, rows // BLOCK))
        cols, rows, values = cols[order], rows[order], values[order]
        self.slots, self.values = (rows % BLOCK).astype(np.int32), values
        keys = rows // BLOCK * m + cols.astype(np.int64)
        self.starts = np.r_[0, np.cumsum(np.bincount(keys, minlength=self.n_blocks * m))].astype(np.int32)

    def __getstate__(self) -> dict:
        names = ("k", "weight", "ids", "labels", "ptr", "cols", "units", "prior", "steps", "n_blocks")
        return {n: getattr(self, n) for n in names} | {"words": "\n".join(self.words)}  # words are letters

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"words": state["words"].split("\n") if state["words"] else [], "column": {}, "place": None})

    def forget(self) -> None:
        """Drops what can be made again, at the end of a task: a worker outlives it."""
        self.place, self.column = None, {}
        self.dense = self.most = self.starts = self.slots = self.values = None

    def example(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of an example."""
        return self.cols[self.ptr[row] : self.ptr[row + 1]], self.units[self.ptr[row] : self.ptr[row + 1]]

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of a unit vector."""
        if not self.column:
            self.column = {w: i for i, w in enumerate(self.words)}
        found = sorted((self.column[w], n) for w, n in counts.items() if w in self.column)
        at = np.array([c for c, _ in found], np.int64)
        if not len(at):
            return at, np.zeros(0)
        raw = (1 + np.log([n for _, n in found])) * self.weight[at]
        size = np.sqrt((raw * raw).sum())
        return (at, raw / size) if size > 0 else (at[:0], np.zeros(0))

    def _score(self, block: int, of: np.ndarray, ptr: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of the texts ``of`` with the examples of a block."""
        sizes = np.diff(ptr)[of]
        at = np.repeat(ptr[of] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owner, c, w = np.repeat(np.arange(len(of)), sizes), cols[at], weights[at]
        place = self.place[c]
        often = place >= 0
        texts = np.zeros((len(of), self.dense.shape[1]))
        texts[owner[often], place[often]] = w[often]
        out = texts @ self.dense[block]
        owner, c, w = owner[~often], c[~often], w[~often]
        first = block * len(self.words) + c
        lo, hi = self.starts[first].astype(np.int64), self.starts[first + 1].astype(np.int64)
        n = hi - lo
        sums, upto = np.zeros(out.size), np.r_[0, np.cumsum(n)]
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + POSTINGS, "right")) - 1)
            part = n[a:b]
            post = np.repeat(lo[a:b] - upto[a:b], part) + np.arange(upto[a], upto[b])
            # in order, so that the sums do not depend on where they are cut
            np.add.at(sums, np.repeat(owner[a:b] * BLOCK, part) + self.slots[post], np.repeat(w[a:b], part) * self.values[post])
            a = b
        out += sums.reshape(out.shape)
        return out

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines of the k nearest examples of each text with a cosine above 0; ties by
        row. ``without`` names an example that each text is not compared with."""
        n = len(queries)
        if not self.n_blocks or not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        if self.place is None:
            self._build()
        sizes = np.array([len(q[0]) for q in queries])
        ptr = np.r_[0, np.cumsum(sizes)]
        cols, weights = np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries])
        bounds = np.zeros((n, self.n_blocks))
        some = np.flatnonzero(sizes)
        if len(some):
            bounds[some] = np.add.reduceat(self.most[cols] * weights[:, None], ptr[:-1][some], axis=0)
        found = np.zeros((n, self.n_blocks, BLOCK))

        def score(block: int, of: np.ndarray) -> None:
            cosines = self._score(block, of, ptr, cols, weights).round(12)
            if without is not None:
                own = np.flatnonzero(without[of] // BLOCK == block)
                cosines[own, without[of[own]] % BLOCK] = 0
            found[of, block] = cosines

        best = np.argmax(bounds, axis=1)
        for block in np.unique(best).tolist():
            score(block, np.flatnonzero(best == block))
        limit = np.partition(found[np.arange(n), best], BLOCK - self.k, axis=1)[:, BLOCK - self.k] if self.k < BLOCK else np.zeros(n)
        for block in range(self.n_blocks):
            of = np.flatnonzero((bounds[:, block] >= limit - 1e-6) & (bounds[:, block] > 0) & (best != block))
            if len(of):
                score(block, of)
        flat = found.reshape(n, -1)
        if self.k < flat.shape[1]:
            limit = np.partition(flat, flat.shape[1] - self.k, axis=1)[:, flat.shape[1] - self.k]
        else:
            limit = np.zeros(n)
        of, rows = np.nonzero((flat >= limit[:, None]) & (flat > 0))
        cosines = flat[of, rows]
        order = np.lexsort((rows, -cosines, of))
        of, rows, cosines = of[order], rows[order], cosines[order]
        cuts = np.searchsorted(of, np.arange(n + 1))
        return [(rows[a : min(b, a + self.k)], np.minimum(cosines[a : min(b, a + self.k)], 1.0)) for a, b in zip(cuts, cuts[1:])]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the votes; examples missing to k vote at distance 1, as all do on average."""
        votes, rest = 1 / (1.05 - cosines), (self.k - len(rows)) / 1.05
        return float(((votes * self.labels[rows]).sum() + rest * self.labels.mean()) / (votes.sum() + rest))

    def left_out(self, rows: np.ndarray) -> np.ndarray:
        """Votes of all other examples on some."""
        return np.array([self.vote(*f) for f in self.nearest([self.example(r) for r in rows.tolist()], rows)])

    def calibrate(self, votes: list[tuple[int, float]]) -> None:
        """A rising curve through the pools of adjacent violators among leave-one-out votes (row,
        vote), half a count of each label added."""
        pairs = sorted((vote, int(self.labels[row])) for row, vote in votes)
        pools: list = []  # sum of votes, texts of label 1, texts
        for vote, label in pairs:
            pools.append([vote, label, 1])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        if pools:
            self.steps = (np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools]))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Share of label 1, and the ids and cosines of the three nearest examples, per text."""
        out = []
        for rows, cosines in self.nearest([self.vector(Counter(words_of(t))) for t in texts]):
            if not len(rows):
                out.append((self.prior, [], []))
                continue
            share = round(float(np.interp(self.vote(rows, cosines), *self.steps)), 9)
            out.append((share, self.ids[rows[:3]].tolist(), cosines[:3].round(6).tolist()))
        return out


def _batches(texts: list) -> Iterator[list]:
    for lo in range(0, len(texts), BATCH):
        yield texts[lo : lo + BATCH]


def _scores(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    try:
        for frame in batches:
            found = [f for part in _batches(frame["text"].tolist()) for f in index.score(part)]
            out = frame.drop(columns="text")
            out["score"] = [f[0] for f in found]
            out["evidence_ids"], out["evidence_cosines"] = [f[1] for f in found], [f[2] for f in found]
            yield out
    finally:
        index.forget()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, k: int = 15) -> Index:
    """An index fitted and calibrated on labelled rows of ``docs`` outside the held-out fifth.

    At most ``max_rows`` labelled rows are used, those with the smallest id hash, so
    that their share of label 1 is that of all; their words and counts pass the driver.
    Document frequencies come from all of ``docs``. A doc_id with several labels counts
    as toxic if one of them is 1.
    """
    spark = docs.sparkSession
    clean = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    clean = clean.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = F.broadcast(clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # max_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    shape = "doc_id long, label int, place long, words array<string>, times array<int>"
    told = rows.select("doc_id", "label", F.xxhash64("text").alias("place"), "text").mapInArrow(lambda it: releasing(_vectors(it)), shape).toArrow()
    told = told.sort_by([("doc_id", "ascending"), ("place", "ascending")]).combine_chunks()
    ids, labels = (np.asarray(told.column(c)).astype(np.int64) for c in ("doc_id", "label"))
    lists = told.column("words").combine_chunks() if len(told) else pa.array([], pa.list_(pa.string()))
    total, ones = len(ids), int(labels.sum())
    ptr = np.r_[0, np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))]
    given_words = lists.flatten().dictionary_encode()
    order = np.argsort(np.asarray(given_words.dictionary.to_pylist(), dtype=object), kind="stable")
    vocabulary = [w.as_py() for w in given_words.dictionary.take(pa.array(order))]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cols = rank[np.asarray(given_words.indices)] if len(order) else np.zeros(0, np.int64)
    times = np.concatenate([np.asarray(c.flatten()) for c in told.column("times").chunks] or [np.zeros(0)]).astype(np.int64)
    if not ones or ones == total:
        index = Index([], np.zeros(0), np.zeros(total + 1, np.int64), cols[:0], times[:0], ids, labels, k)
        index.prior = (ones + 0.5) / (total + 1)
        return index
    given = spark.sparkContext.broadcast(vocabulary)  # the words of max_rows texts
    seen = docs.select("text").mapInArrow(lambda it: releasing(_document_counts(it, given.value)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    given.destroy()
    texts = np.zeros(len(vocabulary) + 1, np.int64)
    texts[np.asarray(seen.column("word"))] = np.asarray(seen.column("n"))
    idf = np.log((1 + texts[-1]) / (1 + texts[:-1])) + 1
    both = np.bincount(cols, minlength=len(vocabulary)).astype(float)
    a = np.bincount(cols, weights=np.repeat(labels, np.diff(ptr)), minlength=len(vocabulary))
    b, c, d = both - a, ones - a, total - ones - both + a
    # corrected for continuity, so that a word of one or two texts tells little by chance
    chi2 = total * np.maximum(np.abs(a * d - b * c) - total / 2, 0) ** 2 / (ones * (total - ones) * both * np.maximum(total - both, 1))
    index = Index(vocabulary, idf * (chi2 + LEAST) / (chi2 + HALFWAY), ptr, cols, times, ids, labels, k)
    if index.n_blocks:
        shared = spark.sparkContext.broadcast(index)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for batch in batches:
                    rows = np.asarray(batch.column("id"))
                    for lo in range(0, len(rows), BATCH):
                        part = rows[lo : lo + BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(shared.value.left_out(part))], ["row", "vote"])
            finally:
                shared.value.forget()

        size = len(index.ids)
        found = spark.range(0, size, 1, max(1, size // 1_000)).mapInArrow(lambda it: releasing(votes(it)), "row long, vote double").collect()
        shared.destroy()
        index.calibrate([(r.row, r.vote) for r in found])
    return index


def _index(docs: DataFrame, labels: DataFrame, **settings):
    index = train(docs.select(F.col("doc_id").cast("long"), "text"), labels.select(F.col("doc_id").cast("long"), "toxic"), **settings)
    return docs.sparkSession.sparkContext.broadcast(index)


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence_ids, evidence_cosines) of every row of ``docs``.

    The score reads the text alone. Null and empty texts, and texts without a word
    of the examples, get the share of label 1 among such examples; so does every
    text where no labels are given. A null id is not held out. Rows may repeat;
    other columns are ignored; an empty table gives an empty result.
    """
    shared = _index(docs, labels, **settings)
    shape = "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>"
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lambda it: releasing(_scores(it, shared.value)), shape)
    return scored.select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines",
    )


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5; all columns and row multiplicities stay."""
    shared = _index(docs, labels, **settings)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([f[0] for part in _batches(texts.tolist()) for f in shared.value.score(part)], dtype="float64")
        finally:
            shared.value.forget()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from releasing(scores(batches))

    return docs.where(score(F.col("text")) < 0.5)
