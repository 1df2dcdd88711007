"""Audit of how the sources of a language differ, over the terms enough documents hold.

The kept terms come from an iceberg refinement of byte prefixes. A level counts, per
language, the documents that hold a prefix of its length; terms no longer than that are
counted whole. Prefixes below the threshold are discarded with all their extensions,
the rest is extended to the next level, until no prefix is left and the complete terms
remain. Survivors reach the tasks as a Bloom filter of bounded size: what it lets
through by mistake is counted exactly one level later, so its size changes no result.

A group's distribution over the kept terms of its language is smoothed by one. The
divergence of two groups adds up one rounded integer per kept term. Terms that neither
group holds all add the same, those of one group depend on its count alone; so the sum
is taken from a histogram of each group's counts, corrected over the terms both hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexfold.llm.common import text_chunks, written
from codexfold.llm.kernels import mix

SCALE = 1_000_000_000
CHUNK, PAIRS = 2_000_000, 1_000_000  # bytes of text, and pairs of sources, worked on at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of the runs of marked bytes; texts never share one."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    ends[firsts[1:] - 1] = inside[firsts[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def heads(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of every run as one number, missing bytes 0; no term has a byte 0."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    packed = np.zeros(len(starts), np.uint64)
    for k in range(8):
        packed |= np.where(lengths > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return packed


def _first(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << 64) - (1 << 8 * (8 - n)))


def _number(prefix: bytes) -> int:
    """What a prefix is known by in the filter."""
    return int.from_bytes(prefix.ljust(8, b"\0"), "big") if len(prefix) <= 8 else xxhash.xxh3_64_intdigest(prefix)


def _language(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode())


def _places(numbers: np.ndarray, languages: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(mix(numbers) ^ languages)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _passes(bloom: np.ndarray, numbers: np.ndarray, languages: np.ndarray) -> np.ndarray:
    found = np.ones(len(numbers), bool)
    for at in _places(numbers, languages, len(bloom) * 64):
        found &= ((bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def _tally(group: np.ndarray, key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, key, texts, times) of the different pairs of group and key."""
    keys, ids = np.unique(key, return_inverse=True)
    n_keys, n_texts = max(len(keys), 1), int(text.max()) + 1 if len(text) else 1
    pair = group * n_keys + ids
    both, times = np.unique(pair, return_counts=True)
    once = np.unique(pair * n_texts + text) // n_texts
    return both // n_keys, keys[both % n_keys], np.unique(once, return_counts=True)[1], times


def _counted_short(body, starts, lengths, packed, text, lang, group, high):
    """Rows of the words of at most eight bytes, whole or by their prefix; keys are exact."""
    out = []
    for complete, at in ((True, lengths <= high), (False, lengths > high)):
        owner = (group if complete else lang)[text[at]]
        owner, key, texts, times = _tally(owner, packed[at] if complete else _first(packed[at], high), text[at])
        out.append((complete, owner, key.astype(">u8").view("S8").tolist(), texts, times))
    return out


def _counted_long(body, starts, lengths, packed, text, lang, group, high):
    """The same for longer words, by their bytes."""
    counts: tuple[dict, dict] = ({}, {})
    for a, n, t in zip(starts.tolist(), lengths.tolist(), text.tolist()):
        complete = n <= high
        name = (int((group if complete else lang)[t]), body[a : a + min(n, high)].tobytes())
        entry = counts[complete].setdefault(name, [0, 0, -1])
        entry[0] += entry[2] != t
        entry[1] += 1
        entry[2] = t
    return [
        (c, np.array([g for g, _ in counts[c]], np.int64), [k for _, k in counts[c]],
         np.array([v[0] for v in counts[c].values()], np.int64), np.array([v[1] for v in counts[c].values()], np.int64))
        for c in (True, False)
    ]


def _level(batches: Iterator[pa.RecordBatch], low: int, high: int, bloom: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(complete, lang, source, key, docs, times) of the terms longer than ``low`` whose prefix survived.

    Terms of up to ``high`` bytes are complete; others stand as a prefix, without a source.
    """
    for batch in batches:
        names = [batch.column(c).cast(pa.string()).dictionary_encode() for c in ("lang", "source")]
        lang, source = (np.asarray(n.indices).astype(np.int64) for n in names)
        sources = max(len(names[1].dictionary), 1)
        hashed = np.array([_language(x) for x in names[0].dictionary.to_pylist()], np.uint64)
        order = np.argsort(lang * sources + source, kind="stable")  # a chunk holds few groups, so that its rows add up
        lang, source = lang[order], source[order]
        for lo, hi, body, offsets in text_chunks(batch.column("text").take(pa.array(order)), CHUNK):
            body = _LOWER[body]
            starts, stops, text = spans(_TERM[body], offsets)
            lengths = stops - starts
            longer = lengths > low
            starts, lengths, text = starts[longer], lengths[longer], text[longer]
            packed = heads(body, starts, lengths)
            langs = lang[lo:hi]
            if bloom is not None:
                if low <= 8:
                    numbers = _first(packed, low)
                else:
                    numbers = np.array([_number(body[a : a + low].tobytes()) for a in starts.tolist()], np.uint64)
                alive = _passes(bloom, numbers, hashed[langs[text]])
                starts, lengths, packed, text = starts[alive], lengths[alive], packed[alive], text[alive]
            count = _counted_short if high <= 8 else _counted_long
            for complete, owner, keys, docs, times in count(body, starts, lengths, packed, text, langs, langs * sources + source[lo:hi], high):
                if not len(keys):
                    continue
                of = names[0].dictionary.take(pa.array(owner // sources if complete else owner))
                by = names[1].dictionary.take(pa.array(owner % sources)) if complete else pa.nulls(len(keys), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), complete)), of, by, pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(times, pa.int64())],
                    ["complete", "lang", "source", "key", "docs", "times"],
                )


def _filter_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The words of the filter that a partition's prefixes (lang, key) set."""
    for batch in batches:
        numbers = np.array([_number(k) for k in batch.column("key").to_pylist()], np.uint64)
        languages = np.array([_language(x) for x in batch.column("lang").to_pylist()], np.uint64)
        at = np.concatenate(_places(numbers, languages, bits))
        words, ids = np.unique(at >> np.uint64(6), return_inverse=True)
        values = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(values, ids, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(values.view(np.int64))], ["word", "bits"])


def prefix_filter(alive: DataFrame, most_bits: int) -> np.ndarray | None:
    """A Bloom filter of the prefixes (lang, key), of ``most_bits`` at most; None without any."""
    n = alive.count()
    if not n:
        return None
    bits = min(most_bits, max(1 << 12, 1 << (16 * n).bit_length()))
    words = alive.select("lang", "key").mapInArrow(lambda it: _filter_words(it, bits), "word long, bits long")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return bloom


def frequent_terms(docs: DataFrame, least_docs: int = 3, first: int = 4, filter_bits: int = 1 << 25) -> DataFrame:
    """(lang, source, term, docs, times, lang_times): the terms in at least ``least_docs``
    documents of their language, for every group that holds them; ``term`` is binary.

    Every row is a document. Null text, lang and source count as ''. ``first`` is the
    length of the first prefixes in bytes (a power of two); it doubles from level to level.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    shape = "complete boolean, lang string, source string, key binary, docs long, times long"
    found, low, high, shared = [], 0, first, None
    while True:
        rows = docs.mapInArrow(lambda it, a=low, b=high, s=shared: _level(it, a, b, s.value if s else None), shape)
        level = written(rows.groupBy("complete", "lang", "source", "key").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")))
        found.append(level.where("complete").drop("complete"))
        alive = level.where(f"not complete and docs >= {least_docs}")
        bloom = prefix_filter(alive, filter_bits)
        if bloom is None:
            break
        shared = docs.sparkSession.sparkContext.broadcast(bloom)  # filter_bits at most
        low, high = high, 2 * high
    terms = found[0]
    for more in found[1:]:
        terms = terms.unionByName(more)
    kept = terms.groupBy("lang", "key").agg(F.sum("docs").alias("n"), F.sum("times").alias("lang_times")).where(F.col("n") >= least_docs)
    return terms.join(kept, ["lang", "key"]).select("lang", "source", F.col("key").alias("term"), "docs", "times", "lang_times")


def _share(times: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (times + 1) / (total + terms)), exact at any size."""
    top = (times + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))) + 1


def _distance(p, q):
    """floor((p - q)^2 / q) of whole numbers up to SCALE + 1."""
    return (p - q) * (p - q) // q


def _summed(g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """One row for each pair (g, h) with the sum of its values."""
    names, ids = np.unique(np.concatenate([g, h]), return_inverse=True)
    pair = ids[: len(g)] * len(names) + ids[len(g) :]
    if len(names) ** 2 < 1 << 16:
        pair = pair.astype(np.uint16)  # sorted by radix
    order = np.argsort(pair, kind="stable")
    pair = pair[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    sums = np.add.reduceat(value[order], starts)
    return pa.RecordBatch.from_arrays([pa.array(names[pair[starts] // len(names)]), pa.array(names[pair[starts] % len(names)]), pa.array(sums)], ["g", "h", "value"])


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten())


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term the groups that hold it, as lists (g, p, p0): what their pairs add to the
    sums taken from the histograms. At most ``PAIRS`` pairs of groups, or one group's, are held."""
    for batch in batches:
        sizes = np.asarray(batch.column("g").value_lengths()).astype(np.int64)
        g, p, p0 = (_flat(batch.column(c)) for c in ("g", "p", "p0"))
        peers = np.repeat(sizes, sizes)  # one entry for every (term, group)
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        done = np.r_[0, np.cumsum(peers)]
        lo = 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(lo, hi), peers[lo:hi])
            y = begins[x] + np.arange(len(x)) - (done[x] - done[lo])
            x, y = x[x != y], y[x != y]
            if len(x):
                value = _distance(p[x], p[y]) - _distance(p[x], p0[y]) - _distance(p0[x], p[y]) + _distance(p0[x], p0[y])
                yield _summed(g[x], g[y], value)
            lo = hi


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group its histogram (p, n) and the groups of its language (peers, peers_p0):
    the sums over its own terms as if no other group held them, and over all other terms."""
    for batch in batches:
        for row in range(batch.num_rows):
            me, terms = batch.column("g")[row].as_py(), batch.column("terms")[row].as_py()
            peers, q = (np.asarray(batch.column(c)[row].values) for c in ("peers", "peers_p0"))
            other = peers != me
            peers, q = peers[other], q[other]
            if not len(peers):
                continue
            out = into = np.zeros(len(peers), np.int64)
            if terms:
                p0 = batch.column("p0")[row].as_py()
                p, n = (np.asarray(batch.column(c)[row].values, dtype=np.int64) if batch.column(c)[row].is_valid else np.zeros(0, np.int64) for c in ("p", "n"))
                out = (terms - n.sum()) * _distance(p0, q)
                into = -n.sum() * _distance(q, p0)
                step = max(1, PAIRS // len(peers))
                for lo in range(0, len(p), step):
                    a, k = p[lo : lo + step, None], n[lo : lo + step, None]
                    out = out + (k * _distance(a, q)).sum(axis=0)
                    into = into + (k * _distance(q, a)).sum(axis=0)
            mine = np.full(len(peers), me, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[mine, peers]), pa.array(np.r_[peers, mine]), pa.array(np.r_[out, into])], ["g", "h", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, **settings) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of lang and source in ``docs``.

    Part ``pair`` has a row for each other source of the language: the sum over all kept
    terms of floor((p - q)^2 / q), p and q the shares of group and source, smoothed by one
    and scaled to 10^9; 0 where the language keeps no term. Part ``term`` has the ``top``
    terms of the group whose share is above the language's, with the same measure against
    it. Ranks follow falling value, ties the bytes of the item.

    Every row is a document, repeated or not; ids are not read. Null text, lang and source
    count as ''. A group without terms has pairs only, a language with one source no
    pairs, an empty table no rows. Other columns are ignored.
    """
    docs = docs.select("text", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
    terms = written(frequent_terms(docs, least_docs, **settings))
    langs = terms.groupBy("lang", "term").agg(F.first("lang_times").alias("times")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("times").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    none = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), none).alias(c) for c in ("total", "terms", "lang_total")))
    groups = written(groups.withColumn("p0", _share(none, F.col("total"), F.col("terms"))).withColumn("g", F.monotonically_increasing_id()))
    held = terms.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("times"), F.col("total"), F.col("terms")))

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = _share(F.col("lang_times"), F.col("lang_total"), F.col("terms"))
    above = held.withColumn("q", q).where("p > q").withColumn("value", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")))
    best = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    shape = "g long, h long, value long"
    lists = F.collect_list(F.struct("g", "p", "p0"))
    both = held.groupBy("lang", "term").agg(lists.alias("r")).where(F.size("r") > 1).select("r.g", "r.p", "r.p0").mapInArrow(_shared_terms, shape)
    histogram = held.groupBy("g", "p").agg(F.count("*").alias("n")).groupBy("g").agg(F.collect_list(F.struct("p", "n")).alias("c"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("g", F.coalesce("p0", F.lit(1).cast("long")).alias("p0"))).alias("s"))
    own = groups.join(histogram, "g", "left").join(peers, "lang").select("g", "terms", "p0", "c.p", "c.n", F.col("s.g").alias("peers"), F.col("s.p0").alias("peers_p0"))
    sums = both.unionByName(own.mapInArrow(_own_terms, shape)).groupBy("g", "h").agg(F.sum("value").alias("value"))
    names = groups.select(F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = sums.join(groups.select("g", "lang", "source"), "g").join(names, "h").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(best)
