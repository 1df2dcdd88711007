"""Best-fit packing with a swap-based local search.

Texts become token ids; longer texts are cut into full sequences and a rest. The
rests are packed: placed by best fit in order of falling length, then improved.
The local search takes the emptiest bin first: a document moves into another bin,
changes place with a shorter one there, two documents change place with one there, or
one with two there. Every step raises the sum of squared fills, and the search goes on
until none does; where a bin runs empty, a sequence is saved. A block that already has the fewest bins its
tokens allow needs no search.

Rests are packed in blocks of bounded size: first by the task that makes them, so that
what fills a sequence there is not shuffled; bins that stay underfull are dealt by hash,
level by level, until one block is left or a level saves no bin.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import releasing, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHE_WORDS, KEPT_WORDS = 400_000, 200_000  # entries of a worker's cache, about 80 MB, and those left when it is full
CACHE_CHARS = 64  # length of the longest entry
BLOCK_BYTES = 16 << 20  # a task packs so many bytes of pieces at a time, or fewer
LOCAL = 1 << 62  # numbers of sequences that tasks make begin here


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# words of these letters are one token of the first splitting: Latin but the capital I with
# a dot, which lower-cases to two characters, Greek and Cyrillic; no normalisation takes them apart
LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-Ωα-ωЀ-ҁҊ-ӿ]+$"
_letters = re.compile(LETTERS[1:-1])
# ASCII signs but the apostrophe, which starts contractions: the tokenizer takes letters and
# the signs after them apart
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


NARROW = 1 << 16  # ids below travel as 16-bit numbers


def taken(values: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values``, cut into runs of ``lengths``, and their lengths."""
    starts, sizes = np.cumsum(lengths) - lengths, lengths[which]
    ends = np.cumsum(sizes)
    return values[np.repeat(starts[which] - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


class WordIds:
    """Token ids of whole texts, one word after the other.

    The tokenizer drops white space and never joins across it, so the ids of a text
    are those of its words. Texts are split, and their different words found, by Arrow;
    words seen before are looked up in a bounded cache. Ids are kept as the machine's
    unsigned 32-bit numbers, little-endian on Spark's platforms.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = min(special.items(), default=(None, None))
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text, with the end id."""
        # the tokenizer lower-cases; doing it for A-Z here makes more words equal, but
        # must not spell a special token
        lowered = pa.array([t if "<|" in t else t.encode().lower().decode() for t in texts], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        # letters and signs after them have the ids of the letters and those of the signs
        stems = pc.ascii_rtrim(words.dictionary, characters=SIGNS)
        signed = pc.and_(pc.not_equal(stems, words.dictionary), pc.match_substring_regex(stems, LETTERS))
        firsts = pc.if_else(signed, stems, words.dictionary).dictionary_encode()
        signs = [w[len(s) :] for w, s in zip(strings(words.dictionary.filter(signed)), strings(stems.filter(signed)))]
        numbers = {s: k for k, s in enumerate(dict.fromkeys(signs), len(firsts.dictionary))}
        known, lengths = self.ids_of(strings(firsts.dictionary) + list(numbers))
        none = len(lengths)
        parts = np.full((len(firsts), 2), none)
        parts[:, 0] = firsts.indices
        parts[np.asarray(signed), 1] = [numbers[s] for s in signs]
        known, lengths = taken(known, np.r_[lengths, 0], parts.ravel())
        ids, lengths = taken(known, lengths.reshape(-1, 2).sum(axis=1), np.asarray(words.indices))
        at = np.r_[0, np.cumsum(lengths)][np.asarray(split.offsets)].tolist()
        end = np.array([END_ID], "<u4").tobytes()
        return [ids[lo:hi].tobytes() + end for lo, hi in zip(at, at[1:])]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one word after the other, and how many each has."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache = self.cache = dict(islice(cache.items(), KEPT_WORDS))  # met first, so the frequent ones are among them
        new = [w for w in words if w not in cache]
        self.add(new)
        coded = [cache[w] for w in words]
        for word in new:
            if len(word) > CACHE_CHARS:
                cache.pop(word, None)
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4

    def add(self, words: list[str]) -> None:
        """Many words to a call: of letters with spaces between, as the last id of each says where it
        ends; others with a special token after each, which nothing is joined across."""
        letters = list(filter(_letters.fullmatch, words)) if self.ends_word.any() else []
        signs = [w for w in set(words).difference(letters) if self.mark and self.mark not in w]
        self.add_lines(letters, " ", lambda ids: np.flatnonzero(self.ends_word[ids]) + 1, 0)
        self.add_lines(signs, self.mark, lambda ids: np.flatnonzero(ids == self.mark_id), 1)
        for word in words:
            if word not in self.cache:
                self.cache[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def add_lines(self, words: list[str], between: str, ends_in: Callable, skip: int) -> None:
        """Lines of ``words``; ``ends_in`` their ids finds the end of each word, ``skip`` ids before the next."""
        for lo in range(0, len(words), 20_000):
            parts = [words[k : k + 500] for k in range(lo, min(lo + 20_000, len(words)), 500)]
            lines = [between.join(part) + between for part in parts]
            for part, coded in zip(parts, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(coded.ids, "<u4")
                ends, raw = ends_in(ids) * 4, ids.tobytes()
                if len(ends) != len(part):
                    continue
                for word, start, end in zip(part, [0, *(ends + 4 * skip).tolist()], ends.tolist()):
                    self.cache[word] = raw[start:end]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One tokenizer for all tasks of a Python worker; its cache is bounded by ``CACHE_WORDS``."""
    return WordIds(path)


def narrowed(part: bytes) -> bytes:
    """Ids of 32 bits as such of 16, if all of them fit."""
    ids = np.frombuffer(part, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < NARROW else part


def widened(ids: str, length: str) -> F.Column:
    """The column ``ids`` with 32 bits for each of ``length`` ids, given ``narrowed`` ones."""
    zeros = F.regexp_replace(F.hex(ids), "(?<id>.{4})", "${id}0000")
    return F.when(F.octet_length(ids) == 2 * F.col(length), F.unhex(zeros)).otherwise(F.col(ids))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_texts(batches: Iterator[pa.RecordBatch], limit: int, path: str, narrow: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of the texts of ``batches``, about a million characters of text to a batch."""
    words = word_ids(path)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size < 1_000_000):
                size += len(texts[hi].as_py() or "")
                hi += 1
            out: dict = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, coded in zip(ids[lo:hi], words.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])):
                for piece, at in enumerate(range(0, len(coded), 4 * limit)):
                    part = coded[at : at + 4 * limit]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), narrowed(part) if narrow else part)
                    for c, v in zip(out, row):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                 pa.array(out["length"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()), pa.array(out["ids"], pa.binary())],
                list(out),
            )
            lo = hi


def token_pieces(docs: DataFrame, limit: int, path: str, narrow: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every row, cut at ``limit``.

    ``narrow`` gives 16-bit ids in pieces that have no larger one; ``widened`` takes them back.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(lambda it: releasing(cut_texts(it, limit, path, narrow)), PIECES)


def placed_pieces(docs: DataFrame, limit: int, path: str, block_items: int, with_ids: bool) -> DataFrame:
    """``token_pieces`` with ``item``, ``sequence_id``, ``offset`` and ``open``: every task packs the rests it
    makes in blocks of ``block_items``, fewer where their ids fill ``BLOCK_BYTES``. Full sequences have no place.
    ``item`` numbers the pieces in the order of the rows."""

    def pack(block: list[pa.RecordBatch], bins: int) -> tuple[pa.Table, int]:
        table = pa.Table.from_batches(block)
        lengths = table["length"].to_numpy()
        order, bin_, offset, open_ = in_bins(lengths, limit, [best_fit(lengths, limit)])
        number = LOCAL + (TaskContext.get().partitionId() << 24) + bins + bin_
        table = table.take(order)
        for name, column in (("sequence_id", number), ("offset", offset), ("open", open_ | (len(order) < block_items // 10))):
            table = table.append_column(name, pa.array(column))
        return table, bins + int(bin_[-1]) + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        items = size = bins = 0
        item = TaskContext.get().partitionId() << 33
        for batch in cut_texts(batches, limit, path, with_ids):
            if not with_ids:
                batch = batch.drop_columns(["ids"])
            batch = batch.append_column("item", pa.array(np.arange(item, item + batch.num_rows)))
            item += batch.num_rows
            full = pc.equal(batch["length"], limit)
            whole = batch.filter(full)
            if whole.num_rows:
                n = whole.num_rows
                empty = {"sequence_id": pa.nulls(n, pa.int64()), "offset": pa.nulls(n, pa.int64()), "open": pa.array(np.zeros(n, bool))}
                yield pa.RecordBatch.from_arrays([*whole.columns, *empty.values()], [*whole.schema.names, *empty])
            rests = batch.filter(pc.invert(full))
            while rests.num_rows:
                some = rests.slice(0, block_items - items)
                rests = rests.slice(some.num_rows)
                held.append(some)
                items, size = items + some.num_rows, size + some.nbytes
                if items == block_items or size >= BLOCK_BYTES:
                    table, bins = pack(held, bins)
                    held, items, size = [], 0, 0
                    yield from table.to_batches(2_000)
        if held:
            yield from pack(held, bins)[0].to_batches(2_000)

    shape = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(lambda it: releasing(pieces(it)), f"{shape}, item long, sequence_id long, offset long, open boolean")


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # rooms in use, sorted
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([])
            bin_, room = len(bins) - 1, limit
        else:
            room = rooms[at]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        bins[bin_].append(item)
        room -= n
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(bin_)
    return bins


def _pairs(items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The different sums of two of ``items``, rising, and a pair for each."""
    _, one = np.unique(lengths[items], return_index=True)
    twice = np.setdiff1d(np.arange(len(items)), one)
    _, other = np.unique(lengths[items[twice]], return_index=True)
    few = items[np.r_[one, twice[other]]]  # two of a length are enough
    i, j = np.triu_indices(len(few), 1)
    sums, first = np.unique(lengths[few[i]] + lengths[few[j]], return_index=True)
    return sums, np.stack([few[i[first]], few[j[first]]], axis=1).tolist()


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Moves and swaps among underfull bins until no step raises the sum of squared fills
    or no bin is left to save. An item's length stays and its bin changes, so one array of
    items serves all steps; full bins take part in none."""
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    fewest = -(-int(lengths.sum()) // limit)
    owner = np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    members = [set(b) for b in bins]
    left = len(bins)

    def exchange(donor: int, taker: int, out: list[int], back: list[int]) -> None:
        nonlocal left
        members[donor].difference_update(out)
        members[donor].update(back)
        members[taker].difference_update(back)
        members[taker].update(out)
        owner[out], owner[back] = taker, donor
        gain = int(lengths[out].sum() - lengths[back].sum())
        fill[taker] += gain
        fill[donor] -= gain
        left -= not members[donor]

    def best(gain: np.ndarray, donors: np.ndarray | int, takers: np.ndarray | int) -> int | None:
        """The step that raises the squares most, if one does."""
        rise = np.where(gain > 0, gain * (fill[takers] - fill[donors] + gain), 0)
        rise[np.broadcast_to(donors == takers, rise.shape)] = 0
        at = int(np.argmax(rise)) if len(rise) else 0
        return at if len(rise) and rise[at] > 0 else None

    def largest(give: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.searchsorted(give, most, "right") - 1

    def step(k: int, others: np.ndarray, items: np.ndarray) -> bool:
        mine = np.array(sorted(members[k], key=lambda x: (lengths[x], x)), np.int64)
        own, whose, size = lengths[mine], owner[items], lengths[items]
        at = largest(own, limit - fill[others])  # a move
        found = best(np.where(at >= 0, own[at], 0), k, others)
        if found is not None:
            exchange(k, int(others[found]), [int(mine[at[found]])], [])
            return True
        most = size + limit - fill[whose]
        at = largest(own, most)  # one for one
        found = best(np.where(at >= 0, own[at] - size, 0), k, whose)
        if found is not None:
            exchange(k, int(whose[found]), [int(mine[at[found]])], [int(items[found])])
            return True
        if len(mine) < 2:
            return False
        sums, pairs = _pairs(mine, lengths)
        at = largest(sums, most)  # two of this bin for one
        found = best(np.where(at >= 0, sums[at] - size, 0), k, whose)
        if found is not None:
            exchange(k, int(whose[found]), pairs[at[found]], [int(items[found])])
            return True
        at = np.searchsorted(sums, size - (limit - int(fill[k])))  # one for two of this bin
        found = best(np.where(at < len(sums), size - sums[np.minimum(at, len(sums) - 1)], 0), whose, k)
        if found is not None:
            exchange(int(whose[found]), k, [int(items[found])], pairs[at[found]])
            return True
        return False

    changed = True
    while changed and left > fewest:
        changed = False
        under = np.flatnonzero((fill > 0) & (fill < limit))
        items = np.flatnonzero(np.isin(owner, under))
        for k in under[np.argsort(fill[under], kind="stable")].tolist():
            while left > fewest and 0 < fill[k] < limit and step(k, under, items):
                changed = True
    return [sorted(b) for b in members if b]


def in_bins(
    lengths: np.ndarray, limit: int, starts: list[list[list[int]]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items in the order of the fewest bins that a search from one of ``starts`` ends with;
    for each its bin, its offset there, and whether the bin is open to the next level."""
    fewest = -(-int(lengths.sum()) // limit)
    bins = starts[0]
    for n, start in enumerate(starts):
        found = local_search(start, lengths, limit)
        bins = found if not n or len(found) < len(bins) else bins
        if len(bins) <= fewest:
            break
    order = np.concatenate([np.array(b, np.int64) for b in bins])
    counts = [len(b) for b in bins]
    fills = np.array([lengths[b].sum() for b in bins])
    first = np.repeat(np.cumsum(fills) - fills, counts)
    offset = np.cumsum(lengths[order]) - lengths[order] - first
    return order, np.repeat(np.arange(len(bins)), counts), offset, np.repeat(fills < limit * 0.99, counts)


def _packed(frame: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Bins of one block; ``open`` marks those whose documents go to the next level.

    ``held`` names the bins of the level before. They are searched as they are, too, so
    that no level makes more bins than came to it.
    """
    frame = frame.sort_values("item", ignore_index=True)
    lengths = frame["length"].to_numpy(np.int64)
    starts = [best_fit(lengths, limit), [list(b) for b in frame.groupby("held").indices.values()]]
    order, bin_, offset, open_ = in_bins(lengths, limit, starts)
    out = frame.iloc[order].reset_index(drop=True).assign(bin=bin_, offset=offset, open=open_)
    return out[["block", "item", "length", "bin", "offset", "open"]]


def best_fit_packing(
    docs: DataFrame, limit: int = 4096, block_items: int = 10_000, path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids) of all of ``docs``.

    Null texts count as empty; an empty text is its end id alone, so no row is
    lost. Rows may repeat, ids repeat or be null: every row is packed on its own.
    Texts of any length are cut into pieces of ``limit``; an empty table gives an
    empty result; other columns are ignored. ``with_ids=False`` leaves out the
    column of ids, little-endian unsigned 32-bit numbers.
    """
    pieces = written(placed_pieces(docs, limit, path or vocabulary_path(), block_items, with_ids), "zstd")
    first = F.col("offset") == 0  # one document of every bin
    rests, left, before = pieces.agg(F.count("offset"), F.count_if("open"), F.count_if(first & F.col("open"))).first()
    if rests <= block_items:  # one search over all of them
        pieces, left = pieces.withColumn("open", F.col("offset").isNotNull()), rests
    shape = "block long, item long, length long, bin long, offset long, open boolean"
    rest = pieces.where("open").select("item", "length", F.col("sequence_id").alias("held"))
    placed, level = [], 0
    while left:
        blocks = -(-left // block_items)
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("held", F.lit(level)), F.lit(blocks)))
        number = F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")
        done = written(dealt.groupBy("block").applyInPandas(lambda f: _packed(f, limit), shape).withColumn("sequence_id", number))
        bins, underfull, left = done.agg(F.count_if(first), F.count_if(first & F.col("open")), F.count_if("open")).first()
        last = blocks == 1 or bins >= before
        placed.append((done if last else done.where("not open")).select("item", "sequence_id", "offset"))
        if last:
            break
        rest, level, before = done.where("open").select("item", "length", F.col("sequence_id").alias("held")), level + 1, underfull
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    # full sequences and those the tasks filled stay where they are; only what was open is shuffled
    result = pieces.where("not open").withColumns(
        {"sequence_id": F.coalesce("sequence_id", -1 - F.col("item")), "offset": F.coalesce("offset", F.lit(0).cast("long"))}
    ).select(columns)
    if placed:
        places = placed[0]
        for more in placed[1:]:
            places = places.unionByName(more)
        result = result.unionByName(pieces.where("open").drop("sequence_id", "offset").join(places, "item").select(columns))
    return result.withColumn("ids", widened("ids", "length")) if with_ids else result
