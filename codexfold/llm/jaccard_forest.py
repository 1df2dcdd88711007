"""Exact Jaccard join of texts on word shingles with a forest of signature trees.

One tree over all texts saturates: near its root every bitmap is full, so the
traversal would visit a quadratic number of node pairs. The trees are therefore
planted where a link is possible at all. Under any one order of all tokens two sets
with Jaccard >= t share a token among the first ``n - ceil(2t / (1 + t) * n) + 1`` of
the smaller, its own tokens, and the first ``n - ceil(t * n) + 1`` of the larger; each
such shared token is the root of a tree. Texts that only probe a tree, by a token that
is not their own, are never compared with each other, and a tree that nobody owns is
none. The order is by how often tokens occur, estimated in a sketch of fixed size, then
by hash: a passage that many texts share comes last in all of them, and as long as it
makes no two of them similar, it is nobody's own. Trees with the same texts count once.

In a tree, texts lie in order of size; a node holds the OR of its texts' token
bitmaps, its size range and the largest number of tokens lost to shared bits. A
pair of nodes is visited only if their sizes allow the threshold, their texts
are not already joined, and the largest possible overlap,
popcount(a & b) + lost, reaches it.

Two searches follow. The first works on bitmaps alone and joins what may be
similar; this gives clusters, and every text is in one cluster at most. The second
takes each cluster as a tree, now with the whole sets, and verifies leaf pairs on
them; so sets are read for possible duplicates only. Each search has two steps.
First every text goes to its largest tree, to one of its chunks of bounded size,
together with the tree's pivot: most copies of one text become one component with
few comparisons. Then the trees that still hold several components are traversed
over pairs of chunks, but for pairs inside the largest component. The number of
shuffled rows thus follows the number of texts, not that of the trees they are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import partitions_for, releasing, sorted_groups, written
from codexfold.llm.components import connected_components
from codexfold.llm.kernels import distinct, mix, set_key, shingle_sets

LEAF, FANOUT = 16, 4
LEAST_BITS, MOST_BITS = 256, 1 << 18
COUNTERS = 4096  # of the order's sketch, in a row


def width_for(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: two to four times as many."""
    width = LEAST_BITS
    while width < 2 * n and width < MOST_BITS:
        width *= 2
    return width


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[((tokens >> np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller power-of-two width."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Tree:
    """Sets by bitmap and size; a dual traversal that visits what may still matter."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, percent: int):
        self.sizes, self.maps, self.percent = sizes, maps, percent
        self.lost = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

    def node(self, members: np.ndarray) -> tuple:
        """(texts, bitmap, smallest, largest, lost, children) of members in order of size."""
        if len(members) > LEAF:
            children = [self.node(part) for part in np.array_split(members, FANOUT)]
            bits = np.bitwise_or.reduce([c[1] for c in children])
        else:
            children, bits = None, np.bitwise_or.reduce(self.maps[members], axis=0)
        sizes = self.sizes[members]
        return members, bits, int(sizes[0]), int(sizes[-1]), int(self.lost[members].max()), children

    def traverse(self, left: np.ndarray, right: np.ndarray | None) -> None:
        a = self.node(left)
        stack = [(a, a if right is None else self.node(right))]
        while stack:
            a, b = stack.pop()
            if 100 * a[3] < self.percent * b[2] or 100 * b[3] < self.percent * a[2]:
                continue
            if a is not b:
                overlap = min(a[3], b[3], int(np.bitwise_count(a[1] & b[1]).sum()) + min(a[4], b[4]))
                if (100 + self.percent) * overlap < self.percent * (a[2] + b[2]):
                    continue
            if self.settled(a[0], b[0]):
                continue
            if a is b:
                if a[5] is None:
                    self.leaves(a[0], None)
                else:
                    stack += [(x, y) for i, x in enumerate(a[5]) for y in a[5][i:]]
            elif a[5] is None and b[5] is None:
                self.leaves(a[0], b[0])
            elif b[5] is None or (a[5] is not None and len(a[0]) >= len(b[0])):
                stack += [(x, b) for x in a[5]]
            else:
                stack += [(a, y) for y in b[5]]

    def leaves(self, a: np.ndarray, b: np.ndarray | None) -> None:
        for at, i in enumerate(a):
            others = a[at + 1 :] if b is None else b
            if not len(others):
                continue
            n, sizes = self.sizes[i], self.sizes[others]
            shared = np.bitwise_count(self.maps[others] & self.maps[i]).sum(axis=1, dtype=np.int64)
            overlap = np.minimum(np.minimum(n, sizes), shared + np.minimum(self.lost[i], self.lost[others]))
            near = others[(100 + self.percent) * overlap >= self.percent * (n + sizes)]
            if len(near):
                self.meet(int(i), near)


class Linking(Tree):
    """A traversal that joins sets; ``root`` is a union-find over them."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, percent: int, components: list | None = None):
        super().__init__(sizes, maps, percent)
        first: dict = {}
        self.root = [first.setdefault(c, i) for i, c in enumerate(components)] if components else list(range(len(sizes)))
        self.start = list(self.root)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def settled(self, a: np.ndarray, b: np.ndarray) -> bool:
        top = self.find(int(a[0]))
        return all(self.find(i) == top for i in a.tolist()) and all(self.find(i) == top for i in b.tolist())

    def join(self, x: int, y: int) -> None:
        self.root[max(x, y)] = min(x, y)

    def links(self) -> list[tuple[int, int]]:
        """(text, root) for texts whose component changed."""
        return [(i, r) for i in range(len(self.root)) if (r := self.find(i)) != self.start[i] and r != i]


class Possible(Linking):
    """Joins sets that may be similar by their bitmaps."""

    def meet(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            x, y = self.find(i), self.find(j)
            if x != y:
                self.join(x, y)


class Similar(Linking):
    """Joins similar sets."""

    def __init__(self, sets: list[np.ndarray], components: list, percent: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        width = min(2 * width_for(int(sizes.max())), 1 << 16)
        super().__init__(sizes, np.stack([bitmap(s, width) for s in sets]), percent, components)
        self.sets = sets

    def meet(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            x, y = self.find(i), self.find(j)
            if x != y and self.similar(i, j):
                self.join(x, y)

    def similar(self, i: int, j: int) -> bool:
        small, large = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        return 100 * both >= self.percent * (len(small) + len(large) - both)


def _sides(order: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Left and right members; right is None where a cell is compared within itself."""
    left, right = order[side[order] == 0], order[side[order] == 1]
    return left, right if len(right) else None


def _unique(group: pa.Table) -> np.ndarray:
    """The first row of every (key, side), in order of size."""
    key, side = np.asarray(group.column("key")), np.asarray(group.column("side"))
    order = np.lexsort((side, key))
    again = np.r_[False, (key[order][1:] == key[order][:-1]) & (side[order][1:] == side[order][:-1])]
    return order[~again]


def _links_of(tree: Linking, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = tree.links()
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(keys[[i for i, _ in pairs]]), pa.array(keys[[j for _, j in pairs]])], ["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join what may be similar in rows (tree, width, i, j, side, key, n, bits)."""
    for group in sorted_groups(batches, ["tree", "width", "i", "j"]):
        rows = _unique(group)
        words = int(group.column("width")[0].as_py()) // 64
        bits = group.column("bits")
        maps = np.stack([folded(np.frombuffer(bits[r].as_buffer(), np.uint64), words) for r in rows.tolist()])
        components = group.column("component").to_pylist()
        tree = Possible(np.asarray(group.column("n"))[rows].astype(np.int64), maps, percent, [components[r] for r in rows.tolist()])
        left, right = _sides(np.lexsort((np.arange(len(rows)), tree.sizes)), np.asarray(group.column("side"))[rows])
        if len(left) > 1 or (len(left) and right is not None):
            tree.traverse(left, right)
        yield from _links_of(tree, np.asarray(group.column("key"))[rows])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) in the cells of rows (tree, i, j, side, key, component, tokens).

    Side 0 is compared within itself, or with side 1 where there is one.
    """
    for group in sorted_groups(batches, ["tree", "i", "j"]):
        rows = _unique(group)
        if len(rows) < 2:
            continue
        tokens, components = group.column("tokens"), group.column("component").to_pylist()
        tree = Similar([np.frombuffer(tokens[r].as_py(), np.uint64) for r in rows.tolist()], [components[r] for r in rows.tolist()], percent)
        order = np.lexsort((np.arange(len(rows)), tree.sizes))
        left, right = _sides(order, np.asarray(group.column("side"))[rows])
        if len(left):
            tree.traverse(left, right)
        yield from _links_of(tree, np.asarray(group.column("key"))[rows])


def slots_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    """The counter of each token."""
    return (mix(tokens) % np.uint64(slots)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Per text its id, set size, set key and bitmap; per task its token counters in blocks."""
    counters, held, total = np.zeros(slots, np.int64), [], 0
    names = ["kind", "doc_id", "n_shingles", "key", "bits"]
    for batch in batches:
        ids = batch.column("doc_id")
        sizes, keys, maps, seen = np.zeros(len(ids), np.int64), [None] * len(ids), [None] * len(ids), set()
        for row, tokens in shingle_sets(batch.column("text"), width):
            if not len(tokens):
                continue
            sizes[row], keys[row] = len(tokens), set_key(tokens)
            maps[row] = bitmap(tokens, width_for(len(tokens))).tobytes()
            if keys[row] not in seen:  # copies of one text do not make its tokens common
                seen.add(keys[row])
                held.append(slots_of(tokens, slots))
                total += len(tokens)
            if total > 500_000:
                counters += np.bincount(np.concatenate(held), minlength=slots)
                held, total = [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(ids), np.int32)), ids, pa.array(sizes), pa.array(keys, pa.int64()), pa.array(maps, pa.binary())], names
        )
    if held:
        counters += np.bincount(np.concatenate(held), minlength=slots)
    blocks = np.minimum(counters, 65_535).astype(np.uint16).reshape(-1, COUNTERS)
    some = np.flatnonzero(blocks.any(axis=1))
    if len(some):
        nothing = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(some), np.int32)), nothing, nothing, pa.array(some), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names
        )


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counters (block, bits) added up, as quarters of their binary logarithm."""
    sums: dict = {}
    for batch in batches:
        for block, counters in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(counters, np.uint16).astype(np.int64)
    ranks = [np.minimum(4 * np.log2(1 + n), 255).astype(np.uint8).tobytes() for n in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(ranks, pa.binary())], ["block", "ranks"])


def token_ranks(sketch: DataFrame, slots: int) -> np.ndarray:
    """How common the tokens of each counter are, 0 to 255; ``slots`` bytes pass the driver."""
    ranks = np.zeros((slots // COUNTERS, COUNTERS), np.uint8)
    counters = sketch.where("kind = 1").select(F.col("key").alias("block"), "bits").repartition("block")
    for r in counters.mapInArrow(lambda it: releasing(_ranks(it)), "block long, ranks binary").collect():
        ranks[r.block] = np.frombuffer(r.ranks, np.uint8)
    return ranks.reshape(-1)


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, ranks: np.ndarray, buckets: int):
    """Per bucket of tokens a block of tokens, set keys and set sizes from the prefixes of the sets.

    Within a bucket a token is known by 32 bits; tokens that are the same there share a
    tree. The size is negative where the token is not the text's own.
    """
    names = ["bucket", "tokens", "keys", "sizes"]
    for batch in batches:
        seen, tokens_of, sizes_of, key_of = set(), [], [], []

        def blocks(tokens_of=tokens_of, sizes_of=sizes_of, key_of=key_of):
            if not tokens_of:
                return
            keys = np.repeat(np.array(key_of, np.int64), [len(t) for t in tokens_of])
            tokens, sizes = mix(np.concatenate(tokens_of)), np.concatenate(sizes_of)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            tokens = (tokens >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cuts)
            blobs = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (tokens, keys, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[p[0] for p in parts]]), *blobs], names)
            for x in (tokens_of, sizes_of, key_of):
                x.clear()

        total = 0
        for _, tokens in shingle_sets(batch.column("text"), width):
            if not len(tokens) or (key := set_key(tokens)) in seen:
                continue
            seen.add(key)
            n = len(tokens)
            probe, own = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
            common = ranks[slots_of(tokens, len(ranks))].astype(np.uint64)
            first = np.argsort(common << np.uint64(56) | tokens >> np.uint64(8), kind="stable")[:probe]
            tokens_of.append(tokens[first])
            sizes_of.append(np.where(np.arange(probe) < own, n, -n).astype(np.int32))
            key_of.append(key)
            total += probe
            if total > 1_000_000:
                yield from blocks()
                total = 0
        yield from blocks()


def _roots(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(tree, key, own) of every token that a text owns and another, of a size that may
    be similar, owns or probes; equal trees once."""
    blobs: dict = {"tokens": [], "keys": [], "sizes": []}
    for batch in batches:
        for name, held in blobs.items():
            held.extend(batch.column(name).to_pylist())
    tokens, keys, sizes = (np.frombuffer(b"".join(blobs.pop(name)), t) for name, t in (("tokens", np.uint32), ("keys", np.int64), ("sizes", np.int32)))
    if not len(tokens):
        return
    order = np.lexsort((-sizes, keys, tokens))  # own before probing
    tokens, keys, sizes = tokens[order], keys[order], sizes[order].astype(np.int64)
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]
    tokens, keys, sizes = tokens[new], keys[new], sizes[new]
    begins = np.r_[True, tokens[1:] != tokens[:-1]]
    starts, tree = np.flatnonzero(begins), np.cumsum(begins) - 1
    own = sizes > 0
    least = np.minimum.reduceat(np.where(own, sizes, np.iinfo(np.int64).max), starts)[tree]
    most = np.maximum.reduceat(np.where(own, sizes, 0), starts)[tree]
    kept = own | ((-sizes >= least) & (-sizes * percent <= 100 * most))
    kept &= np.bincount(tree, kept)[tree] > 1
    keys, own, tree = keys[kept], own[kept], tree[kept]
    if not len(keys):
        return
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    counts = np.diff(np.r_[starts, len(tree)])
    scrambled = mix(keys.view(np.uint64))
    names = mix(np.add.reduceat(scrambled, starts) + counts.astype(np.uint64))
    owners = mix(names + np.add.reduceat(np.where(own, scrambled, np.uint64(0)), starts))
    once = np.zeros(len(starts), bool)
    once[np.unique(owners, return_index=True)[1]] = True
    rows = np.flatnonzero(np.repeat(once, counts))
    names = np.repeat(names, counts).view(np.int64)
    for lo in range(0, len(rows), 100_000):
        part = rows[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(keys[part]), pa.array(own[part])], ["tree", "key", "own"])


def _filter_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The words of a Bloom filter (two bits a key) that a partition's keys set."""
    words: dict = {}
    for batch in batches:
        h = mix(np.asarray(batch.column("key")).view(np.uint64))
        for at in (h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)):
            for word, bit in zip((at >> np.uint64(6)).tolist(), (at & np.uint64(63)).tolist()):
                words[word] = words.get(word, 0) | 1 << bit
    values = np.array(list(words.values()), np.uint64).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(values)], ["word", "bits"])


def _whole_sets(batches: Iterator[pa.RecordBatch], width: int, bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, tokens) of the texts whose key may be in a tree, once per batch."""
    bits = np.uint64(len(bloom) * 64)
    for batch in batches:
        found: dict = {}
        for _, tokens in shingle_sets(batch.column("text"), width):
            if len(tokens):
                key = set_key(tokens)
                h = mix(np.array([key], np.int64).view(np.uint64))
                at = np.concatenate([h % bits, (h >> np.uint64(32)) % bits])
                if key not in found and ((bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all():
                    found[key] = tokens.tobytes()
            if len(found) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["key", "tokens"])
                found = {}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["key", "tokens"])


def planted(texts: DataFrame, tokens: int, ranks: np.ndarray, width: int, percent: int) -> DataFrame:
    """Trees (tree, key, own) of ``texts`` (text) with about ``tokens`` tokens in their prefixes."""
    spark = texts.sparkSession
    buckets = partitions_for(spark, 16 * tokens, 16 << 20)
    shared = spark.sparkContext.broadcast(ranks)  # one byte a counter
    shape = "bucket long, tokens binary, keys binary, sizes binary"
    prefixes = texts.mapInArrow(lambda it: releasing(_prefixes(it, width, percent, shared.value, buckets)), shape)
    roots = prefixes.repartition(buckets, "bucket").mapInArrow(lambda it: releasing(_roots(it, percent)), "tree long, key long, own boolean")
    return written(roots.groupBy("tree", "key").agg(F.bool_or("own").alias("own")))


def one_tree_each(trees: DataFrame, chunk: int) -> DataFrame:
    """Cells (tree, i, j, side, key, component): every text in a chunk of its largest tree,
    together with that tree's pivot, an owner; every text is a component of its own."""
    sizes = trees.groupBy("tree").agg(F.count("*").alias("m"), F.min(F.when(F.col("own"), F.col("key"))).alias("pivot"))
    chosen = trees.join(sizes, "tree").groupBy("key").agg(F.max_by(F.struct("tree", "pivot", "m"), F.struct("m", "tree")).alias("t"))
    spread = chosen.select("t.tree", F.pmod(F.xxhash64("key"), F.ceil(F.col("t.m") / chunk)).cast("int").alias("i"), "key", "t.pivot")
    cells = spread.select("tree", "i", F.explode(F.array("key", "pivot")).alias("key")).distinct()
    return cells.select("tree", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), "key", F.col("key").alias("component"))


def _numbers(lo: Column | int, hi: Column) -> Column:
    """lo, lo + 1, ... below hi."""
    lo = F.lit(lo) if isinstance(lo, int) else lo
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def between_components(trees: DataFrame, components: DataFrame, lengths: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Cells (tree, i, j, side, key, component) of the trees that hold several components.

    The largest component of a tree is its main one. Its texts are cut into chunks of
    four kinds, numbered one after the other: 0 owners and 1 probing texts outside the
    main component, 2 owners and 3 probing texts in it. Cell (i, j) holds chunks i <= j
    on sides 0 and 1 (one side where they are the same) for every pair of chunks of
    which one holds owners and one is outside the main component. Texts whose size no
    partner can have are left out.
    """
    now = written(
        trees.join(components.withColumnRenamed("node", "key"), "key", "left").join(lengths, "key")
        .select("tree", "key", "own", F.coalesce("component", "key").alias("component"), "n")
    )
    parts = now.groupBy("tree", "component").agg(F.count("*").alias("m"))
    largest = parts.groupBy("tree").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    kind = F.when(F.col("component") == F.col("main"), 2).otherwise(0) + F.when(F.col("own"), 0).otherwise(1)
    sides = now.join(largest, "tree").withColumn("kind", kind)
    other, main, n = F.col("kind") < 2, F.col("kind") >= 2, F.col("n")
    ranges = sides.groupBy("tree").agg(
        F.min(F.when(other, n)).alias("lo0"), F.max(F.when(other, n)).alias("hi0"),
        F.min(F.when(main, n)).alias("lo1"), F.max(F.when(main, n)).alias("hi1"),
        *[F.count_if(F.col("kind") == k).alias(f"m{k}") for k in range(4)],
    )

    def fits(lo: str, hi: str) -> Column:
        return (100 * n >= percent * F.col(lo)) & (percent * n <= 100 * F.col(hi))

    useful_row = (
        F.when(F.col("kind") == 0, (F.col("m0") + F.col("m1") > 1) | fits("lo1", "hi1"))
        .when(F.col("kind") == 1, (F.col("m0") > 0) | ((F.col("m2") > 0) & fits("lo1", "hi1")))
        .when(F.col("kind") == 2, fits("lo0", "hi0"))
        .otherwise((F.col("m0") > 0) & fits("lo0", "hi0"))
    )
    near = sides.join(ranges, "tree").where(useful_row)
    chunks = [F.ceil(F.col(f"m{k}") / chunk).cast("int") for k in range(4)]
    near = near.withColumns({"_1": chunks[0], "_2": chunks[0] + chunks[1], "_3": chunks[0] + chunks[1] + chunks[2], "_4": sum(chunks[1:], chunks[0])})
    starts, hashed = [F.lit(0), F.col("_1"), F.col("_2"), F.col("_3")], F.xxhash64("key")
    place = [start + F.pmod(hashed, count).cast("int") for start, count in zip(starts, chunks)]
    partners = [_numbers(0, F.col("_4")), F.concat(_numbers(0, F.col("_1")), _numbers(F.col("_2"), F.col("_3"))), _numbers(0, F.col("_2")), _numbers(0, F.col("_1"))]

    def by_kind(values: list[Column]) -> Column:
        return F.when(F.col("kind") == 0, values[0]).when(F.col("kind") == 1, values[1]).when(F.col("kind") == 2, values[2]).otherwise(values[3])

    cells = near.withColumn("x", by_kind(place)).withColumn("y", F.explode(by_kind(partners)))
    cells = cells.select(
        "tree", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") > F.col("y"), 1).otherwise(0).alias("side"), "key", "component"
    )
    useful = cells.groupBy("tree", "i", "j").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    useful = useful.where("(i = j and x > 1) or (i < j and x > 0 and y > 0)")
    return cells.join(useful.select("tree", "i", "j"), ["tree", "i", "j"])


def jaccard_components(
    docs: DataFrame, percent: int = 80, width: int = 5, chunk: int = 400, order_slots: int = 1 << 20, filter_bits: int = 1 << 24
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key) of every row of ``docs`` (doc_id, text).

    Texts link when their sets of ``width``-word shingles (A-Z lower-cased; whole
    sequence for fewer words) have ``100 * |a & b| >= percent * |a | b|``. The
    component is the smallest doc_id among all linked texts. Null, empty and
    word-less texts have no shingles, a null set_key, and their own id as the
    component. Repeated rows and equal sets are one node of the graph, so ids may
    repeat or be null; a component of null ids only has a null id. An empty table
    gives an empty result; other columns are ignored.

    Shingles and sets are known by 64-bit hashes. ``order_slots`` (a multiple of 4096)
    is the number of counters that order the tokens, ``filter_bits`` the size of a
    filter that spares reading sets that are in no tree; both go to the executors, and
    neither changes the result.
    """
    docs = docs.select("doc_id", "text")
    shape = "kind int, doc_id long, n_shingles long, key long, bits binary"
    sketch = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: releasing(_sketch(it, width, order_slots)), shape))
    nodes = sketch.where("kind = 0").select("doc_id", "n_shingles", "key")
    tokens = nodes.agg(F.sum(F.ceil(F.col("n_shingles") * (100 - percent) / 100) + 1)).first()[0] or 0
    trees = planted(docs.select("text"), tokens, token_ranks(sketch, order_slots), width, percent)

    signatures = written(
        sketch.where("kind = 0 and key is not null").select("key", F.col("n_shingles").alias("n"), "bits")
        .join(trees.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    )
    lengths = signatures.select("key", "n")
    wide = F.octet_length("bits") * 8
    # partners may be one width smaller; there the bitmap is folded
    widths = F.when((wide > LEAST_BITS) & (percent * F.col("n") <= 100 * wide / 4), F.array(wide, (wide / 2).cast("int"))).otherwise(F.array(wide))

    def possible(cells: DataFrame) -> DataFrame:
        """Links of what may be similar in each cell (tree, i, j, side, key, component)."""
        rows = cells.join(signatures, "key").withColumn("width", F.explode(widths))
        rows = rows.repartition("tree", "width", "i", "j").sortWithinPartitions("tree", "width", "i", "j")
        return written(rows.mapInArrow(lambda it: releasing(_possible(it, percent)), "a long, b long").distinct())

    links = possible(one_tree_each(trees, 5 * chunk))
    links = links.unionByName(possible(between_components(trees, connected_components(links), lengths, percent, 5 * chunk)))
    clusters = written(connected_components(links).select(F.col("component").alias("tree"), F.col("node").alias("key"), F.lit(True).alias("own")))

    bits = min(filter_bits, max(1 << 12, 1 << (16 * clusters.count()).bit_length()))
    words = clusters.select("key").mapInArrow(lambda it: releasing(_filter_bits(it, bits)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = words.toArrow()  # filter_bits bits at most
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    sets = written(docs.select("text").mapInArrow(lambda it: releasing(_whole_sets(it, width, bloom)), "key long, tokens binary").dropDuplicates(["key"]))

    def similar(cells: DataFrame) -> DataFrame:
        """Links of similar sets in each cell."""
        whole = cells.join(sets, "key").repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j")
        return written(whole.mapInArrow(lambda it: releasing(_linked(it, percent)), "a long, b long"))

    links = similar(one_tree_each(clusters, chunk))
    links = links.unionByName(similar(between_components(clusters, connected_components(links), lengths, percent, chunk)))
    found = connected_components(links)

    classes = nodes.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = written(classes.join(named, "component").select("key", "component_id"))
    return nodes.join(by_key, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("key").alias("set_key")
    )
