"""Exact sizes and uniform places."""

import zlib
from collections import Counter, defaultdict

import pytest

from codexfold.llm.queries import op4_hypergeometric_shards
from codexfold.llm.sharding import _hypergeometric, communication_matrix, uniform_shards


def test_query(spark, tables_dir, small_docs):
    rows, _ = small_docs
    found = op4_hypergeometric_shards(spark, tables_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(40)) and {len(s) for s in slots.values()} == {5}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_matrix_has_the_sums():
    blocks, shards = [0, 7, 100, 3, 41, 0], [38, 38, 38, 37]
    matrix = communication_matrix(blocks, shards, 4)
    assert [sum(line) for line in matrix] == blocks and [sum(c) for c in zip(*matrix)] == shards
    assert communication_matrix(blocks, shards, 4) == matrix != communication_matrix(blocks, shards, 5)


@pytest.mark.parametrize("good, bad, draws", [(3, 4, 3), (10, 1, 5), (1, 9, 9)])
def test_draws_follow_the_law(good, bad, draws):
    import random
    from math import comb

    rng = random.Random(8)
    seen = Counter(_hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    for k in range(max(0, draws - bad), min(draws, good) + 1):
        assert abs(seen[k] / 20_000 - comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)) < 0.015


def test_places_are_uniform_over_seeds(docs_of):
    table = docs_of([(k, None) for k in range(320)]).select("doc_id")
    at = Counter()
    for seed in range(3):
        for r in uniform_shards(table, 4, seed=seed, blocks=(3, 3)).collect():
            at[r.doc_id % 2, r.shard] += 1
    assert all(90 < at[half, shard] < 150 for half in (0, 1) for shard in range(4))


def test_edge_cases(docs_of):
    rows = [(None, None), (None, None), (1, ""), (1, "x"), (1, "x"), (2, "y" * 100_000)]
    table = docs_of(rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    found = uniform_shards(table, 4).collect()
    assert sorted((repr((r.doc_id, r.text)) for r in found)) == sorted(map(repr, rows))
    assert sorted(Counter(r.shard for r in found).values()) == [1, 1, 2, 2]
    assert uniform_shards(docs_of([]).limit(0), 4).collect() == []
    assert [r.slot for r in uniform_shards(docs_of([(1, "a")]), 40).collect()] == [0]
