"""The Jaccard join against all pairs."""

import re

import numpy as np
import pytest

from codexfold.llm.components import connected_components
from codexfold.llm.common import written
from codexfold.llm.jaccard_forest import Possible, Similar, _sketch, bitmap, folded, jaccard_components, planted, token_ranks, width_for

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, as a sorted list."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def family(n, words=60, changes=3, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, changes):
            copy[at] = f"x{rng.integers(10**9)}"
        out.append(" ".join(copy))
    return out


def test_documents(small_docs):
    rows, table = small_docs
    assert result(jaccard_components(table)) == brute(rows)


def test_edge_cases(docs_of):
    rows = [(None, None), (None, "a b c d e f"), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d e f"),
            (6, "a b c d e f"), (7, "É b c d e f"), (8, "é b c d e f"), (9, "b c d e f g"), (None, "only null"), (10, "z" * 200_000), (11, "z " * 50_000)]
    assert result(jaccard_components(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("chunk", [7, 400])
def test_families_over_chunks(docs_of, chunk):
    texts = family(40) + family(25, changes=1, seed=6) + family(20, words=80, seed=7) + [f"lone {k} " + " ".join(f"w{j}" for j in range(30)) for k in range(30)]
    rows = list(enumerate(texts))
    assert result(jaccard_components(docs_of(rows), chunk=chunk)) == brute(rows)


def test_common_tokens_change_nothing(docs_of):
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(k, f"{line} own{k} tail{k} more{k}" if k % 3 else line) for k in range(60)]
    for slots in (4096, 1 << 20):
        assert result(jaccard_components(docs_of(rows), order_slots=slots, filter_bits=64)) == brute(rows)


def test_a_shared_passage_below_the_threshold_plants_no_trees(spark, docs_of):
    passage = " ".join(f"shared{k}" for k in range(260))
    rows = [(k, f"{passage} " + " ".join(f"own{k}_{j}" for j in range(60))) for k in range(400)]
    docs = docs_of(rows)
    sketch = written(docs.mapInArrow(lambda it: _sketch(it, 5, 1 << 20), "kind int, doc_id long, n_shingles long, key long, bits binary"))
    assert planted(docs.select("text"), 30_000, token_ranks(sketch, 1 << 20), 5, 80).count() < 100
    assert result(jaccard_components(docs, chunk=20)) == brute(rows)


def test_smaller_texts_own_and_larger_ones_probe(docs_of):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[: int(n)] + [f"x{k}_{j}" for j in range(int(m))])) for k, (n, m) in enumerate(zip(rng.integers(250, 400, 60), rng.integers(0, 60, 60)))]
    for slots in (4096, 1 << 20):
        assert result(jaccard_components(docs_of(rows), chunk=5, order_slots=slots)) == brute(rows)


def test_empty_table(docs_of):
    assert jaccard_components(docs_of([]).limit(0)).collect() == []


def test_trees_visit_every_possible_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 300 - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)]) for k in rng.integers(0, 200, 120)]
    whole = np.lexsort((np.arange(120), [len(s) for s in sets]))
    similar = Similar(sets, list(range(120)), 80)
    similar.traverse(whole, None)
    possible = Possible(np.array([len(s) for s in sets]), np.stack([folded(bitmap(s, 1024), 8) for s in sets]), 80)
    possible.traverse(whole, None)
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert similar.find(i) == similar.find(j)
                assert possible.find(i) == possible.find(j)
    assert width_for(1) == 256 and width_for(129) == 512


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
