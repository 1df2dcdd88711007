"""Nearest labelled examples: exact neighbours, held-out accuracy."""

import pickle
import zlib
from collections import Counter

import numpy as np
import pytest

from codexfold.llm.queries import op7_toxicity
from codexfold.llm import toxicity as T
from codexfold.llm.toxicity import accepted, toxicity


def test_query_on_held_out_labels(spark):
    tables = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in op7_toxicity(spark, tables).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    assert len(scores) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scores.items())
    held = [(scores[d].predicted, y) for d, y in labels.items() if scores[d].held_out]
    hits = sum(p and y for p, y in held)
    assert hits / sum(y for _, y in held) > 0.85 and hits / sum(p for p, _ in held) > 0.85


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("block", [8, 64])
def test_block_max_search_is_exact(k, block, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    often = rng.permutation(len(words))
    draw = lambda: Counter(words[often[min(int(x), len(words) - 1)]] for x in rng.exponential(40, rng.integers(0, 30)))
    examples = [(i, draw(), int(rng.integers(2))) for i in range(400)]
    words, column = sorted(words), {w: i for i, w in enumerate(sorted(words))}
    weight = np.array([(1.0 + i % 7) * (i % 11 > 0) for i in range(len(words))])
    ptr = np.cumsum([0] + [len(c) for _, c, _ in examples])
    cols, times = (np.array([x for _, c, _ in examples for x in f(c)], np.int64) for f in (lambda c: [column[w] for w in c], lambda c: c.values()))
    index = T.Index(words, weight, ptr, cols, times, np.arange(400), np.array([y for *_, y in examples]), k)
    index = pickle.loads(pickle.dumps(index))
    dense = np.zeros((len(index.ids), len(words)))
    for row, i in enumerate(index.ids.tolist()):
        at, v = index.vector(examples[i][1])
        dense[row, at] = v
        own = np.zeros(len(words))
        own[index.example(row)[0]] = index.example(row)[1]
        assert np.allclose(own, dense[row])
    queries = [index.vector(draw()) for _ in range(60)] + [index.example(r) for r in range(40)]
    left_out = np.r_[np.full(60, -1), np.arange(40)]
    for without in (None, left_out):
        for q, ((at, v), (rows, found)) in enumerate(zip(queries, index.nearest(queries, without))):
            cosine = (dense[:, at] @ v).round(12)
            if without is not None and without[q] >= 0:
                cosine[without[q]] = 0
            best = np.lexsort((np.arange(len(dense)), -cosine))[:k]
            assert rows.tolist() == [i for i in best.tolist() if cosine[i] > 0] and np.allclose(found, cosine[rows])


def test_few_labels_and_rare_words_tell_texts_apart(spark, docs_of):
    rng = np.random.default_rng(9)
    prose = lambda: " ".join(f"p{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (30, 2)))
    rows = [(i, prose() + (" scumword" if i % 4 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(38)], "doc_id long, toxic int")  # about 30 are learned from
    scores = {r.doc_id: r.score for r in toxicity(docs_of(rows), labels).collect()}
    assert len(set(scores.values())) > 1
    new = [(scores[i], i % 4 == 0) for i in range(38, 60)]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in new if x for b, y in new if not y]
    assert sum(pairs) / len(pairs) > 0.85


def test_labels_of_the_held_out_fifth_are_not_read(spark, docs_of):
    rows = [(i, "bad word here" if i % 3 == 0 else "fine word here") for i in range(300)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(i, int(i % 3 == 0)) for i, _ in rows]
    wrong = [(i, 1 - y if i in held else y) for i, y in right]
    a, b = ({r.doc_id: r.score for r in toxicity(docs_of(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (right, wrong))
    assert a == b and min(a[i] for i, y in right if y) > 0.9 and max(a[i] for i, y in right if not y) < 0.1


def test_edge_cases(spark, docs_of):
    train = [(i, "scum clown" if i % 2 else "plain words") for i in range(200)]
    rows = [*train, (None, None), (None, "scum"), (900, ""), (901, None), (902, "scum clown " * 20_000), (903, "SCUM!!"), (903, "SCUM!!")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in train] + [(None, 1, "x"), (5, None, "x"), (6, 0, "x"), (99_999, 1, "x")], "doc_id long, toxic int, text string")
    found = toxicity(docs_of(rows), labels).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[902].predicted == by_id[903].predicted == 1 and by_id[900].score == by_id[901].score and by_id[903].evidence_ids
    assert not [r for r in found if r.doc_id is None and r.held_out]
    kept = accepted(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.where("doc_id = 903").count() == 0 and kept.where("doc_id is null").count() <= 2
    assert toxicity(docs_of([]).limit(0), labels).collect() == []
    for given in (labels.limit(0), labels.where("toxic = 1")):
        scores = {r.score for r in toxicity(docs_of(rows), given).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_near_copies_cost_little_memory(monkeypatch):
    """600 alike examples of 150 words: every word is in every example of a block, but in less than a tenth of all."""
    import tracemalloc

    rng = np.random.default_rng(3)
    alike = [np.sort(rng.choice(160, 150, replace=False)) for _ in range(600)]
    others = [160 + np.sort(rng.choice(4000, 12, replace=False)) for _ in range(5600)]
    ptr = np.r_[0, np.cumsum([len(c) for c in alike + others])]
    cols = np.concatenate(alike + others)
    n = len(alike) + len(others)
    labels = np.arange(n) % 2
    made = T.Index([f"w{k}" for k in range(4160)], rng.uniform(0.5, 2, 4160), ptr, cols, np.ones(len(cols), np.int64), np.arange(n), labels, 15)
    rows = np.flatnonzero(made.ids < 600)[:256]
    made.left_out(rows[:1])
    tracemalloc.start()
    votes = made.left_out(rows)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    monkeypatch.setattr(T, "POSTINGS", 1)
    assert (made.left_out(rows[:9]) == votes[:9]).all()
