"""Statistics by plain counting, the fit by a dense one, held-out accuracy."""

import zlib

import numpy as np
import pytest

from codexfold.llm import quality as q
from codexfold.llm.queries import op13_quality


def chunk(texts):
    body = "".join(texts).encode()
    return np.frombuffer(body, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])


def plain(text):
    """A part of the statistics, counted word by word."""
    words, lines = text.split(), [line.split() for line in text.split("\n") if line.split()]
    low = [w.lower() for w in words]
    runs = [tuple(low[k : k + 5]) for k in range(len(low) - 4)]
    n, body = max(len(words), 1), text.encode()
    return {
        "size": np.log1p(len(body)), "words": np.log1p(len(words)), "lines": np.log1p(len(lines)),
        "upper": sum(65 <= b <= 90 for b in body) / max(len(body), 1), "space": sum(b in b" \t\v\f\r" for b in body) / max(len(body), 1),
        "word_length": np.log1p(sum(len(w.encode()) for w in words) / n), "different_words": len(set(low)) / np.sqrt(n),
        "commonest_word": max((low.count(w) for w in set(low)), default=0) / n, "repeated_runs": 1 - len(set(runs)) / len(runs) if runs else 0,
        "repeated_lines": 1 - len({tuple(w.lower() for w in x) for x in lines}) / len(lines) if lines else 0,
        "short_lines": sum(len(x) < 4 for x in lines) / max(len(lines), 1), "ended_lines": sum(x[-1][-1] in ".!?\"'" for x in lines) / max(len(lines), 1),
    }


TEXTS = ["", "a", " \n ", "One two.\nThree, four!\nOne two.\n", "w x y z w x y z w x y z", "É漢 🙂 A\n\n\nb", "same same same", "UP down 12 |#| --\tEnd?", "\n\nno end\n"]


def test_statistics():
    rows = q.statistics(*chunk(TEXTS))
    for text, row in zip(TEXTS, rows):
        found = dict(zip(q.STATISTICS, row))
        for name, value in plain(text).items():
            assert found[name] == pytest.approx(value), (text, name)
    assert not rows[0].any() and np.isfinite(rows).all()
    alone = np.concatenate([q.statistics(*chunk([t])) for t in TEXTS])
    assert np.allclose(rows, alone)
    assert q.statistics(*chunk([])).shape == (0, len(q.STATISTICS))


def test_a_text_beyond_a_slice(monkeypatch):
    whole = q.statistics(*chunk(TEXTS))
    monkeypatch.setattr(q, "SLICE", 7)
    assert np.allclose(q.statistics(*chunk(TEXTS)), whole)


def test_partition_sums_give_the_dense_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, len(q.STATISTICS)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    rows = spark.createDataFrame([(k % q.FOLDS, x[k].tolist(), int(y[k])) for k in range(500)], "fold int, x array<double>, label int").repartition(40)
    features = q.Features(np.zeros(x.shape[1]), np.ones(x.shape[1]), 32, 5.0, 1)
    monkeypatch.setattr(q, "FIT_ROWS", 20)  # 25 partial sums, so that the tree has two levels
    total = q.normal_equations(rows, features, 500)
    z = features(x)
    for fold in range(q.FOLDS):
        part = np.column_stack([z, y])[np.arange(500) % q.FOLDS == fold]
        assert np.array_equal(total[fold], part.T @ part) or np.allclose(total[fold], part.T @ part, atol=1e-9)
    penalties = [0.0 if k == z.shape[1] - 1 else 1.0 for k in range(z.shape[1])]
    dense = np.linalg.solve(z.T @ z + np.diag(penalties), z.T @ y)
    assert np.allclose(q._solved(total.sum(axis=0), 1.0), dense, atol=1e-6)


def test_cosines_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    z = q.Features(np.zeros(6), np.ones(6), 20_000, 2.0, 3)(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 2.0**2))
    assert np.abs(z @ z.T * 2 / 20_000 - kernel).max() < 0.05


def test_isotonic_pools():
    at, values = q.isotonic([(10, 4, 0), (20, 4, 3), (30, 4, 1), (40, 4, 4)])
    assert (np.diff(at) > 0).all() and values.tolist() == [0.1, 0.5, 0.9]


def test_query_on_held_out_labels(spark):
    tables = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in op13_quality(spark, tables).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    assert len(scores) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in scores.items())
    held = [(scores[d].score, y) for d, y in labels.items() if scores[d].held_out]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.98
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert abs(good.mean() * len(good) + bad.mean() * len(bad) - len(good)) / len(held) < 0.02  # calibrated


def test_labels_of_the_held_out_third_are_not_read(spark, docs_of):
    rows = [(i, "### $$$ ||| " * 9 if i % 3 == 0 else "Plain words stand here. " * (2 + i % 4)) for i in range(300)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [(i, int(i % 3 > 0)) for i, _ in rows]
    wrong = [(i, 1 - y if i in held else y) for i, y in right]
    a, b = ({r.doc_id: r.score for r in q.quality(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (right, wrong))
    assert a == b and min(a[i] for i, y in right if y) > 0.9 and max(a[i] for i, y in right if not y) < 0.1


def test_edge_cases(spark, docs_of):
    rows = [(i, "bad ||| $$$ " * 5 if i % 2 else "Good words here. " * 5) for i in range(200)]
    more = [(None, None), (None, "||| $$$"), (900, ""), (901, None), (902, "Good words here. " * 20_000), (903, "twice"), (903, "twice"), (904, "\x00\n\n")]
    labels = spark.createDataFrame([(i, 1 - i % 2, "x") for i, _ in rows] + [(None, 1, "x"), (5, None, "x"), (6, 0, "x"), (99_999, 1, "x")], "doc_id long, quality int, text string")
    found = q.quality(docs_of(rows + more), labels).collect()
    assert len(found) == len(rows + more) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[900].score == by_id[901].score and not by_id[None].held_out and by_id[4].predicted == 1 and by_id[7].predicted == 0
    assert q.quality(docs_of([]).limit(0), labels).collect() == []
    assert {r.score for r in q.quality(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    ones = {r.score for r in q.quality(docs_of(rows), labels.where("quality = 1")).collect()}
    assert min(ones) > 0.5
    few = q.quality(docs_of(rows), labels.where("doc_id in (1, 2)")).collect()
    assert len(few) == 200 and all(0 <= r.score <= 1 for r in few)
