"""Removal of repeated byte strings against a table of all of them."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from codexfold.llm.suffix_buckets import anchors, refined, without_repeats


def brute(rows, length=200):
    bodies = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for i, body in enumerate(bodies):
        for s in range(len(body) - length + 1):
            places[body[s : s + length]].append((i, s))
    covered = [bytearray(len(b)) for b in bodies]
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                covered[i][s : s + length] = b"\1" * length
    out = []
    for (doc, _), body, gone in zip(rows, bodies, covered):
        kept = bytes(c for c, g in zip(body, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((doc, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_documents(small_docs):
    rows, table = small_docs
    assert result(without_repeats(table)) == brute(rows)


@pytest.mark.parametrize("hot", [5, 2_000])
def test_edge_cases_and_hot_buckets(docs_of, hot):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("ab ") for _ in range(90)) for _ in range(4)]
    rows = [(None, None), (None, "é" * 150), (1, ""), (2, "a" * 500), (2, "a" * 500), (3, "x" * 199), (4, "x" * 199), (5, "ab" * 300)]
    rows += [(k, "".join(rng.choice([*pieces, f"zq{rng.random()}"]) for _ in range(rng.randint(1, 12)))) for k in range(6, 60)]
    rows += [(100 + k, f"q{k}{pieces[0]}{pieces[1]}{pieces[2]}r{k}") for k in range(60)]
    assert result(without_repeats(docs_of(rows), hot_bucket=hot)) == brute(rows)


def test_windows_repeated_in_one_part_and_alone_in_another(docs_of):
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = draw(199)
    rows = []
    for k in range(12):
        before, after = draw(40), draw(40)
        rows += [(3 * k + i, f"{draw(30)}{i}{before}{common}{after}{i}{draw(30)}") for i in range(3)]
    assert result(without_repeats(docs_of(rows), hot_bucket=5, solve_bytes=0)) == brute(rows)


def test_segments_of_a_long_text(docs_of, monkeypatch):
    text = "".join(random.Random(9).choice("abcd") for _ in range(3_000))
    rows = [(1, text + text[700:1_100]), (2, text[2_500:2_800])]
    monkeypatch.setattr("codexfold.llm.suffix_buckets.SEGMENT", 512)
    assert result(without_repeats(docs_of(rows))) == brute(rows)


def test_refinement_is_exact():
    rng = np.random.default_rng(2)
    body = np.frombuffer(rng.choice(np.frombuffer(b"ab", np.uint8), 600).tobytes() * 2, np.uint8)
    start = np.arange(0, len(body) - 16 + 1)
    usable = len(body) - np.arange(len(body))
    grams = [body[s : s + 16].tobytes() for s in start]
    assert refined(body, usable, start, 16, 4).tolist() == [grams.count(g) > 1 for g in grams]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 400, dtype=np.uint8)
    a = np.r_[rng.integers(97, 123, 333, dtype=np.uint8), passage]
    b = np.r_[passage, rng.integers(97, 123, 100, dtype=np.uint8)]

    def by_window(body):
        at, first, last, bucket = anchors(body, np.array([0, len(body)]), 200)
        return {s: (int(p) - s, int(h)) for p, f, t, h in zip(at, first, last, bucket) for s in range(f, t + 1)}

    left, right = by_window(a), by_window(b)
    assert all(left[333 + s] == right[s] for s in range(201))


def test_empty_table_and_bad_length(docs_of):
    assert without_repeats(docs_of([]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        without_repeats(docs_of([]), length=30)
