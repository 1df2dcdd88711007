"""Ranks and cuts against plain counting, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexfold.llm.fill_in_middle import UNITS, WaveletMatrix, classes, fill_in_middle, restored
from codexfold.llm.queries import LLM_ORACLES, op12_fill_in_middle

TEXTS = [
    None, "", "a", "é", "漢字", "🙂" * 7, " ", "\n", "\n\n a\nb  c\n", "one two  three\tfour\nfive", "ends <P", "<S", "x<P>y", "a <M> b", "<<S", "S>", ">",
    "é" * 5, "\x00nul\x00", "w " * 50_000, "long line without an end " * 4_000 + "é",
]


def units_of(text, unit):
    """Starts of the units, in code points."""
    if unit == "char":
        return list(range(len(text)))
    if unit == "word":
        return [m.start() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    return [m.end() for m in re.finditer(r"^|\n(?=.)", text, re.S)] if text else []


def brute(doc_id, text, unit, seed=1):
    text = text or ""
    starts = units_of(text, unit)
    n = len(starts)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    at = [0 if k == 0 else (starts + [len(text)])[k] for k in (a, b)]
    prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", list(UNITS))
def test_every_form_and_unit(spark, docs_of, unit):
    rng = random.Random(4)
    drawn = ["".join(rng.choice("aé漢🙂 \n\t.<PSM>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(TEXTS * 3 + drawn)] + [(None, "no id here"), (None, None), (7, "twice"), (7, "twice"), (-5, "below zero")]
    made = fill_in_middle(docs_of(rows), unit=unit).withColumn("back", restored(F.col("output"), F.col("form")))
    found = made.collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in found), key=key) == sorted((brute(d, t, unit) for d, t in rows), key=key)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}




def test_ranks_and_places():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 5, size).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols), np.arange(size + 1)
        for s in range(5):
            assert matrix.rank(s, at).tolist() == [int((symbols[:k] == s).sum()) for k in range(size + 1)]
        for chosen in UNITS.values():
            starts = [*np.flatnonzero(np.isin(symbols, chosen)).tolist(), size]
            k = np.arange(len(starts))
            assert matrix.locate(chosen, k, np.zeros_like(k), np.full_like(k, size)).tolist() == starts
    assert WaveletMatrix(np.zeros(0, np.uint8)).count(UNITS["char"], np.array([0])).tolist() == [0]


def test_classes_count_units_of_every_text():
    texts = [t or "" for t in TEXTS]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    matrix = WaveletMatrix(classes(body, offsets))
    for unit, chosen in UNITS.items():
        assert np.diff(matrix.count(chosen, offsets)).tolist() == [len(units_of(t, unit)) for t in texts]


def test_shares_and_seeds(docs_of):
    frame = docs_of([(k, "some text of a few words") for k in range(4_000)])
    count = lambda **s: {r.form: r["count"] for r in fill_in_middle(frame, **s).groupBy("form").count().collect()}
    usual = count()
    assert 300 < usual["plain"] < 500 and 600 < usual["spm"] < 840
    assert count(transformed_percent=0) == {"plain": 4_000} and set(count(transformed_percent=100, spm_percent=100)) == {"spm"}
    assert count(seed=2) != usual


def test_empty_table(docs_of):
    assert fill_in_middle(docs_of([]).limit(0)).collect() == []


def test_query_against_sql(spark, tables_dir, check_db):
    names = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    expected = check_db.execute(f"SELECT {names} FROM ({LLM_ORACLES['op12_fill_in_middle']})").fetchall()
    found = op12_fill_in_middle(spark, tables_dir).select(names.split(", ")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
