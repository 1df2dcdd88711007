import json

import pytest

from codexfold import constants as K
from codexfold.operators import context as C

SCHEMA = "session_id bigint, seq bigint, name string, content binary"


def rows(spark, items):
    return spark.createDataFrame([(1, i, n, bytearray(c)) for i, (n, c) in enumerate(items)], SCHEMA)


def test_text_by_suffix(spark):
    good = '{"b": [1, {"a": null}], "a": "é😀", "n": 1.50}'
    items = [
        ("x.JSON", good.encode()), ("bad.json", b'{"a": 1'), ("ff.json", b'"\xff"'), ("a.pdf", b"%PDF"), ("b.DocX", b"PK"),
        ("img.png", b"\x89PNG\xff"), ("t.md", b" hi "), ("empty.json", b""), ("lone.json", b'"\\ud800"'), ("none", b""),
    ]
    got = {r.name: (r.status, r.text) for r in C.context_text(rows(spark, items)).collect()}

    def expected(name, raw):
        try:
            return "extracted", json.dumps(json.loads(raw.decode("utf-8", "replace")), indent=2)
        except Exception as problem:
            return "failed", f"[Could not extract text from {name}: {problem}]"

    for name, raw in items:
        if name.lower().endswith(".json"):
            assert got[name] == expected(name, raw)
    assert got["a.pdf"] == got["b.DocX"] == ("needs_decoder", None)
    assert got["img.png"] == ("extracted", "�PNG�")
    assert got["t.md"] == ("extracted", " hi ")


@pytest.mark.parametrize("part_chars,hot_rows", [(1 << 24, 10**6), (40, 2)])
def test_accumulate_in_parts(spark, part_chars, hot_rows):
    texts = [(s, q, f"n{q}", "" if q % 4 == 0 else "x" * (q % 7 + 1)) for s in (1, 2) for q in range(20)]
    df = spark.createDataFrame(texts, "session_id bigint, seq bigint, name string, text string").repartition(7)
    got = {}
    for r in C.context_accumulate(df, part_chars, hot_rows).orderBy("part").collect():
        value, count, names = got.get(r.session_id, ("", 0, []))
        got[r.session_id] = (value + r.additional_context, count + r.files_added, names + r.filenames.split(","))
    for s in (1, 2):
        kept = [(n, t) for sid, _, n, t in texts if sid == s and t]
        text = "".join(f"\n\n--- CONTEXT FILE: {n} ---\n{t}" for n, t in kept)
        assert got[s] == (text, len(kept), [n for n, _ in kept])


def test_gate(spark):
    files = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (3, 1, "d")], "session_id bigint, seq bigint, name string")
    confirms = spark.createDataFrame([(1, 7), (1, 8), (3, 0)], "session_id bigint, seq bigint")
    sessions = spark.createDataFrame([(1,), (2,)], "session_id bigint")
    got = {r.name: (r.accepted, r.reason) for r in C.context_before_gate(files, confirms, sessions).collect()}
    assert got == {"a": (True, None), "b": (False, "already confirmed"), "c": (True, None), "d": (False, "unknown session")}
