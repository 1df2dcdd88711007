"""Containment of test items against all pairs."""

import re

from codexfold.llm.decontaminate import contained_items
from codexfold.llm.queries import op9_decontamination

WORD = re.compile(r"[^\W_]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        held = shingles(t)
        for i, x in items:
            want = shingles(x)
            n = len(want & held)
            if want and 100 * n >= 80 * len(want):
                out.add((d, i, len(want), n))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_found) for r in frame.collect()), key=repr)


def test_query(spark, tables_dir, small_docs):
    rows, _ = small_docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables_dir}/benchmark.parquet").collect()]
    found = brute(rows, items)
    assert found and result(op9_decontamination(spark, tables_dir)) == found


def test_edge_cases(spark, docs_of):
    long = " ".join(f"word{k}" for k in range(60))
    items = [(1, long), (2, " ".join(long.split()[10:40])), (3, "only three words"), (4, None), (5, ""), (6, "?!"), (None, "null id of an item here"), (2, "Another text of item two here"), (7, "a b c d e")]
    docs = [(None, f"x {long} y"), (1, f"Pre, {long.upper()}! post"), (1, "nothing at all"), (1, f"Pre, {long.upper()}! post"), (2, " ".join(long.split()[:50])), (3, "Only, three words."), (4, None), (5, ""),
            (6, "null id of an item here " * 1000), (7, "another text of item two here"), (8, "a b c d e " * 3), (9, "pad " * 20_000 + long), (10, "only three words more")]
    frame = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, h long")
    assert result(contained_items(docs_of(docs), frame)) == brute(docs, items)
    assert contained_items(docs_of([]).limit(0), frame).collect() == []
    assert contained_items(docs_of(docs), frame.limit(0)).collect() == []


def test_missing_and_changed_words(spark, docs_of):
    words = [f"t{k}" for k in range(45)]
    docs = []
    for k, changed in enumerate([(), (20,), (20, 21), (5, 20, 40), (0, 44), (3, 10, 20, 30)]):
        docs.append((k, "lead in " + " ".join("zz" if j in changed else w for j, w in enumerate(words)) + " tail"))
    items = [(k, " ".join(words[k : k + n])) for k, n in enumerate((45, 30, 12, 6, 5))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert result(contained_items(docs_of(docs), frame)) == brute(docs, items)
