"""Kept terms, divergences and ranks against whole numbers counted plainly."""

import random
import re
from collections import Counter, defaultdict

import pytest

from codexfold.llm.queries import LLM_ORACLES, op11_source_divergence
from codexfold.llm.source_divergence import frequent_terms, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    spread, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        spread[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {lang for _, lang, _ in rows}:
        kept = [w for w, n in spread[lang].items() if n >= least]
        groups = {s: counts[lang, s] for _, x, s in rows if x == lang}

        def shares(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in groups if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, True) for r in rows], "text string, lang string, source string, key string, docs long, complete boolean")


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def drawn(seed, n=300):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abÄß") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 40]))) for _ in range(60)]
    pool += ["stem" * 5 + x for x in ("", "a", "b", "ab", "ab" * 20)] + ["ABCDEFGH", "abcdefgh", "abcdefghi", "漢字かな混じり文", "é", "x" * 3000]
    draw = lambda: " ".join(rng.choice(pool) + rng.choice(["", "1", "-x", "."]) for _ in range(rng.randint(0, 12)))
    return [(draw(), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 4 + ["a", "b", "c", "é", None])) for _ in range(n)]


EDGES = [
    (None, "xx", "a"), ("", "xx", "b"), ("one two", "xx", "c"), ("one", "one source", "s"), ("one", "one source", "s"), ("One ONE", "one source", "s"),
    ("tie", "t", "a"), ("tie", "t", "a"), ("tie", "t", "b"), ("tie", "t", "c"), (" \n\x00 12 ", "t", "z"), ("a\x00b a@b a[b a{b", "n", None), ("b a", "n", ""), ("a b", "n", "q"),
]


@pytest.mark.parametrize("settings", [{}, {"first": 2}, {"filter_bits": 64}])
def test_against_plain_counts(spark, settings):
    rows = drawn(1) + EDGES
    assert result(source_divergence(table(spark, rows), **settings)) == brute(rows)


def test_threshold_and_top(spark):
    rows = drawn(2)
    assert result(source_divergence(table(spark, rows), least_docs=10, top=3)) == brute(rows, 10, 3)


def test_terms_of_every_length(spark):
    rows = drawn(3)
    found = {(r.lang, r.source, bytes(r.term).decode()): (r.docs, r.times) for r in frequent_terms(table(spark, rows)).collect()}
    docs, times = Counter(), Counter()
    for text, lang, source in rows:
        words = [(lang or "", source or "", w.translate(LOWER)) for w in TERM.findall(text)]
        docs.update(set(words))
        times.update(words)
    spread = Counter()
    for (lang, _, w), n in docs.items():
        spread[lang, w] += n
    assert found == {k: (n, times[k]) for k, n in docs.items() if spread[k[0], k[2]] >= 3}
    assert max(len(w) for *_, w in found) == 3000


def test_a_long_text_in_several_chunks_and_a_large_count(spark, monkeypatch):
    monkeypatch.setattr("codexfold.llm.source_divergence.PAIRS", 7)
    rows = [("word " * 300_000 + "other", "en", "a"), ("word", "en", "b"), ("word other", "en", "c"), ("other", "en", "b")]
    assert result(source_divergence(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert source_divergence(table(spark, EDGES).limit(0)).collect() == []


def test_query_against_sql(spark, tables_dir, check_db):
    expected = check_db.execute(LLM_ORACLES["op11_source_divergence"]).fetchall()
    assert result(op11_source_divergence(spark, tables_dir)) == sorted(expected)
