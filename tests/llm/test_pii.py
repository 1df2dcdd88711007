"""Surrogates: nothing personal left, one to one, same format."""

import re

import pytest

from pyspark.sql import functions as F

from codexfold.llm.pii import LETTERS, pseudonymised, surrogates

PATTERNS = {"email": r"[\w.%+-]+@[\w.-]+\.\w+", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}", "card": r"\b\d{16}\b", "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "secret": r"\b[0-9a-f]{40}\b"}


def texts(frame):
    return [(r.doc_id, r.text, r.n_replaced) for r in frame.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()]


def test_documents(small_docs):
    rows, table = small_docs
    new = {d: (t, n) for d, t, n in texts(pseudonymised(table))}
    pairs = {kind: {} for kind in PATTERNS}
    for doc, text in rows:
        changed, n = new[doc]
        found = 0
        for kind, pattern in PATTERNS.items():
            before, after = re.findall(pattern, text, re.I), re.findall(pattern, changed, re.I)
            assert len(before) == len(after)
            found += len(before)
            for a, b in zip(before, after):
                assert pairs[kind].setdefault(a.lower(), b.lower()) == b.lower() and a.lower() != b.lower() and len(a) == len(b)
        assert n == found
        assert n or changed == text
    assert any(pairs.values())
    for mapped in pairs.values():
        assert len(set(mapped.values())) == len(mapped) and not set(mapped) & set(mapped.values())


def test_formats_and_coreference(docs_of):
    rows = [
        (1, "Mr. Hans Müller met Frau Müller; hans@x.org, HANS@X.ORG. 555-123-4567 or (555) 123-4567, 4111 1111 1111 1111 / 4111-1111-1111-1111."),
        (2, "Frau Anna Müller wrote to Hans@x.org"), (3, "Госпожа Анна Иванова, Господин Иванов, Κυρία Ελένη"), (4, "10.0.0.1 10.0.0.1, v1.2.3.4.5, 12345, 1999-12-31"),
    ]
    one, two, three, four = (t for _, t, _ in texts(pseudonymised(docs_of(rows))))
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+); (\S+@\S+\.org), (\S+@\S+\.ORG)\. (\d{3}-\d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}), ([\d ]{19}) / ([\d-]{19})\.", one)
    assert m[2] == m[3] == re.fullmatch(r"Frau \w+a (\w+) wrote to (\S+)", two)[1] != "Müller"
    assert m[1] != "Hans" and m[1][-1] == "s" and m[1].istitle()
    assert m[5] == m[4].upper() and two.lower().endswith(m[4].lower())
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(m[6]) == digits(m[7]) != "5551234567"
    assert digits(m[8]) == digits(m[9]) != "4" + "1" * 15
    luhn = sum(sum(divmod(int(d) * (2 if k % 2 else 1), 10)) for k, d in enumerate(reversed(digits(m[8]))))
    assert luhn % 10 == 0
    names = re.fullmatch(r"Госпожа (\w+) (\w+), Господин (\w+), Κυρία (\w+)", three)
    assert all(re.fullmatch("[А-ЯЁа-яё]+", names[k]) for k in (1, 2, 3)) and re.fullmatch("[Α-Ωα-ωά-ώ]+", names[4])
    assert names[1][-1] == "а"
    a, b = re.fullmatch(r"(\S+) (\S+), v1\.2\.3\.4\.5, 12345, 1999-12-31", four).groups()
    assert a == b != "10.0.0.1" and all(int(o) < 256 for o in a.split("."))


def test_edge_cases(docs_of, spark):
    rows = [(None, None), (None, "a@b.org"), (1, ""), (1, "a@b.org"), (1, "a@b.org"), (2, "x" * 300_000), (3, "@@@ @ . +1 ( 4 "), (4, "9" * 50_000), (5, "a" * 50_000 + "@")]
    got = texts(pseudonymised(docs_of(rows).withColumn("n_replaced", F.lit("old")).withColumn("_h", F.lit(1)).drop("_h")))
    assert len(got) == len(rows)
    kept = {(d, t) for d, t, n in got if not n}
    assert kept == {(d, t) for d, t in rows if t != "a@b.org"}
    assert len({t for _, t, n in got if n}) == 1
    assert pseudonymised(docs_of([]).limit(0)).collect() == []
    same = [texts(pseudonymised(docs_of(rows), key=k)) for k in ("one", "one", "two")]
    assert same[0] == same[1] != same[2]


def test_collisions_draw_again(spark):
    """A short format leaves few surrogates, some of them values themselves."""
    values = [("phone", f"1{k}") for k in range(8)]
    found = surrogates(spark.createDataFrame(values[:1] + [("name", "ba"), ("name", "be")], "kind string, value string"), "k").collect()
    assert len({(r.kind, r.surrogate) for r in found}) == 3
    assert not {(r.kind, r.value) for r in found} & {(r.kind, r.surrogate) for r in found}
    with pytest.raises(ValueError):  # eight values, two places left
        surrogates(spark.createDataFrame(values, "kind string, value string"), "k", max_attempts=3)
    values = [("phone", f"1{k}0") for k in range(8)]
    crowded = surrogates(spark.createDataFrame(values[:8], "kind string, value string"), "k").collect()
    assert len({r.surrogate for r in crowded}) == 8 and not {r.surrogate for r in crowded} & {v for _, v in values[:8]}


def test_pools_keep_scripts():
    for vowels, consonants in LETTERS.values():
        assert not set(vowels) & set(consonants) and (vowels + consonants).islower()


def test_letters_of_any_script_and_short_addresses(spark):
    mails = ["محمد@شركة.com", "דוד@חברה.com", "王小明@公司.com", "김철수@회사.com", "राम@घर.com"]
    names = ["åøãõ"]
    ips = [f"{k // 1000}.{k // 100 % 10}.{k // 10 % 10}.{k % 10}" for k in range(6_000)]
    rows = [("email", v) for v in mails] + [("name", v) for v in names] + [("ip", v) for v in ips]
    found = {(r.kind, r.value): r.surrogate for r in surrogates(spark.createDataFrame(rows, "kind string, value string"), "k").collect()}
    assert len(found) == len(rows) == len({(k, s) for (k, _), s in found.items()})
    assert all(v not in found["email", v] and len(found["email", v]) == len(v) for v in mails)
    assert not set("åøã") & set(found["name", "åøãõ"])
    assert all(all(0 <= int(o) < 256 for o in s.split(".")) for (k, _), s in found.items() if k == "ip")
