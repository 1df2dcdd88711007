import random
import re

import pytest

from codexfold.operators import documents as D


def sections(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {}
    for r in D.section_split(df).collect():
        out.setdefault(r.doc_id, {})[r.section] = r.text
    return [out[i] for i in range(len(texts))]


def mark(word):
    return re.compile(rf"<!--\s*SECTION:\s*{word}\s*-->", re.I)


def section_model(text):
    a, b, t, e = (mark(w).search(text) for w in ("ANALYSIS", "BRD", "TECHNICAL_SPECIFICATION", "END"))
    brd = text
    if b:
        brd = text[b.end(): t.start() if t else len(text)].strip()
    return {
        "analysis": text[a.end(): b.start()].strip() if a and b else text,
        "brd": brd or text,
        "technical_spec": text[t.end(): e.start() if e else len(text)].strip() if t else "",
    }


A, B, T, E = (f"<!-- SECTION: {w} -->" for w in ("ANALYSIS", "BRD", "TECHNICAL_SPECIFICATION", "END"))


def test_section_matrix(spark):
    texts = [
        f"x{A} a {B} b {T} t {E}y", f"{A}a{B}b{T}t", f"{B} b {E} tail", f" {A}a ", f"{T} t {B} b {A}", "plain 😀 ",
        f"{A}a{B} \n{T}t", f"{B}{E}", "", f"😀{A}😀a{B}é{T}t{E}", f"{A}1{A}2{B}3{B}4{T}5{T}6{E}7{E}",
        "<!--section:brd-->b<!--\x1cSECTION: END\n-->", f"{E}{T}t",
    ]
    assert sections(spark, texts) == [section_model(t) for t in texts]


def test_sections_of_random_texts(spark):
    rng = random.Random(3)
    pieces = [A, B, T, E, A.lower(), " ", "\n", "😀", "word", "\x1f", "<!-- SECTION:", "-->"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(400)]
    assert sections(spark, texts) == [section_model(t) for t in texts]


FENCE = re.compile("```(\\w+)?(?::([^\n]+))?\n(.*?)```", re.S)


def fence_model(text, target):
    out = []
    for lang, path, code in FENCE.findall(text):
        language = lang or target
        out.append(((path or f"output.{language}").strip(), code.strip(), language))
    if not out:
        ending = {"go": "go", "java": "java", "kotlin": "kt"}.get(target.lower(), "txt")
        out.append((f"output.{ending}", text.strip(), target.lower()))
    return out


def fenced(spark, docs):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id int, text string, target_lang string")
    out = {}
    for r in D.fenced_files(df).orderBy("doc_id", "ord").collect():
        out.setdefault(r.doc_id, []).append((r.path, r.content, r.language))
    return [out[i] for i in range(len(docs))]


def test_fence_goldens(spark):
    texts = [
        "```c++\nA\n```\nmid\n```java:x/Y.java\nB\n```", "```java:  \ncode\n```", "```é:p\n1```", "```\r\nx\n```\ny```",
        "```go:a.go\n\n  x 😀 \n```tail```\nq```", "```java title=x\nA\n```\n", "none", "```java:a\nopen", "``````\nx```",
        "```py\n```", "```:only/path \nz```",
    ]
    docs = [(t, lang) for t in texts for lang in ("Go", "kotlin", "Rust")]
    got = fenced(spark, docs)
    assert got == [fence_model(*d) for d in docs]
    assert got[1] == [("output.kotlin", "mid", "kotlin")]


def test_fences_of_random_texts(spark):
    rng = random.Random(4)
    pieces = ["```", "```java", "```go:", "x/y.go", "\n", "\n", " ", "`", "code", "😀", "\r", ":"]
    docs = [("".join(rng.choices(pieces, k=rng.randrange(14))), "java") for _ in range(1500)]
    assert fenced(spark, docs) == [fence_model(*d) for d in docs]


def test_fallback_only(spark):
    df = spark.createDataFrame([(1, " x ", "Kotlin"), (2, "```\ny```", "go")], "doc_id int, text string, target_lang string")
    assert [tuple(r) for r in D.fallback_files(df).collect()] == [(1, 0, "output.kt", "x", "kotlin")]


def test_diagrams(spark):
    text = "```mermaid\ngraph LR\n A --> B\n\n```\n```mermaid:x\nno\n```\n```mermaid\n  erDiagram\n```"
    rows = D.diagram_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("ord").collect()
    assert [(r.ord, r.kind, r.body) for r in rows] == [(0, "graph", "graph LR\n A --> B\n"), (2, "erDiagram", "  erDiagram")]


def test_flags_and_languages(spark):
    df = spark.createDataFrame(
        [("a_TEST.go", "go"), ("x/Src/Test/y", "java"), ("ATest.java", "KT"), ("src/test/a", "go"), ("b.py", "Mod")],
        "path string, language string",
    )
    assert [r.is_test for r in D.test_file_flag(df).collect()] == [True, True, True, False, False]
    assert [r.language for r in D.language_normalise(df).collect()] == ["go", "java", "kotlin", "go", "go"]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_merge_equals_ordered_dictionary(spark, hot_rows):
    rng = random.Random(hot_rows)
    files = {s: [(f"r{rng.randrange(5)}", o, f"p{rng.randrange(12)}", f"{s}{o}") for o in range(120)] for s in "of"}
    schema = "repo_id string, ord bigint, path string, content string"
    frames = [spark.createDataFrame(rng.sample(files[s], 120), schema).repartition(7) for s in "of"]
    expected = {}
    for s in "of":
        for repo, _, path, content in files[s]:
            expected.setdefault(repo, {})[path] = content
    got = {}
    for r in D.merge_by_path(*frames, hot_rows).orderBy("repo_id", "ord").collect():
        got.setdefault(r.repo_id, []).append((r.ord, r.path, r.content))
    assert got == {repo: [(i, p, c) for i, (p, c) in enumerate(d.items())] for repo, d in expected.items()}
