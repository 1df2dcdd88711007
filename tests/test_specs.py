"""Generated documents of odd shapes."""

import time

from codexfold.operators import specs as S


def test_long_and_broken_tables(spark):
    long = "| File | Change Type | Effort (S/M/L) |\n|---|---|---|\n" + "| f | Add | S |\n" * 100_000
    two = "| Effort | X |\n|--|--|\n| M | a |\n\n| Other | T |\n| x | y |\ntext\n  | Name | Effort |\n| n | L |"
    start = time.time()
    rows = S.impact_rows(spark.createDataFrame([(1, long), (2, two), (3, None), (4, "")], "doc_id long, text string"))
    assert rows.where("doc_id = 1 and effort = 'S' and change_type = 'Add'").count() == 100_000
    assert {(r.subject, r.change_type, r.effort) for r in rows.where("doc_id <> 1").collect()} == {("M", None, "M"), ("n", None, "L")}
    assert time.time() - start < 60


def test_manifest_paths(spark):
    items = ["src/A.java changes", "Create `src/B.java` anew", "Order.process → src/C.java", "Delete old.xml", "`go.mod`", "Nothing named here", "Move `a/X.java` -> `b/Y.java`"]
    text = "## File Change Manifest\n" + "\n".join(f"- [ ] {i}" for i in items)
    got = {r.path for r in S.manifest_paths(spark.createDataFrame([(1, text)], "session_id long, text string")).collect()}
    assert got == {"src/A.java", "src/B.java", "src/C.java", "old.xml", "go.mod", "b/Y.java"}


def test_hyphens_and_inline_declarations(spark):
    text = "```mermaid\ngraph LR\n  order-svc --> B[b c]\n  B --> C\n  D[d --> e]\n```"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {(r.source, r.target) for r in S.diagram_edges(docs).collect()} >= {("order-svc", "B"), ("B", "C")}
    declared = {r.node: r.declared for r in S.diagram_nodes(docs).collect()}
    assert declared["B"] and declared["D"] and not declared["order-svc"] and not declared["C"]
